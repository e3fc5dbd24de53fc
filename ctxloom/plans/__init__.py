from . import flow_queries, pack_queries, queries, risk_queries, rule_queries, segment_queries, signal_queries, state_queries, text_queries  # noqa: F401  each registers its queries
