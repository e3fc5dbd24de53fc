"""Conversations: priorities, compaction by keeping or dropping turns; documents into segments; rule engines over extracted signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def message_priority(turns: DataFrame, protect: int = 2, system: float = 100.0) -> DataFrame:
    """turns(conv_id, turn, role) with priority and recency: the last `protect` are safe, older ones fall with age."""
    w = W.partitionBy("conv_id")
    rows = turns.withColumn("_i", F.row_number().over(w.orderBy("turn")) - 1).withColumn("_n", F.count("*").over(w))
    old = F.greatest(F.col("_n") - protect, F.lit(1))
    fall = F.greatest(F.lit(10.0), F.floor(50 - F.col("_i") / old * 40 + 0.5))
    priority = F.when(F.col("role") == "system", system).when(F.col("_i") >= F.col("_n") - protect, 90.0).otherwise(fall)
    recency = F.when(F.col("_n") > 1, F.col("_i") / (F.col("_n") - 1)).otherwise(1.0)
    return rows.withColumn("priority", priority.cast("double")).withColumn("recency", recency).drop("_i", "_n")


def older_turns(turns: DataFrame, keep: int = 2) -> DataFrame:
    """turns(conv_id, turn) with `preserved`: the last `keep` of each conversation."""
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return turns.withColumn("preserved", rank <= keep)


def compact(turns: DataFrame, budget: int, keep: int = 2) -> DataFrame:
    """turns with `kept`: the preserved ones, and older ones, oldest first, as far as they fit what is left."""
    from .packing import greedy

    marked = older_turns(turns, keep)
    used = marked.groupBy("conv_id").agg(F.coalesce(F.sum(F.when(F.col("preserved"), F.col("tokens"))), F.lit(0)).alias("_used"))
    older = marked.where("not preserved").join(used, "conv_id").select("conv_id", "turn", "tokens", (F.lit(budget) - F.col("_used")).alias("budget"), F.lit(0.0).alias("score"), F.lit(0.0).alias("recency"), F.col("turn").alias("ord"))
    fits = greedy(older, ["conv_id"]).where("chosen").select("conv_id", "turn").withColumn("_f", F.lit(True))
    return marked.join(fits, ["conv_id", "turn"], "left").withColumn("kept", F.col("preserved") | F.coalesce("_f", F.lit(False))).drop("_f")


#: White space as Unicode has it; the regex class of that name is ASCII only.
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_HEADING = rf"(?md)(^#+{BLANK}+.*$)"
_BLANK_LINES = r"(\n\n+)"


def segments(docs: DataFrame, limit: int = 500, markdown: bool = True) -> DataFrame:
    """(doc_id, segment, body, tokens): parts gathered while the estimate of the text so far stays within the limit.

    Parts end at Markdown headings, which are parts themselves, or else at runs of blank lines; a
    part is never split, so one above the limit is a segment above it. Blank parts are skipped:
    null and blank texts have no segment.
    """
    from ..functions.text import estimate_tokens

    text = F.coalesce("text", F.lit(""))
    at = _HEADING if markdown else _BLANK_LINES
    pieces = F.flatten(F.zip_with(F.split(text, at), F.regexp_extract_all(text, F.lit(at), F.lit(1)), lambda x, y: F.array(x, y)))
    parts = F.filter(pieces, lambda x: x.rlike(f"(?!{BLANK})(?s:.)"))

    def step(acc, part):
        grown = F.regexp_replace(F.concat(acc["now"], F.lit("\n"), part), rf"\A{BLANK}+|{BLANK}+\z", "")
        over = (estimate_tokens(grown) > limit) & (F.length(acc["now"]) > 0)
        return F.when(over, F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), part.alias("now"))).otherwise(F.struct(acc["done"].alias("done"), grown.alias("now")))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    folded = F.aggregate(parts, start, step, lambda acc: F.when(F.length(acc["now"]) > 0, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))
    return docs.select("doc_id", F.posexplode(folded).alias("segment", "body")).select("doc_id", "segment", "body", estimate_tokens(F.col("body")).alias("tokens"))


def extract_cases(signals: DataFrame) -> DataFrame:
    """(signal_id, case_id, account_id, entity_id) from free text; the i-th case takes the i-th account and entity, around."""
    def found(prefix):
        return F.regexp_extract_all(F.upper("text"), F.lit(rf"\b({prefix}-[A-Z0-9]+)\b"), F.lit(1))

    rows = signals.select("signal_id", F.posexplode(F.array_distinct(found("CASE"))).alias("i", "case_id"), F.array_distinct(found("ACC")).alias("a"), F.array_distinct(found("ENT")).alias("e"))

    def nth(c):
        return F.when(F.size(c) > 0, F.get(F.col(c), F.pmod("i", F.greatest(F.size(c), F.lit(1)))))

    return rows.select("signal_id", "case_id", nth("a").alias("account_id"), nth("e").alias("entity_id"))


def decide_cases(cases: DataFrame) -> DataFrame:
    """cases(sanctions, watchlist_hit, anomaly, high_risk_jurisdiction) with `route`: the first rule that holds.

    Without a screening result the match is 0.02, without a graph result the anomaly 0.35.
    """
    match, anomaly = F.coalesce("sanctions", F.lit(0.02)), F.coalesce("anomaly", F.lit(0.35))
    hit, risky = (F.coalesce(c, F.lit(False)) for c in ("watchlist_hit", "high_risk_jurisdiction"))
    return cases.withColumn(
        "route",
        F.when((match >= 0.9) | hit, "freeze_and_sar").when(anomaly >= 0.75, "sar_only").when((anomaly >= 0.45) | risky, "enhanced_due_diligence").otherwise("monitor"),
    )


def causal_compact(turns: DataFrame, budget: int, keep: int = 2) -> DataFrame:
    """turns(conv_id, turn, ts, tokens, issue_status, issue_active, is_outcome) with `kept`: the preserved ones, and older ones by causal score as far as they fit.

    An older turn's recency runs from 0 to 10 over its conversation's older turns (5 if all are
    of one time), its priority is 5; equal scores go by time.
    """
    from .packing import causal_score, greedy, score

    marked = older_turns(turns, keep)
    used = marked.groupBy("conv_id").agg(F.coalesce(F.sum(F.when(F.col("preserved"), F.col("tokens"))), F.lit(0)).alias("_used"))
    w = W.partitionBy("conv_id")
    old = marked.where("not preserved").withColumn("_low", F.min("ts").over(w)).withColumn("_span", F.max("ts").over(w) - F.col("_low"))
    recency = F.when(F.col("_span") > 0, (F.col("ts") - F.col("_low")) / F.col("_span") * 10).otherwise(5.0)
    old = old.withColumns({"priority": F.lit(5.0), "recency": recency, "salience": F.lit(0.0), "pinned": F.lit(False)}).join(used, "conv_id")
    base = old.withColumn("score", causal_score(score())).withColumn("budget", F.lit(budget) - F.col("_used")).withColumn("ord", F.col("turn"))
    fits = greedy(base.withColumn("recency", F.lit(0.0)), ["conv_id"]).where("chosen").select("conv_id", "turn").withColumn("_f", F.lit(True))
    return marked.join(fits, ["conv_id", "turn"], "left").withColumn("kept", F.col("preserved") | F.coalesce("_f", F.lit(False))).drop("_f")


def _longest(words, budget, factor: float = 1.3):
    """The most words whose estimate stays within the budget."""
    most = F.floor(budget / F.lit(factor))
    over = F.ceil((most + 1) * F.lit(factor)) <= budget
    return F.greatest(F.least(F.when(over, most + 1).otherwise(most), F.size(words)), F.lit(0)).cast("int")


def truncation_summaries(turns: DataFrame, budget: int, keep: int = 2, after: int = 5, share: float = 0.3) -> DataFrame:
    """(conv_id, turns, content, tokens): of conversations with `after` older turns or more, one text in place of them.

    It has the longest beginning in words of all older turns ("[role]: content", one a line)
    that fits `share` of what the last `keep` turns leave of the budget, less the heading; if
    all fits, their text as it is. turns(conv_id, turn, role, text, tokens). A conversation's
    texts are gathered only up to the first words that can fit: each turn sends at most as
    many as the budget allows.
    """
    from ..functions.text import estimate_tokens, trimmed

    marked = older_turns(turns, keep)
    used = marked.groupBy("conv_id").agg(F.coalesce(F.sum(F.when(F.col("preserved"), F.col("tokens"))), F.lit(0)).alias("_used"), F.count_if(~F.col("preserved")).alias("turns")).where(F.col("turns") >= after)
    room = F.floor((F.lit(budget) - F.col("_used")) * share)
    head = F.concat(F.lit("[Summary of "), F.col("turns").cast("string"), F.lit(" earlier turns]\n"))
    used = used.withColumn("_head", head).withColumn("_room", F.greatest(room - estimate_tokens(head), F.lit(0)))
    line = F.concat(F.lit("["), F.col("role"), F.lit("]: "), F.coalesce("text", F.lit("")))
    # a turn that begins beyond the words that can fit is not needed; the first one beyond shows that more follow
    old = marked.where("not preserved").withColumn("_line", line).withColumn("_n", F.size(F.split(F.col("_line"), r"\s+")))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    near = old.withColumn("_before", before).join(used, "conv_id").where(F.col("_before") <= F.col("_room"))
    whole = near.groupBy("conv_id", "turns", "_head", "_room").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "_line"))), lambda x: x["_line"]), "\n").alias("_all"), F.count("*").alias("_got"))
    words = F.split(F.col("_all"), r"\s+")
    fits = (F.col("_got") == F.col("turns")) & (estimate_tokens(F.col("_all")) <= F.col("_room"))
    body = F.when(fits, F.col("_all")).otherwise(F.array_join(F.slice(words, F.lit(1), _longest(words, F.col("_room"))), " "))
    content = F.concat(F.col("_head"), body)
    return whole.select("conv_id", "turns", content.alias("content"), estimate_tokens(content).alias("tokens")).where(trimmed(F.col("content")) != "")


def batches(turns: DataFrame, keep: int = 2, size: int = 5) -> DataFrame:
    """(conv_id, batch, turns, text): the older turns in batches of `size`, as a summarizer gets them."""
    old = older_turns(turns, keep).where("not preserved")
    nth = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1
    line = F.concat(F.lit("["), F.col("role"), F.lit("]: "), F.coalesce("text", F.lit("")))
    dealt = old.withColumn("batch", F.floor(nth / size)).withColumn("_line", line)
    lines = F.array_sort(F.collect_list(F.struct("turn", "_line")))
    return dealt.groupBy("conv_id", "batch").agg(F.count("*").alias("turns"), F.array_join(F.transform(lines, lambda x: x["_line"]), "\n").alias("text"))


def summarized(batched: DataFrame, summarize) -> DataFrame:
    """batches() with `summary`, an expression of the text; where it is null or blank, the text's first 120 characters."""
    from ..functions.text import trimmed

    made = summarize(F.col("text"))
    return batched.withColumn("summary", F.when(trimmed(F.coalesce(made, F.lit(""))) != "", made).otherwise(F.substring("text", 1, 120)))


def summarized_at_once(batched: DataFrame, summarize, tokens: int) -> DataFrame:
    """batches() with `summary` by a model that gets the texts of many batches in one call, with `tokens` for each; where it gives none that fits, the text's first 120 characters."""
    from ..functions.hooks import summaries

    made = summaries(batched.withColumn("_room", F.lit(tokens)), "text", "_room", summarize)
    return made.withColumn("summary", F.when(F.trim(F.coalesce("summary", F.lit(""))) != "", F.col("summary")).otherwise(F.substring("text", 1, 120))).drop("_room", "summary_tokens")


def rolling_summaries(turns: DataFrame, trigger: int = 18, keep: int = 6, tokens: int = 256, snippet: int = 140) -> DataFrame:
    """(conv_id, folded, summary) of conversations with more than `trigger` turns: all but the last `keep`, one line each, clipped to the tokens (quarters of a character).

    Lines beyond the clip are not gathered.
    """
    from ..functions.text import trimmed, truncated

    w = W.partitionBy("conv_id")
    n, back = F.count("*").over(w), F.row_number().over(w.orderBy(F.col("turn").desc()))
    old = turns.withColumn("_n", n).withColumn("_b", back).where((F.col("_n") > trigger) & (F.col("_b") > keep))
    text = F.regexp_replace(trimmed(F.coalesce("text", F.lit(""))), r"\s+", " ")
    clipped = F.when(F.length(text) > snippet, F.concat(F.regexp_replace(F.substring(text, 1, snippet - 3), r"\s+$", ""), F.lit("..."))).otherwise(text)
    role = F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("note")
    lines = old.withColumn("_line", F.concat(F.lit("- "), role, F.lit(": "), clipped)).withColumn("_before", F.coalesce(F.sum(F.length("_line") + 1).over(w.orderBy("turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    near = lines.where(F.col("_before") <= 4 * tokens)
    joined = near.groupBy("conv_id").agg((F.max("_n") - keep).alias("folded"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "_line"))), lambda x: x["_line"]), "\n").alias("_t"))
    return joined.select("conv_id", "folded", truncated(F.concat(F.lit("Conversation highlights:\n"), F.col("_t")), F.lit(tokens)).alias("summary"))


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, dropped, summary) of turns(conv_id, turn, role, text, kept): a line for each dropped one, of its first 120 characters."""
    text = F.coalesce("text", F.lit(""))
    preview = F.when(F.length(text) > 120, F.concat(F.substring(text, 1, 120), F.lit("..."))).otherwise(text)
    gone = turns.where("not kept").withColumn("_line", F.concat(F.lit("- ["), F.col("role"), F.lit("]: "), preview))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "_line"))), lambda x: x["_line"]), "\n")
    made = gone.groupBy("conv_id").agg(F.count("*").alias("dropped"), lines.alias("_l"))
    return made.select("conv_id", "dropped", F.concat(F.lit("Earlier conversation ("), F.col("dropped").cast("string"), F.lit(" messages, summarized):\n"), F.col("_l")).alias("summary"))


def reassembled(turns: DataFrame, summaries: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the kept turns in order, with the conversation's summary before the first that is not the system's."""
    kept = turns.where("kept").select("conv_id", "turn", "role", "text")
    first = kept.where("role <> 'system'").groupBy("conv_id").agg(F.min("turn").alias("turn"))
    head = F.concat(F.lit("[Context summary of "), F.col("dropped").cast("string"), F.lit(" earlier messages]: "), F.col("summary"))
    added = first.join(summaries, "conv_id").select("conv_id", "turn", F.lit(0).alias("_o"), F.lit("system").alias("role"), head.alias("text"))
    rows = added.unionByName(kept.withColumn("_o", F.lit(1)))
    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "_o")) - 1
    return rows.select("conv_id", at.alias("position"), "role", "text")


def intercept(turns: DataFrame, budget: int) -> DataFrame:
    """turns(conv_id, turn, role, tokens) with `kept`: conversations that fit stay whole, the others are packed by message priority and recency."""
    from .packing import greedy, score

    ranked = message_priority(turns).withColumn("salience", F.lit(0.0)).withColumn("score", score())
    total = turns.groupBy("conv_id").agg(F.sum("tokens").alias("_t"))
    packed = greedy(ranked.withColumn("budget", F.lit(budget).cast("long")).withColumn("ord", F.col("turn")), ["conv_id"])
    return packed.join(total, "conv_id").withColumn("kept", F.col("chosen") | (F.col("_t") <= budget)).drop("_t", "chosen", "budget", "ord")


def abstentions(packed: DataFrame, packs: DataFrame, least: float = 0.4) -> DataFrame:
    """(pack_id, best, message) of packs whose best chosen priority is below `least`; packs without items have best 0."""
    best = packs.select("pack_id").join(packed.groupBy("pack_id").agg(F.max("priority").alias("best")), "pack_id", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    return best.where(F.col("best") < least).withColumn("message", F.lit("I abstain: insufficient evidence to answer."))


def handoffs(decided: DataFrame, source: str, target: str | None = None) -> DataFrame:
    """(source_agent, target_agent, pack_id, budget, items): one row a pack, its chosen items by ord; what import_handoffs() reads."""
    items = F.array_sort(F.collect_list(F.when(F.col("chosen"), F.struct("ord", "id", "tokens"))))
    made = decided.groupBy("pack_id").agg(F.max("budget").alias("budget"), items.alias("items"))
    return made.select(F.lit(source).alias("source_agent"), F.lit(target).cast("string").alias("target_agent"), "pack_id", "budget", "items")


def import_handoffs(rows: DataFrame) -> DataFrame:
    """The items and budgets of handoffs(), as items(pack_id, budget, ord, id, tokens)."""
    return rows.select("pack_id", "budget", F.explode("items").alias("i")).select("pack_id", "budget", "i.*")
