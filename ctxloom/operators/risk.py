"""Risk engines: a signal's readings, their defaults, one weighted risk, and the first route whose condition holds.

An engine is data: SQL expressions over its readings, which Catalyst compiles like any other
columns. Readings that no source gave are null and take the engine's default.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Engine:
    #: readings and their defaults; a default may be an expression over readings before it
    readings: dict[str, str]
    #: yes-or-no readings, no where they are null
    marks: tuple[str, ...]
    #: the risk is the sum of these, at most 1
    risk: tuple[str, ...]
    #: (route, condition, priority, confidence); the first that holds
    routes: tuple[tuple[str, str, str, float], ...]
    #: what follows from readings, before the risk
    derived: dict[str, str] = field(default_factory=dict)
    #: confidence and priority where no route's condition holds
    calm: tuple[str, float] = ("low", 0.68)


# Readings, weights, limits, routes.
ENGINES = {
    "supply_chain": Engine(
        {"observed_delay_hours": "0", "lane_delay": "observed_delay_hours", "supplier_risk": "0.4", "capacity": "0.7"},
        (),
        ("supplier_risk",),
        (
            ("hold_review", "supplier_risk >= 0.85", "urgent", 0.9),
            ("reroute", "lane_delay >= 18", "urgent", 0.86),
            ("split_order", "capacity <= 0.45", "high", 0.82),
            ("expedite", "lane_delay >= 8", "normal", 0.75),
        ),
        calm=("case when lane_delay > 24 or supplier_risk > 0.7 then 'high' else 'low' end", 0.65),
    ),
    "pharmacovigilance": Engine(
        {"observed_cases": "0", "serious_rate": "0.25", "fatal_cases": "0", "lot_deviation": "0.1", "cases": "observed_cases"},
        (),
        ("serious_rate * 0.55", "lot_deviation * 0.30", "least(1.0, cases / 200) * 0.15", "case when fatal_cases >= 1 then 0.2 else 0 end"),
        (
            ("lot_hold_and_report", "risk >= 0.82 or fatal_cases >= 1", "urgent", 0.9),
            ("urgent_medical_review", "risk >= 0.55", "high", 0.84),
            ("enhanced_monitoring", "risk >= 0.35", "normal", 0.76),
        ),
    ),
    "clinical": Engine(
        {
            "observed_occupancy": "0", "occupancy": "84", "staffed_ratio": "0.76", "backlog": "26", "diversion": "0.44", "acuity": "0.42", "deteriorating": "7", "blockers": "0.46", "surge": "0.48",
            "boarding_hours": "3", "waiting": "20",
        },
        ("acute", "diverting", "hinted"),
        (
            "least(1.0, occupied / 100) * 0.20", "diversion * 0.14", "acuity * 0.18", "(1 - staffed_ratio) * 0.08", "least(1.0, backlog / 80) * 0.08", "blockers * 0.10", "surge * 0.07",
            "least(1.0, boarding_hours / 24) * 0.07", "least(1.0, waiting / 120) * 0.05", "least(1.0, deteriorating / 30) * 0.03",
            "case when hinted then 0.05 else 0 end", "case when acute then 0.08 else 0 end", "case when diverting then 0.08 else 0 end",
        ),
        (
            ("critical_capacity_command", "risk >= 0.84 or (occupied >= 92 and (acute or diverting))", "urgent", 0.9),
            ("surge_flow_stabilization", "risk >= 0.60 or boarding_hours >= 8", "high", 0.84),
            ("flow_optimization", "risk >= 0.36", "normal", 0.76),
        ),
        {"occupied": "greatest(occupancy, observed_occupancy)"},
    ),
    "emergency": Engine(
        {
            "observed_minutes": "180", "observed_people": "0", "severity": "0.30", "spread": "0.30", "weather": "0.25", "minutes": "observed_minutes", "logistics_people": "0", "sites": "0", "shelter": "0.72", "access": "0.70",
        },
        ("mandatory", "vulnerable"),
        (
            "severity * 0.30", "spread * 0.16", "weather * 0.06", "(1 - access) * 0.12", "(1 - shelter) * 0.12", "least(1.0, people / 600000) * 0.10", "least(1.0, spots / 8) * 0.08",
            "(1 - least(1.0, greatest(0.0, minutes) / 240)) * 0.08", "case when mandatory then 0.08 else 0 end",
        ),
        (
            ("full_evacuation_activation", "risk >= 0.82 or (mandatory and (severity >= 0.55 or spots >= 2 or people >= 150000))", "urgent", 0.9),
            ("staged_evacuation_and_shelter", "risk >= 0.62 or (people >= 150000 and (shelter <= 0.50 or access <= 0.35))", "high", 0.84),
            ("targeted_alert_and_preposition", "risk >= 0.40 or severity >= 0.48", "normal", 0.78),
        ),
        {"people": "greatest(observed_people, logistics_people)", "spots": "case when vulnerable and sites <= 0 then 1 else sites end"},
    ),
    "grid_outage": Engine(
        {"observed_minutes": "90", "observed_customers": "0", "instability": "0.25", "minutes": "observed_minutes", "customers": "0", "sites": "0", "hospitals": "case when hospital_hint then 1 else 0 end", "load_mw": "0"},
        ("hospital_hint", "facility_hint", "cascading"),
        (
            "instability * 0.42", "least(1.0, people / 1500000) * 0.24", "least(1.0, load_mw / 120) * 0.18", "least(1.0, minutes / 240) * 0.12", "case when hospitals > 0 then 0.08 else 0 end",
            "case when cascading then 0.06 else 0 end", "case when spots >= 3 then 0.04 else 0 end",
        ),
        (
            ("blackstart_escalation", "instability >= 0.90 or risk >= 0.82", "urgent", 0.9),
            ("controlled_load_shed", "instability >= 0.66 and (people >= 250000 or minutes >= 180 or cascading)", "high", 0.84),
            ("priority_restoration", "risk >= 0.58 or (people >= 250000 and (load_mw >= 45 or hospitals > 0 or spots >= 2))", "high", 0.82),
        ),
        {"people": "greatest(observed_customers, customers)", "spots": "case when (facility_hint or hospital_hint) and sites <= 0 then 1 else sites end"},
    ),
    "manufacturing": Engine(
        {
            "observed_drop": "0", "observed_vibration": "0", "observed_heat": "0", "yield_rate": "greatest(0.0, 1 - observed_drop)", "vibration": "least(1.0, observed_vibration / 12)",
            "heat": "least(1.0, observed_heat / 120)", "fault_rate": "0.8", "failures": "1", "overdue_days": "5",
        },
        ("firmware", "safety"),
        (
            "loss * 0.28", "vibration * 0.18", "heat * 0.16", "least(1.0, fault_rate / 5) * 0.14", "least(1.0, failures / 6) * 0.10", "least(1.0, overdue_days / 60) * 0.06",
            "case when firmware then 0.10 else 0 end", "case when safety then 0.12 else 0 end",
        ),
        (
            ("contain_and_rollback", "risk >= 0.82 or safety or (firmware and loss >= 0.16)", "urgent", 0.9),
            ("targeted_diagnostics", "risk >= 0.58 or fault_rate >= 2.5", "high", 0.84),
            ("enhanced_quality_gate", "risk >= 0.38 or loss >= 0.12", "normal", 0.76),
        ),
        {"loss": "greatest(0.0, least(1.0, 1 - yield_rate))"},
    ),
    "contract": Engine(
        {"severity": "0.36", "resistance": "0.40", "enforceability": "0.32", "acceptance": "0.60", "observed_cap": "null", "fallback_cap": "coalesce(observed_cap, 1)", "months": "24"},
        ("unlimited", "strategic", "hinted"),
        (
            "severity * 0.30", "resistance * 0.15", "enforceability * 0.14", "(1 - acceptance) * 0.10", "case when unlimited then 1 else least(1.0, cap / 4) end * 0.11", "least(1.0, months / 60) * 0.08",
            "case when hinted then 0.08 else 0 end", "case when unlimited then 0.10 else 0 end", "case when strategic then 0.08 else 0 end",
        ),
        (
            ("hardline_redline_and_exec_escalation", "risk >= 0.82 or unlimited or (cap >= 2.5 and severity >= 0.70)", "urgent", 0.9),
            ("legal_review_and_counterproposal", "risk >= 0.58", "high", 0.84),
            ("standard_counterproposal", "risk >= 0.36", "normal", 0.76),
        ),
        {"cap": "coalesce(nullif(observed_cap, 0), case when fallback_cap <= 0 then 1 else fallback_cap end)"},
    ),
    "migration": Engine(
        {
            "observed_dependencies": "0", "debt": "0.38", "blocker": "0.35", "criticality": "0.50", "failure_rate": "0.32", "dependencies": "30", "coupling": "0.42", "blast": "0.44", "readiness": "0.60",
            "age_years": "6", "outage_hours": "0",
        },
        ("unsupported", "critical", "hinted"),
        (
            "debt * 0.22", "blocker * 0.14", "criticality * 0.15", "failure_rate * 0.10", "coupling * 0.12", "blast * 0.08", "least(1.0, links / 120) * 0.10", "least(1.0, age_years / 15) * 0.04",
            "least(1.0, outage_hours / 72) * 0.03", "(1 - readiness) * 0.04", "case when hinted then 0.06 else 0 end", "case when unsupported then 0.10 else 0 end", "case when critical then 0.08 else 0 end",
        ),
        (
            ("immediate_replatform_program", "risk >= 0.84 or unsupported or (criticality >= 0.85 and outage_hours >= 24)", "urgent", 0.9),
            ("phased_strangler_with_parallel_run", "risk >= 0.58 or links >= 60 or age_years >= 8", "high", 0.84),
            ("targeted_refactor_wave", "risk >= 0.36", "normal", 0.76),
        ),
        {"links": "greatest(dependencies, observed_dependencies)"},
    ),
    "regulatory": Engine(
        {
            "observed_deadline": "150", "observed_obligations": "4", "severity": "0.35", "deadline_days": "observed_deadline", "penalty": "0.30", "obligations": "observed_obligations", "coverage": "0.70", "findings": "2",
            "evidence_days": "30",
        },
        ("enforcement",),
        (
            "severity * 0.30", "penalty * 0.22", "(1 - coverage) * 0.24", "least(1.0, findings / 12) * 0.08", "least(1.0, obligations / 20) * 0.06", "(1 - least(1.0, greatest(0.0, deadline_days) / 180)) * 0.08",
            "case when enforcement then 0.08 else 0 end", "case when evidence_days >= 90 then 0.05 else 0 end",
        ),
        (
            ("immediate_remediation_program", "risk >= 0.82 or (deadline_days <= 45 and coverage < 0.60) or (enforcement and coverage < 0.50)", "urgent", 0.9),
            ("accelerated_control_gap_closure", "risk >= 0.60 or coverage < 0.70 or evidence_days >= 90", "high", 0.84),
            ("policy_update_and_training", "risk >= 0.38", "normal", 0.76),
        ),
    ),
}


def decide(signals: DataFrame, engine: str) -> DataFrame:
    """signals with risk, route, priority and confidence.

    They have the engine's readings and marks as far as known (columns that are missing count
    as null), and `enriched`, how many of the engine's two sources answered: each that did not
    costs 0.15 of confidence.
    """
    e = ENGINES[engine]
    rows = signals
    for name in e.marks:
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(False)) if name in signals.columns else F.lit(False))
    for name, default in e.readings.items():
        given = F.col(name).cast("double") if name in signals.columns else F.lit(None).cast("double")
        rows = rows.withColumn(name, F.coalesce(given, F.expr(default).cast("double")))
    for name, what in e.derived.items():
        rows = rows.withColumn(name, F.expr(what).cast("double"))
    total = sum((F.expr(x).cast("double") for x in e.risk), F.lit(0.0))
    rows = rows.withColumn("risk", F.least(F.lit(1.0), total))
    route, priority, confidence = F.lit("monitor"), F.expr(e.calm[0]) if " " in e.calm[0] else F.lit(e.calm[0]), F.lit(e.calm[1])
    for name, condition, p, c in reversed(e.routes):
        holds = F.expr(condition)
        route, priority, confidence = F.when(holds, name).otherwise(route), F.when(holds, p).otherwise(priority), F.when(holds, c).otherwise(confidence)
    sure = F.least(F.lit(0.99), F.greatest(F.lit(0.05), confidence - (2 - F.col("enriched")) * 0.15))
    return rows.withColumns({"route": route, "priority": priority, "confidence": F.floor(sure * 1000 + 0.5) / 1000.0})
