"""One query for each risk engine, over orders as signals, beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.risk import ENGINES, decide
from .model import table
from .queries import q6, r6
from .registry import query

#: How large a reading gets that is not a share.
MOST = {
    "observed_delay_hours": 40, "lane_delay": 40, "observed_cases": 300, "cases": 300, "fatal_cases": 1.02, "observed_occupancy": 100, "occupancy": 100, "backlog": 100, "deteriorating": 40, "boarding_hours": 30, "waiting": 150,
    "observed_minutes": 300, "minutes": 300, "observed_people": 400000, "logistics_people": 400000, "sites": 9, "observed_customers": 900000, "customers": 900000, "hospitals": 3, "load_mw": 150, "observed_vibration": 15,
    "observed_heat": 150, "fault_rate": 6, "failures": 8, "overdue_days": 80, "observed_cap": 5, "fallback_cap": 5, "months": 72, "observed_dependencies": 150, "dependencies": 150, "age_years": 18, "outage_hours": 90,
    "observed_deadline": 250, "deadline_days": 250, "observed_obligations": 25, "obligations": 25, "findings": 15, "evidence_days": 120,
}


def _register(name: str) -> None:
    e = ENGINES[name]
    readings = [f"case when (k + {i}) % 6 = 0 then null else ((k * {i + 3}) % 101) / 100.0 * {MOST.get(c, 1)} end::double as {c}" for i, c in enumerate(e.readings)]
    marks = [f"(k + {i}) % {i + 5} = 0 as {c}" for i, c in enumerate(e.marks)]
    steps = [f"s0 as (select k, k % 3 as enriched, {', '.join(readings + marks)} from (select o_orderkey as k from orders))"]
    for c, default in e.readings.items():
        steps.append(f"s{len(steps)} as (select * replace (coalesce({c}, ({default})::double) as {c}) from s{len(steps) - 1})")
    for c, what in e.derived.items():
        steps.append(f"s{len(steps)} as (select *, ({what})::double as {c} from s{len(steps) - 1})")
    total = " + ".join(f"({x})::double" for x in e.risk)
    steps.append(f"s{len(steps)} as (select *, least(1.0::double, 0.0::double + {total}) as risk from s{len(steps) - 1})")
    case = "case " + " ".join(f"when {c} then {{}}" for _, c, _, _ in e.routes) + " else {} end"
    route = case.format(*[f"'{r}'" for r, _, _, _ in e.routes], "'monitor'")
    calm = e.calm[0] if " " in e.calm[0] else f"'{e.calm[0]}'"
    priority = case.format(*[f"'{p}'" for _, _, p, _ in e.routes], calm)
    sure = case.format(*[f"{c}::double" for _, _, _, c in e.routes], f"{e.calm[1]}::double")
    sql = f"with {', '.join(steps)} select k as o_orderkey, {r6('risk')} as risk, {route} as route, {priority} as priority, floor(least(0.99::double, greatest(0.05::double, {sure} - (2 - enriched) * 0.15::double)) * 1000 + 0.5) / 1000.0::double as confidence from s{len(steps) - 1}"

    def run(spark, d):
        k = F.col("k")
        rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
        given = [F.when((k + i) % 6 != 0, ((k * (i + 3)) % 101) / 100.0 * MOST.get(c, 1)).cast("double").alias(c) for i, c in enumerate(e.readings)]
        said = [((k + i) % (i + 5) == 0).alias(c) for i, c in enumerate(e.marks)]
        out = decide(rows.select("k", (k % 3).alias("enriched"), *given, *said), name)
        return out.select(k.alias("o_orderkey"), q6(F.col("risk")).alias("risk"), "route", "priority", "confidence")

    run.__name__ = f"risk_{name}"
    query(sql)(run)


for _name in ENGINES:
    _register(_name)
