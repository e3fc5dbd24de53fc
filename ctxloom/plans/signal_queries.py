"""Each risk engine from text to route, over a report on every document, beside SQL whose decisions are written out."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators.signals import EXTRACTORS, PORTS, route
from .model import table
from .queries import q6, r6
from .registry import query

#: A report on document k: two signals of different spelling, figures, words, and the document itself.
REPORTS = {
    "supply_chain": "'Order ORD-' || (1000 + k) || ' and order_' || (2000 + k) || ' by SUP-' || (10 + k % 7) || ' via LANE-EU-' || (100 + k % 9) || ' or sha -> ham, delay ' || (k % 40) || ' h, then ' || (k % 13) || ' hours. '",
    "pharmacovigilance": "'AE-' || (1000 + k) || ' LOT_' || (100 + k % 50) || ' rash, ' || (k % 300) || ' reports; case-' || (1000 + k) || ' drug' || (10 + k % 5) || ' seizure. PV_' || (5000 + k) || ' again. '",
    "clinical": "'Unit-' || k || ' team_' || (k % 9) || ': ' || (k % 101) || '% occupancy, ' || (k % 25) || ' hours, stroke then icu overflow. WARD_' || k || ' SPECIALTY-' || (k % 4) || ' ' || (k % 130) || ' patients' || case when k % 7 = 0 then ' code blue' else '' end || case when k % 11 = 0 then ' diversion. ' else '. ' end",
    "emergency": "'EOC-' || (100 + k) || ' zone_' || (10 + k % 30) || ', ' || (k % 97 * 3000) || ' residents, ' || (k % 300) || ' minutes, ' || case when k % 5 = 0 then 'school. ' else 'fields. ' end || 'HAZ' || (100 + k) || ' crew-' || (10 + k % 8) || ' in ' || (k % 9) || ' hours' || case when k % 6 = 0 then ', Mandatory evacuation. ' else '. ' end",
    "grid_outage": "'OUT-' || (100 + k) || ' at sub_' || (10 + k % 20) || ', ' || (k % 91 * 9000) || ' customers, ' || (k % 6) || ' hrs; ' || case when k % 4 = 0 then 'Hospital' else 'homes' end || ' dark. Event' || (100 + k) || ' fdr-' || (10 + k % 6) || ' ' || (k % 240) || ' min' || case when k % 9 = 0 then ', cascading. ' else '. ' end",
    "manufacturing": "'MFG-' || (100 + k) || ' line_' || (10 + k % 12) || ' batch ' || (k % 5) || ': ' || (k % 35) || '.5% yield drop, ' || (k % 14) || '.25 mm/s, ' || (k % 140) || ' c. FAULT' || (100 + k) || ' robot-' || (10 + k % 4) || case when k % 3 = 0 then ' firmware' else ' bearing' end || case when k % 10 = 0 then ' near miss. ' else '. ' end",
    "contract": "'MSA-' || k || ' clause_' || (k % 30) || ' vendor-' || (k % 11) || ': ' || (k % 5) || ' years, ' || (k % 6) || '.5x cap, audit rights. SOW_' || k || '-B ' || (k % 40) || ' months' || case when k % 8 = 0 then ', uncapped liability' else '' end || case when k % 3 = 0 then ', indemnity' else '' end || case when k % 5 = 0 then ', sole source. ' else '. ' end",
    "migration": "'APP-' || k || ' module_' || (k % 30) || ' owner-' || (k % 7) || ', ' || (k % 14) || ' years, ' || (k % 90) || ' dependencies, ' || case when k % 3 = 0 then 'mainframe' else 'manual release' end || '. Legacy_' || k || ' ' || (k % 50) || ' hours down' || case when k % 12 = 0 then ', end of support' else '' end || case when k % 5 = 0 then ', revenue-critical. ' else '. ' end",
    "regulatory": "'REG-' || k || ' domain_' || (k % 14) || ' team-' || (k % 6) || ': ' || (k % 200) || ' days, ' || (k % 24) || ' controls, data retention. Rule_' || k || '-A audit' || case when k % 4 = 0 then ', must comply. ' else '. ' end",
}
#: What a source knows of every second document.
KNOWN = {
    "supply_chain": {"supplier_risk": "cast(k % 100 as double) / 100", "capacity": "cast(k % 90 as double) / 100"},
    "pharmacovigilance": {"serious_rate": "cast(k % 100 as double) / 100", "fatal_cases": "case when k % 26 = 0 then 1.0 else 0.0 end"},
    "clinical": {"diversion": "cast(k % 100 as double) / 100", "acuity": "cast(k % 70 as double) / 70"},
    "emergency": {"severity": "cast(k % 100 as double) / 100", "sites": "k % 5 * 1.0"},
    "grid_outage": {"instability": "cast(k % 100 as double) / 100", "customers": "k % 70 * 5000.0"},
    "manufacturing": {"fault_rate": "cast(k % 30 as double) / 6", "failures": "k % 9 * 1.0"},
    "contract": {"severity": "cast(k % 100 as double) / 100", "resistance": "cast(k % 50 as double) / 50"},
    "migration": {"debt": "cast(k % 100 as double) / 100", "criticality": "cast(k % 40 as double) / 40"},
    "regulatory": {"severity": "cast(k % 100 as double) / 100", "coverage": "cast(k % 60 as double) / 60"},
}
# The decisions, written out: what is known of readings, the risk, the routes with priority and confidence, and both where none holds.
_DECIDED = {
    "supply_chain": (
        "coalesce(observed_delay_hours, 0) as delay, coalesce(supplier_risk, 0.4) as sr, coalesce(capacity, 0.7) as cap", "sr",
        [("sr >= 0.85", "hold_review", "'urgent'", 0.9), ("delay >= 18", "reroute", "'urgent'", 0.86), ("cap <= 0.45", "split_order", "'high'", 0.82), ("delay >= 8", "expedite", "'normal'", 0.75)],
        ("case when delay > 24 or sr > 0.7 then 'high' else 'low' end", 0.65),
    ),
    "pharmacovigilance": (
        "coalesce(serious_rate, 0.25) as sr, coalesce(fatal_cases, 0) as fatal, coalesce(observed_cases, 0) as cases", "sr * 0.55 + 0.1 * 0.30 + least(1.0, cases / 200.0) * 0.15 + case when fatal > 0 then 0.2 else 0 end",
        [("risk >= 0.9 or fatal > 0", "lot_hold_and_report", "'urgent'", 0.9), ("risk >= 0.82", "lot_hold_and_report", "'urgent'", 0.9), ("risk >= 0.55", "urgent_medical_review", "'high'", 0.84), ("risk >= 0.35", "enhanced_monitoring", "'normal'", 0.76)],
        ("'low'", 0.68),
    ),
    "clinical": (
        "greatest(84, coalesce(observed_occupancy, 0)) as occ, coalesce(boarding_hours, 3) as board, coalesce(waiting, 20) as wait, coalesce(diversion, 0.44) as dv, coalesce(acuity, 0.42) as ac, acute as hot, diverting as away, coalesce(hint in ('sepsis', 'stroke', 'trauma surge', 'respiratory failure', 'diversion'), false) as h",
        "least(1.0, occ / 100.0) * 0.20 + dv * 0.14 + ac * 0.18 + (1.0 - 0.76) * 0.08 + least(1.0, 26 / 80.0) * 0.08 + 0.46 * 0.10 + 0.48 * 0.07 + least(1.0, board / 24.0) * 0.07 + least(1.0, wait / 120.0) * 0.05 + least(1.0, 7 / 30.0) * 0.03 + case when h then 0.05 else 0 end + case when hot then 0.08 else 0 end + case when away then 0.08 else 0 end",
        [("risk >= 0.84 or (occ >= 92 and (hot or away))", "critical_capacity_command", "'urgent'", 0.9), ("risk >= 0.60 or board >= 8", "surge_flow_stabilization", "'high'", 0.84), ("risk >= 0.36", "flow_optimization", "'normal'", 0.76)],
        ("'low'", 0.68),
    ),
    "emergency": (
        "coalesce(severity, 0.30) as sev, coalesce(observed_minutes, 180) as eta, coalesce(observed_people, 0) as people, case when hint is not null and coalesce(sites, 0) <= 0 then 1 else coalesce(sites, 0) end as spots, mandatory as must",
        "sev * 0.30 + 0.30 * 0.16 + 0.25 * 0.06 + (1.0 - 0.70) * 0.12 + (1.0 - 0.72) * 0.12 + least(1.0, people / 600000.0) * 0.10 + least(1.0, spots / 8.0) * 0.08 + (1.0 - least(1.0, greatest(0, eta) / 240.0)) * 0.08 + case when must then 0.08 else 0 end",
        [("risk >= 0.82 or (must and (sev >= 0.55 or spots >= 2 or people >= 150000))", "full_evacuation_activation", "'urgent'", 0.9), ("risk >= 0.62 or (people >= 150000 and (0.72 <= 0.50 or 0.70 <= 0.35))", "staged_evacuation_and_shelter", "'high'", 0.84),
         ("risk >= 0.40 or sev >= 0.48", "targeted_alert_and_preposition", "'normal'", 0.78)],
        ("'low'", 0.68),
    ),
    "grid_outage": (
        "coalesce(instability, 0.25) as ins, coalesce(observed_minutes, 90) as eta, greatest(coalesce(observed_customers, 0), coalesce(customers, 0)) as people, case when hint = 'hospital' then 1 else 0 end as hosp, case when hint is not null then 1 else 0 end as spots, cascading as casc",
        "ins * 0.42 + least(1.0, people / 1500000.0) * 0.24 + 0 * 0.18 + least(1.0, eta / 240.0) * 0.12 + case when hosp > 0 then 0.08 else 0 end + case when casc then 0.06 else 0 end + case when spots >= 3 then 0.04 else 0 end",
        [("ins >= 0.90 or risk >= 0.82", "blackstart_escalation", "'urgent'", 0.9), ("ins >= 0.66 and (people >= 250000 or eta >= 180 or casc)", "controlled_load_shed", "'high'", 0.84), ("risk >= 0.58 or (people >= 250000 and (0 >= 45 or hosp > 0 or spots >= 2))", "priority_restoration", "'high'", 0.82)],
        ("'low'", 0.68),
    ),
    "manufacturing": (
        "greatest(0.0, least(1.0, 1 - greatest(0.0, 1 - coalesce(observed_drop, 0)))) as loss, least(1.0, coalesce(observed_vibration, 0) / 12.0) as vib, least(1.0, coalesce(observed_heat, 0) / 120.0) as heat, coalesce(fault_rate, 0.8) as fr, coalesce(failures, 1) as fails, coalesce(hint = 'firmware', false) as fw, safety as safe_",
        "loss * 0.28 + vib * 0.18 + heat * 0.16 + least(1.0, fr / 5.0) * 0.14 + least(1.0, fails / 6.0) * 0.10 + least(1.0, 5 / 60.0) * 0.06 + case when fw then 0.10 else 0 end + case when safe_ then 0.12 else 0 end",
        [("risk >= 0.82 or safe_ or (fw and loss >= 0.16)", "contain_and_rollback", "'urgent'", 0.9), ("risk >= 0.58 or fr >= 2.5", "targeted_diagnostics", "'high'", 0.84), ("risk >= 0.38 or loss >= 0.16 * 0.75", "enhanced_quality_gate", "'normal'", 0.76)],
        ("'low'", 0.68),
    ),
    "contract": (
        "coalesce(severity, 0.36) as sev, coalesce(resistance, 0.40) as res, coalesce(months, 24) as term, coalesce(observed_cap, 1.0) as cap, unlimited as unl, strategic as strat, coalesce(hint in ('unlimited liability', 'broad data use rights', 'indemnity'), false) as h",
        "sev * 0.30 + res * 0.15 + 0.32 * 0.14 + (1.0 - 0.60) * 0.10 + case when unl then 1.0 else least(1.0, cap / 4.0) end * 0.11 + least(1.0, term / 60.0) * 0.08 + case when h then 0.08 else 0 end + case when unl then 0.10 else 0 end + case when strat then 0.08 else 0 end",
        [("risk >= 0.82 or unl or (cap >= 2.5 and sev >= 0.70)", "hardline_redline_and_exec_escalation", "'urgent'", 0.9), ("risk >= 0.58", "legal_review_and_counterproposal", "'high'", 0.84), ("risk >= 0.36", "standard_counterproposal", "'normal'", 0.76)],
        ("'low'", 0.68),
    ),
    "migration": (
        "coalesce(debt, 0.38) as td, coalesce(criticality, 0.50) as crit, greatest(30, coalesce(observed_dependencies, 0)) as deps, coalesce(age_years, 6) as age, coalesce(outage_hours, 0) as down, unsupported as uns, critical as mc, coalesce(hint in ('mainframe', 'eol runtime', 'shared database', 'single point of failure'), false) as h",
        "td * 0.22 + 0.35 * 0.14 + crit * 0.15 + 0.32 * 0.10 + 0.42 * 0.12 + 0.44 * 0.08 + least(1.0, deps / 120.0) * 0.10 + least(1.0, age / 15.0) * 0.04 + least(1.0, down / 72.0) * 0.03 + (1.0 - 0.60) * 0.04 + case when h then 0.06 else 0 end + case when uns then 0.10 else 0 end + case when mc then 0.08 else 0 end",
        [("risk >= 0.84 or uns or (crit >= 0.85 and down >= 24)", "immediate_replatform_program", "'urgent'", 0.9), ("risk >= 0.58 or deps >= 60 or age >= 8", "phased_strangler_with_parallel_run", "'high'", 0.84), ("risk >= 0.36", "targeted_refactor_wave", "'normal'", 0.76)],
        ("'low'", 0.68),
    ),
    "regulatory": (
        "coalesce(severity, 0.35) as sev, coalesce(coverage, 0.70) as cov, coalesce(observed_deadline, 150) as days, coalesce(observed_obligations, 4) as obl, enforcement as enf",
        "sev * 0.30 + 0.30 * 0.22 + (1.0 - cov) * 0.24 + least(1.0, 2 / 12.0) * 0.08 + least(1.0, obl / 20.0) * 0.06 + (1.0 - least(1.0, greatest(0, days) / 180.0)) * 0.08 + case when enf then 0.08 else 0 end",
        [("risk >= 0.82 or (days <= 45 and cov < 0.60) or (enf and cov < 0.50)", "immediate_remediation_program", "'urgent'", 0.9), ("risk >= 0.60 or cov < 0.70 or 30 >= 90", "accelerated_control_gap_closure", "'high'", 0.84), ("risk >= 0.38", "policy_update_and_training", "'normal'", 0.76)],
        ("'low'", 0.68),
    ),
}


def _sql(engine: str) -> str:
    e = EXTRACTORS[engine]
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    name = "upper(replace(trim({}), '_', '-'))".format
    nth = "({0})[least(i + 1, len({0}))]".format
    columns = []
    for c, (p, none) in e.ids.items():
        group = int("([A-Za-z0-9]{1,8})" in p)
        said = (lambda x: f"'SHIFT-' || upper({x})") if group else name
        found = f"list_transform(regexp_extract_all(text, {quote(p)}, {group}), lambda x: {said('x')})"
        if e.around:
            if c == "lane":
                found = rf"list_concat({found}, list_transform(regexp_extract_all(upper(text), {quote(PORTS)}), lambda x: replace(regexp_replace(x, '\s+', '', 'g'), 'TO', '->')))"
            # each different one where it stands first
            once = f"list_filter({found}, lambda y, j: list_position({found}, y) = j)"
            columns.append(f"coalesce(({once})[1 + i % greatest(1, len({once}))], '{none}') as {c}")
        else:
            near = f"nullif(regexp_extract(part, {quote(p)}, {group}), '')"
            columns.append(f"coalesce({said(near)}, {nth(found)}, '{none}') as {c}")
    for c, patterns in e.figures.items():
        worth = {0.01: "{}::double / 100", 60: "{}::double * 60", 12: "{}::double * 12", 1: "{}::double"}
        lists = [f"list_transform(regexp_extract_all(text, {quote(p)}, 1), lambda x: {worth[one].format('x')})" for p, one in patterns]
        everywhere = lists[0] if len(lists) == 1 else f"list_concat({', '.join(lists)})"
        near = ", ".join(worth[one].format(f"nullif(regexp_extract(part, {quote(p)}, 1), '')") for p, one in patterns)
        columns.append(f"nullif(list_max({everywhere}), 0) as {c}" if e.around else f"nullif(coalesce({near}, {nth(everywhere)}), 0) as {c}")
    if e.hint:
        every = f"regexp_extract_all({{}}, {quote(e.hint)})"
        columns.append(f"lower(coalesce({every.format('part')}[{-1 if e.last_hint else 1}], {nth(every.format('text'))})) as hint")
    columns += [f"regexp_matches(text, {quote(p)}) as {c}" for c, p in e.flags.items()]
    given, risk, routes, calm = _DECIDED[engine]
    # figures as doubles: decimals would round otherwise than the columns do
    given, risk = (re.sub(r"\b\d+\.\d+\b", r"\g<0>::double", x) for x in (given, risk))
    known = ", ".join(f"case when k % 2 = 0 then ({x})::double end as {c}" for c, x in KNOWN[engine].items())
    case = lambda i: "case " + " ".join(f"when {r[0]} then {r[i] if i != 1 else repr(r[1])}" for r in routes)
    sure = f"{case(3)} else {calm[1]} end"
    ids = ", ".join(e.ids)
    return f"""with x as (select k, ({REPORTS[engine]}) || coalesce(text, '') as text from (select doc_id as k, text from documents)),
r as (select k, text, regexp_extract_all(text, {quote(e.own)}) as runs, regexp_split_to_array(text, {quote(e.own)}) as gaps from x),
n as (select *, list_transform(runs, lambda x: {name('x')}) as ids from r),
s as (select k, text, case when len(runs) = 0 then [{{'id': '{e.prefix}' || upper(left(sha256(text), 8)), 'part': ''}}] else
list_filter(list_transform(range(1, len(runs) + 1), lambda j: {{'id': ids[j], 'part': runs[j] || gaps[j + 1]}}), lambda y, j: list_position(ids, y.id) = j)[1:20] end as s from n),
u as (select k, text, i, s.id as signal_id, s.part as part from (select k, text, unnest(range(len(s))) as i, unnest(s) as s from s)),
v as (select k, i, signal_id, {', '.join(columns)}, {known} from u),
g as (select k, i, signal_id, {ids}, {given} from v), w as (select *, least(1.0::double, ({risk})::double) as risk from g)
select k as doc_id, i::int as signal, signal_id, {ids}, {r6('risk')} as risk, {case(1)} else 'monitor' end as route, {case(2)} else {calm[0]} end as priority,
floor(least(0.99::double, greatest(0.05::double, ({sure})::double - (case when k % 2 = 0 then 1 else 2 end) * 0.15::double)) * 1000 + 0.5) / 1000.0::double as confidence from w"""


def _register(engine: str) -> None:
    def run(spark, d):
        docs = table(spark, d, "documents").select(F.col("doc_id").alias("k"), "text")
        reports = docs.select("k", F.concat(F.expr(REPORTS[engine]), F.coalesce("text", F.lit(""))).alias("text"))
        known = docs.where("k % 2 = 0").select("k", *[F.expr(x).cast("double").alias(c) for c, x in KNOWN[engine].items()])
        out = route(reports, engine, [(known, "k")])
        return out.select(F.col("k").alias("doc_id"), F.col("signal").cast("int").alias("signal"), "signal_id", *EXTRACTORS[engine].ids, q6(F.col("risk")).alias("risk"), "route", "priority", "confidence")

    run.__name__ = f"text_to_route_{engine}"
    query(_sql(engine))(run)


for _name in REPORTS:
    _register(_name)
