"""Signals from texts, and from texts to routes, against figures worked out by hand."""

import hashlib

import pytest

from ctxloom.operators import signals as S


def found(spark, engine, *texts):
    rows = S.extract(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, text string"), engine).orderBy("k", "signal").collect()
    return [r.asDict() for r in rows]


def test_parts_then_the_whole_text(spark):
    text = "icu-7 sepsis 95% occupancy. ward_9 then TEAM-1, 12 hours, 40 patients. ICU-7 diversion. team-2 stroke"
    a, b = found(spark, "clinical", text)
    assert (a["signal_id"], b["signal_id"]) == ("ICU-7", "WARD-9")
    # the first has its own occupancy and hint; hours, patients and team come from the whole text
    assert (a["observed_occupancy"], a["boarding_hours"], a["waiting"], a["hint"], a["team"]) == (95, 12, 40, "sepsis", "TEAM-1")
    # the second's part ends where the id of the first stands again; it has no hint: the second of the text
    assert (b["observed_occupancy"], b["hint"], b["team"], b["service_line"]) == (95, "diversion", "TEAM-1", "LINE-AUTO-01")
    assert a["diverting"] and b["diverting"] and not a["acute"] and a["hinted"]


def test_last_hint_of_a_part_counts_only_where_it_should(spark):
    assert found(spark, "clinical", "UNIT-1 sepsis then stroke")[0]["hint"] == "stroke"
    assert found(spark, "contract", "MSA-1 indemnity, audit rights")[0]["hint"] == "indemnity"


def test_units_and_zero(spark):
    a, b, c = found(spark, "grid_outage", "OUT-11 2 hours; EVENT-22 30 min. inc-33 0 minutes, 5 accounts")
    # whole text: minutes first, then hours
    assert (a["observed_minutes"], b["observed_minutes"], c["observed_minutes"]) == (120, 30, None)
    assert a["observed_customers"] == 5
    drop = found(spark, "manufacturing", "MFG-11 12.5% yield drop, 3 ips, shift B2 firmware")[0]
    assert (drop["observed_drop"], drop["observed_vibration"], drop["shift"], drop["firmware"]) == (0.125, 3, "SHIFT-B2", True)
    assert found(spark, "contract", "AGR-1 3 years, 2.5x")[0]["months"] == 36


@pytest.mark.parametrize("engine", list(S.EXTRACTORS))
def test_texts_without_an_id(spark, engine):
    rows = found(spark, engine, None, "", "nothing to see")
    for r, t in zip(rows, ["", "", "nothing to see"], strict=True):
        assert r["signal_id"] == S.EXTRACTORS[engine].prefix + hashlib.sha256(t.encode()).hexdigest()[:8].upper()
        assert all(r[c] == none for c, (_, none) in S.EXTRACTORS[engine].ids.items()) and all(r[c] is None for c in S.EXTRACTORS[engine].figures)
    assert S.extract(spark.createDataFrame([], "text string"), engine).count() == 0


def test_orders_go_around_and_delays_are_the_longest(spark):
    rows = found(spark, "supply_chain", "ORD-100, order_200 and ORD-300 by sup-11 or sup_22, LANE-ABC, sha to ham, 5 h and 20 hours")
    assert [(r["supplier"], r["lane"], r["observed_delay_hours"]) for r in rows] == [("SUP-11", "LANE-ABC", 20), ("SUP-22", "SHA->HAM", 20), ("SUP-11", "LANE-ABC", 20)]


def test_no_more_signals_than_asked_for(spark):
    text = " ".join(f"REG-{i}" for i in range(30)) + " REG-3"
    assert [r["signal_id"] for r in found(spark, "regulatory", text)] == [f"REG-{i}" for i in range(20)]


def test_text_to_route(spark):
    docs = spark.createDataFrame([(1, "WARD-1 95% occupancy, code blue"), (2, "WARD-2 10 hours"), (3, "WARD-3 quiet")], "k long, text string")
    known = spark.createDataFrame([("WARD-3", 0.1, 0.1)], "signal_id string, diversion double, acuity double")
    rows = {r["k"]: r for r in S.route(docs, "clinical", [(known, "signal_id")]).collect()}
    assert rows[1]["route"] == "critical_capacity_command" and rows[1]["confidence"] == 0.6
    assert rows[2]["route"] == "surge_flow_stabilization" and rows[2]["priority"] == "high"
    base = 84 / 100 * 0.20 + 0.1 * 0.14 + 0.1 * 0.18 + 0.24 * 0.08 + 26 / 80 * 0.08 + 0.46 * 0.10 + 0.48 * 0.07 + 3 / 24 * 0.07 + 20 / 120 * 0.05 + 7 / 30 * 0.03
    assert abs(rows[3]["risk"] - base) < 1e-12 and rows[3]["route"] == "monitor" and rows[3]["confidence"] == 0.53


def test_words_end_where_ascii_words_end(spark):
    # a letter beyond ASCII parts words, a vertical tab is no blank, a long s is an s: as RE2 reads the same patterns
    drop = found(spark, "manufacturing", "éMFG-11 12 für, FAULT-77é")
    assert [(r["signal_id"], r["observed_heat"]) for r in drop] == [("MFG-11", 12.0), ("FAULT-77", 12.0)]
    assert found(spark, "manufacturing", "MFG-11 12\x0bc")[0]["observed_heat"] is None
    case = found(spark, "pharmacovigilance", "case123é with 7 report\u017f")[0]
    assert (case["signal_id"], case["observed_cases"]) == ("CASE123", 7)
    assert found(spark, "pharmacovigilance", "AE-999 drug\u212a1")[0]["compound"] == "DRUG\u212a1"
    assert found(spark, "emergency", "INC-55é")[0]["signal_id"] == "INC-55"


def test_a_text_is_read_once_for_all_its_signals(spark):
    docs = spark.createDataFrame([(1, "MFG-11 line_12 5 ips")], "k long, text string")
    plan = S.extract(docs, "manufacturing")._jdf.queryExecution().optimizedPlan().toString()
    # own ids, three other ids, three figures and hints, each once
    assert plan.count("regexp_extract_all(") == 8
