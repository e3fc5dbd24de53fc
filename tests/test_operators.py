"""Goldens and brute force of library operators that SQL on the test tables does not reach."""

import json
import math
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.functions import hooks as H
from ctxloom.functions import text as T
from ctxloom.operators import compiler as K
from ctxloom.operators import conversations as C
from ctxloom.operators import immune as I
from ctxloom.operators import issues as B
from ctxloom.operators import memory as Y
from ctxloom.operators import monitoring as M
from ctxloom.operators import packing as P
from ctxloom.operators import quality as Q
from ctxloom.operators import retrieval as R
from ctxloom.operators import risk
from ctxloom.operators import extended_pack as XP
from ctxloom.operators import segmentation as G
from ctxloom.operators import sets as S
from ctxloom.sources import records as X
from ctxloom.streaming import drift as D


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# scalars

def mulberry(seed, n):
    """The published generator, with 32-bit arithmetic spelled out."""
    out, state, m = [], seed & 0xFFFFFFFF, 0xFFFFFFFF
    for _ in range(n):
        state = (state + 0x6D2B79F5) & m
        t = ((state ^ (state >> 15)) * (1 | state)) & m
        t = ((t + ((t ^ (t >> 7)) * (61 | t))) & m) ^ t
        out.append((t ^ (t >> 14)) / 4294967296)
    return out


def test_draws_are_the_published_ones(spark):
    for seed in (0, 42, 2**31 - 1, -5):
        got = [r["x"] for r in spark.range(1, 6).select(T.random32(F.lit(seed), F.col("id")).alias("x"), "id").orderBy("id").collect()]
        assert got == mulberry(seed, 5)


@pytest.mark.parametrize("text,topic,opposite", [
    ("# Use caching. More", "Use caching", "avoid caching"), ("always test\nx", "always test", "never test"), ("plain thing", "plain thing", "not plain thing"), ("  ## x", "## x", "not ## x"), ("", "", "not "),
])
def test_topic_and_opposite(spark, text, topic, opposite):
    assert (one(spark, T.topic(F.lit(text))), one(spark, T.opposite(F.lit(text)))) == (topic, opposite)


def test_effective_budgets(spark):
    assert one(spark, T.effective_budget(F.lit(200000.0), "claude")) == 140000 and one(spark, T.effective_budget(F.lit(128000.0), "gpt4")) == 83200


def test_protected_zones(spark):
    text = "see 2024-01-31 and HttpServer v1.2.3 by MAX_LEN now"
    zones = [(r["start"], r["end"]) for r in one(spark, T.protected_zones(F.lit(text)))]
    assert [text[a:b] for a, b in zones] == ["2024-01-31", "HttpServer", "v1.2.3", "MAX_LEN"]
    safe = T.safe_cut(T.protected_zones(F.lit(text)), F.lit(6))
    assert one(spark, safe) is False and one(spark, T.safe_cut(T.protected_zones(F.lit(text)), F.lit(4))) is True
    assert [tuple(z) for z in one(spark, T.protected_zones(F.lit("by Bob now"), ["Bob"]))] == [(3, 6)]


def test_tokens_by_a_given_encoding(spark):
    class Letters:
        def encode_ordinary(self, t):
            return list(t)

    df = spark.createDataFrame([("abc",), (" ",), (None,)], "t string")
    assert [r["n"] for r in df.select(T.bpe_tokens(F.col("t"), Letters()).alias("n")).collect()] == [3, 0, 0]


def test_small_scalars(spark):
    assert one(spark, T.perplexity(F.array(F.lit(-1.0), F.lit(-3.0)))) == pytest.approx(math.exp(2))
    assert one(spark, T.quotes(F.lit("A  b"), F.lit("x a b y"))) is True and one(spark, T.quotes(F.lit(" "), F.lit("x"))) is False
    assert one(spark, T.segment_text(F.lit("c"), F.lit(0), F.lit(2), F.lit("d"))) == "[Segment 1/2 of 'd']\nc\n[...CONTINUED IN NEXT SEGMENT...]"
    assert one(spark, T.truncated(F.lit("abcdefghij"), F.lit(2))) == "abcde..." and one(spark, T.truncated(F.lit("ab"), F.lit(2))) == "ab"
    assert one(spark, T.embedding_relevance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-1.0), F.lit(0.0)))) == 0.0


# packing

def brute_extended(rows, budget, boost, redundancy):
    gone = {r["supersedes"] for r in rows if r["supersedes"]}
    pool = [r for r in rows if r["id"] not in gone]
    out, ids, vectors, left = {r["id"]: "negated_by_newer_info" for r in rows if r["id"] in gone}, set(), [], budget
    while pool:
        def rank(r):
            return (-(r["score"] + boost * len(ids & set(r["links"] or ()))), -r["recency"], r["ord"])

        r = min(pool, key=rank)
        pool.remove(r)
        v = np.array(r["embedding"]) / np.linalg.norm(r["embedding"]) if r["embedding"] else None
        if r["parent_id"] in ids:
            out[r["id"]] = "parent_already_included"
        elif redundancy is not None and v is not None and any(float(x @ v) > redundancy for x in vectors):
            out[r["id"]] = "semantic_redundancy"
        elif r["tokens"] > left:
            out[r["id"]] = "over_budget"
        else:
            left -= r["tokens"]
            ids.add(r["id"])
            out[r["id"]] = "include"
            if v is not None:
                vectors.append(v)
    return out


EXT = "id string, ord long, tokens long, score double, recency double, parent_id string, links array<string>, embedding array<double>, supersedes string"


def test_extended_pack_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    for seed in range(4):
        n = 40
        rows = []
        for i in range(n):
            links = [f"i{j}" for j in rng.choice(n, 2)] if rng.random() < 0.3 else None
            parent = f"i{rng.integers(0, n)}" if rng.random() < 0.3 else None
            vector = [float(x) for x in rng.normal(size=2)] if rng.random() < 0.5 else None
            rows.append({"id": f"i{i}", "ord": i, "tokens": int(rng.integers(1, 20)), "score": float(rng.integers(0, 12)), "recency": float(rng.integers(0, 3)), "parent_id": parent, "links": links, "embedding": vector, "supersedes": f"i{i - 9}" if i % 13 == 12 else None})
        df = spark.createDataFrame([tuple(r.values()) for r in rows], EXT).withColumns({"pack_id": F.lit(seed), "budget": F.lit(120)})
        want = brute_extended(rows, 120, 3.0, 0.95)
        for width in (3, 1000):
            assert {r["id"]: r["decision"] for r in XP.extended(df, boost=3.0, redundancy=0.95, width=width).collect()} == want
        assert set(want.values()) == {"include", "negated_by_newer_info", "parent_already_included", "semantic_redundancy", "over_budget"}


def test_relation_boost_golden(spark):
    rows = [("A", 0, 40, 10.0, 0.0, None, None, None, None), ("B", 1, 40, 1.0, 0.0, None, ["A"], None, None), ("noise", 2, 40, 8.0, 0.0, None, None, None, None)]
    df = spark.createDataFrame(rows, EXT).withColumns({"pack_id": F.lit(1), "budget": F.lit(90)})
    assert {r["id"] for r in XP.extended(df, boost=15.0).where("decision = 'include'").collect()} == {"A", "B"}


def test_supersession_chain_and_mirror_goldens(spark):
    chain = [("v1", 0, 5, 1.0, 0.0, None, None, None, None), ("v2", 1, 5, 1.0, 0.0, None, None, None, "v1"), ("v3", 2, 5, 1.0, 0.0, None, None, None, "v2")]
    df = spark.createDataFrame(chain, EXT).withColumns({"pack_id": F.lit(1), "budget": F.lit(1000)})
    assert [r["id"] for r in XP.extended(df).where("decision = 'include'").collect()] == ["v3"]
    mirror = [("x", 0, 5, 1.0, 0.0, None, None, [1.0, 0.0], None), ("y", 1, 5, 1.0, 0.0, None, None, [1.0, 0.01], None)]
    df = spark.createDataFrame(mirror, EXT).withColumns({"pack_id": F.lit(1), "budget": F.lit(1000)})
    assert XP.extended(df, redundancy=0.99999).where("decision = 'include'").count() == 2
    assert XP.extended(df, redundancy=0.9).where("decision = 'include'").count() == 1


def test_pack_of_distinct_items_and_mesh(spark):
    rows = [(1, "the quick brown fox jumps", 1.0, 5.0, 10), (2, "the quick brown fox jumps", 2.0, 9.0, 10), (3, "another text wholly", 1.0, 1.0, 10)]
    df = spark.createDataFrame(rows, "ord long, content string, priority double, recency double, tokens long").withColumns({"pack_id": F.lit(1), "id": F.col("ord"), "score": F.col("priority"), "budget": F.lit(100)})
    assert {r["ord"] for r in P.pack_distinct(df).where("chosen").collect()} == {2, 3}
    own, shared = df.where("ord < 3").select("pack_id", "id", "ord", "tokens", "score", "recency", F.lit(25).alias("budget")), df.where("ord = 3").select("pack_id", "id", "ord", "tokens", F.lit(9.0).alias("score"), "recency", F.lit(25).alias("budget"))
    got = {r["id"]: (r["chosen"], r["entangled"]) for r in P.mesh_pack(own, shared).collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (True, True)}


def test_context_is_built_in_phases(spark):
    rows = [
        (0, "system", False, "s" * 40, 0, 0.0, 0.0), (1, "doc", True, "p" * 40, 5, 0.9, 0.0), (2, "doc", True, "q" * 400, 6, 0.5, 0.0), (3, "message", False, "m" * 8, 9, 0.0, 0.0), (4, "doc", False, "d" * 8, 1, 0.0, 1.0),
    ]
    def taken(budget):
        df = spark.createDataFrame(rows, "ord long, kind string, pinned boolean, text string, at long, importance double, relevance double").withColumns({"pack_id": F.lit(1), "budget": F.lit(budget)})
        return {r["ord"]: r["taken_tokens"] for r in P.build_context(df).collect() if r["taken_tokens"] is not None}

    assert taken(200) == {0: 10, 1: 10, 2: 100, 3: 2, 4: 2}
    assert taken(30) == {0: 10, 1: 10, 2: 10}
    assert taken(5) == {0: 5}


def test_dictionary_order(spark):
    df = spark.createDataFrame([("b",), ("B",), ("a",), ("é",), ("f",)], "t string")
    assert [r["t"] for r in df.orderBy(T.alphabetical(F.col("t"))).collect()] == ["a", "b", "B", "é", "f"]


def test_quality_gate_drops_the_least_score_until_it_passes(spark):
    same = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(0, same, 10, 9.0, 5.0), (1, same, 10, 9.0, 1.0), (2, same, 10, 9.0, 1.0), (3, "one totally different line of other words here", 10, 9.0, 4.0)]
    df = spark.createDataFrame(rows, "ord long, content string, tokens long, recency double, score double").withColumns({"pack_id": F.lit("p"), "chosen": F.lit(True)})
    def kept(least):
        return sorted(r["ord"] for r in Q.gate(df, least).where("kept").collect())

    assert kept(0.0) == [0, 1, 2, 3] and kept(0.8) == [0, 3] and len(kept(2.0)) == 1
    # the gate's figure is that of analyze()
    for ids in ([0, 1, 2, 3], [0, 2, 3], [0, 3]):
        overall = Q.analyze(df.where(F.col("ord").isin(ids))).first()["overall"]
        passes = next(k for k in ([0, 1, 2, 3], [0, 2, 3], [0, 3]) if Q.analyze(df.where(F.col("ord").isin(k))).first()["overall"] >= overall)
        assert kept(overall) == passes


# retrieval

def test_survivors_and_vector_links(spark):
    rows = [("g", i, w, p, r) for i, (w, p, r) in enumerate([("a b c d e", 1.0, 1.0), ("a b c d e", 5.0, 0.0), ("a b c d e f", 0.0, 9.0), ("x y", 0.0, 0.0)])]
    df = spark.createDataFrame(rows, "group string, ord long, w string, priority double, recency double").withColumn("words", F.split("w", " "))
    assert sorted(r["ord"] for r in R.survivors(df).collect()) == [2, 3]
    assert sorted(r["ord"] for r in R.survivors(df, by="priority").collect()) == [1, 3]
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 3))
    v[10], v[20], v[30] = v[5], v[5] * 2, 0
    df = spark.createDataFrame([("g", i, [float(y) for y in x]) for i, x in enumerate(v)], "group string, ord long, embedding array<double>")
    got = {(r["a"], r["b"]) for r in R.vector_links(df, 0.9, cells=4).collect()}
    n = np.linalg.norm(v, axis=1)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if n[i] * n[j] > 0 and v[i] @ v[j] / (n[i] * n[j]) >= 0.9}
    # of equal vectors the least stands for all
    stand = {10: 5}
    assert {tuple(sorted((stand.get(a, a), stand.get(b, b)))) for a, b in got | {(5, 10)}} == {tuple(sorted((stand.get(a, a), stand.get(b, b)))) for a, b in want}


def test_leaders_equal_the_scan(spark):
    rng = np.random.default_rng(2)
    for _ in range(3):
        edges = {tuple(sorted(map(int, e))) for e in rng.integers(0, 30, (40, 2)) if e[0] != e[1]}
        lead = {}
        for i in range(30):
            own = [a for a in range(i) if lead[a] == a and (a, i) in edges]
            lead[i] = min(own) if own else i
        got = R.leaders(spark.createDataFrame([("g", i) for i in range(30)], "group string, ord long"), spark.createDataFrame([("g", a, b) for a, b in edges], "group string, a long, b long"))
        assert {r["ord"]: r["leader"] for r in got.collect()} == lead


def test_hybrid_ranks_and_retrievers(spark):
    ranked = spark.createDataFrame([(1, f"d{i}", i) for i in range(1, 4)], "query_id long, id string, rank int")
    text = spark.createDataFrame([(1, "d3", 9.0), (1, "zz", 99.0)], "query_id long, id string, score double")
    got = [r["id"] for r in R.hybrid_ranks(ranked, text, weights=(0.1, 0.9)).orderBy("rank").collect()]
    assert got[0] == "d3" and got[1:] == ["d1", "d2"]
    assert one(spark, R.adapter_score(F.lit(3.0), "l2")) == 0.25 and one(spark, R.adapter_score(F.lit(0.25), "cosine")) == 0.75
    known = R.Retrievers()
    known.register("fixed", lambda q: q.select("query_id", F.lit("d1").alias("id"), F.lit(0.5).alias("score")))
    rows = known.ingest("fixed", spark.createDataFrame([(1, "x")], "query_id long, text string"), spark.createDataFrame([("d1",)], "id string")).collect()
    assert [(r["id"], r["retrieval_score"]) for r in rows] == [("d1", 0.5)]
    with pytest.raises(ValueError):
        known.ingest("none", ranked, ranked)


def test_vector_search_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 5))
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {}
    for r in R.vector_top(df, asked, 7, least=0.2, block=4, cells=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    for q in range(0, 200, 20):
        s = np.floor(u @ u[q] * 1e6 + 0.5) / 1e6
        order = sorted((i for i in range(200) if i != q and s[i] >= 0.2), key=lambda i: (-s[i], i))[:7]
        assert [i for _, i in sorted(got.get(q, []))] == order


# monitoring, memories, risk

def test_utilisation_alarms_on_a_fall(spark):
    rows = [("s", i, i, u) for i, u in enumerate([0.9, 0.9, 0.9, 0.9, 0.3])]
    drifted = M.drift(spark.createDataFrame(rows, "stream string, ts long, obs_id long, utilization double"), ["utilization"])
    a = M.alerts(drifted).collect()
    assert [(r["ts"], r["severity"], r["message"]) for r in a] == [(4, "critical", "Critical: budget utilization has decreased by 0.600")]
    assert a[0]["recommendation"].startswith("Immediately increase budget")
    rising = spark.createDataFrame([("s", i, i, u) for i, u in enumerate([0.1, 0.1, 0.9])], "stream string, ts long, obs_id long, utilization double")
    assert M.alerts(M.drift(rising, ["utilization"])).count() == 0


@pytest.mark.parametrize("samples,variance,want", [(0, 0.05, 0.0), (50, 0.05, 1 - math.exp(-1)), (50, 0.005, (1 - math.exp(-1)) * 0.5), (100, 0.375, (1 - math.exp(-2)) * 0.5), (100, 0.9, 0.0)])
def test_confidence_pieces(spark, samples, variance, want):
    assert one(spark, M.confidence(F.lit(samples), F.lit(variance))) == pytest.approx(want)


def test_causal_rules_in_order(spark):
    rows = [("closed", True, True, False, 2.0), ("closed", False, True, False, 1.5), ("closed", False, False, True, 0.1), ("open", False, False, False, 1.2), (None, False, False, True, 2.0), (None, False, False, False, 1.0)]
    df = spark.createDataFrame([r[:4] for r in rows], "issue_status string, issue_active boolean, is_outcome boolean, pinned boolean")
    assert [r["x"] for r in df.select(P.causal_score(F.lit(1.0)).alias("x")).collect()] == [r[4] for r in rows]


def test_publish_fills_defaults_and_keeps_the_newest(spark):
    schema = "item_id long, source_agent long, kind string, priority double, scope array<long>, propagation string, entangled_at timestamp, expires_at timestamp"
    new = spark.createDataFrame([(1, 7, "k", 1.0, None, None, None, 9.0), (2, 7, "k", 1.0, [3], "immediate", 60.0, None)], "item_id long, source_agent long, kind string, priority double, scope array<long>, propagation string, expires_in double, new_priority double")
    out = {r["item_id"]: r for r in M.publish(spark.createDataFrame([], schema), new, "2024-01-01 00:00:00").collect()}
    assert (out[1]["priority"], out[1]["propagation"], out[1]["expires_at"]) == (9.0, "next-pack", None)
    assert str(out[2]["expires_at"]) == "2024-01-01 00:01:00"
    assert [r["item_id"] for r in M.publish(spark.createDataFrame([], schema), new, "2024-01-01", most=1).collect()] == [2]


def test_memory_normal_form_and_get(spark):
    rows = spark.createDataFrame([("a", "x", None), ("b", "y", 0.0)], "id string, content string, salience double")
    m = Y.normalize(rows, "2024-01-01")
    assert [(r["salience"], r["is_summary"], str(r["updated_at"])) for r in m.orderBy("id").collect()] == [(1.0, False, "2024-01-01 00:00:00"), (0.0, False, "2024-01-01 00:00:00")]
    assert [r["id"] for r in Y.get(m, rows.where("id = 'b'").select("id"), "2024-02-01").collect()] == ["b"]


def test_empty_texts_are_redundant(spark):
    rows = [("p", i, t) for i, t in enumerate(["", None, "a b c", "d"])]
    got = I.redundancy_estimate(spark.createDataFrame(rows, "pack_id string, ord long, content string")).first()
    assert got["redundancy"] == 0.5


#: Each engine's risk where nothing is known, added up by hand from its weights and defaults, and its route.
CALM = {
    "supply_chain": (0.4, "monitor"),
    "pharmacovigilance": (0.25 * 0.55 + 0.1 * 0.30, "monitor"),
    "clinical": (0.84 * 0.2 + 0.44 * 0.14 + 0.42 * 0.18 + 0.24 * 0.08 + 26 / 80 * 0.08 + 0.46 * 0.1 + 0.48 * 0.07 + 3 / 24 * 0.07 + 20 / 120 * 0.05 + 7 / 30 * 0.03, "flow_optimization"),
    "emergency": (0.3 * 0.3 + 0.3 * 0.16 + 0.25 * 0.06 + 0.3 * 0.12 + 0.28 * 0.12 + 0.25 * 0.08, "monitor"),
    "grid_outage": (0.25 * 0.42 + 90 / 240 * 0.12, "monitor"),
    "manufacturing": (0.8 / 5 * 0.14 + 1 / 6 * 0.1 + 5 / 60 * 0.06, "monitor"),
    "contract": (0.36 * 0.3 + 0.4 * 0.15 + 0.32 * 0.14 + 0.4 * 0.1 + 0.25 * 0.11 + 0.4 * 0.08, "monitor"),
    "migration": (0.38 * 0.22 + 0.35 * 0.14 + 0.5 * 0.15 + 0.32 * 0.1 + 0.42 * 0.12 + 0.44 * 0.08 + 0.25 * 0.1 + 0.4 * 0.04 + 0.4 * 0.04, "targeted_refactor_wave"),
    "regulatory": (0.35 * 0.3 + 0.3 * 0.22 + 0.3 * 0.24 + 2 / 12 * 0.08 + 0.2 * 0.06 + (1 - 150 / 180) * 0.08, "monitor"),
}


@pytest.mark.parametrize("name", sorted(CALM))
def test_risk_of_unknown_readings(spark, name):
    r = risk.decide(spark.range(1).select(F.lit(0).alias("enriched")), name).first()
    base = next((c for x, _, _, c in risk.ENGINES[name].routes if x == r["route"]), risk.ENGINES[name].calm[1])
    assert (r["risk"], r["route"]) == (pytest.approx(CALM[name][0]), CALM[name][1]) and r["confidence"] == pytest.approx(base - 0.3)


@pytest.mark.parametrize("name,readings,route,priority", [
    ("supply_chain", {"supplier_risk": 0.9, "lane_delay": 30.0}, "hold_review", "urgent"), ("supply_chain", {"lane_delay": 18.0}, "reroute", "urgent"), ("supply_chain", {"capacity": 0.45}, "split_order", "high"),
    ("supply_chain", {"lane_delay": 8.0}, "expedite", "normal"), ("supply_chain", {"supplier_risk": 0.75}, "monitor", "high"), ("pharmacovigilance", {"fatal_cases": 1.0}, "lot_hold_and_report", "urgent"),
    ("clinical", {"occupancy": 95.0, "acute": True}, "critical_capacity_command", "urgent"), ("clinical", {"boarding_hours": 8.0}, "surge_flow_stabilization", "high"),
    ("emergency", {"mandatory": True, "severity": 0.55}, "full_evacuation_activation", "urgent"), ("emergency", {"observed_people": 150000.0, "shelter": 0.5}, "staged_evacuation_and_shelter", "high"),
    ("grid_outage", {"instability": 0.9}, "blackstart_escalation", "urgent"), ("grid_outage", {"instability": 0.7, "cascading": True}, "controlled_load_shed", "high"), ("grid_outage", {"customers": 250000.0, "hospital_hint": True}, "priority_restoration", "high"),
    ("manufacturing", {"safety": True}, "contain_and_rollback", "urgent"), ("manufacturing", {"fault_rate": 2.5}, "targeted_diagnostics", "high"), ("manufacturing", {"yield_rate": 0.88}, "enhanced_quality_gate", "normal"),
    ("contract", {"unlimited": True}, "hardline_redline_and_exec_escalation", "urgent"), ("contract", {"observed_cap": 2.5, "severity": 0.7}, "hardline_redline_and_exec_escalation", "urgent"),
    ("migration", {"unsupported": True}, "immediate_replatform_program", "urgent"), ("migration", {"age_years": 8.0}, "phased_strangler_with_parallel_run", "high"),
    ("regulatory", {"deadline_days": 45.0, "coverage": 0.5}, "immediate_remediation_program", "urgent"), ("regulatory", {"evidence_days": 90.0}, "accelerated_control_gap_closure", "high"),
])
def test_risk_routes(spark, name, readings, route, priority):
    row = spark.range(1).select(F.lit(2).alias("enriched"), *[F.lit(v).alias(k) for k, v in readings.items()])
    r = risk.decide(row, name).first()
    assert (r["route"], r["priority"]) == (route, priority)


# sets, records, compiler

def test_timeline(spark, tmp_path):
    t = S.Timeline(spark, f"{tmp_path}/t")
    a, b = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(1,), (2,)], "id long")
    first = t.checkpoint("one", a)
    t.checkpoint("two", b)
    assert t.items().count() == 2
    t.rewind("one")
    assert t.items().count() == 1
    t.fork("side", "two")
    assert t.branch == "side" and t.items().count() == 2 and t.forks["side"] == "s2"
    t.checkout("main")
    assert t.items().count() == 1 and [s["name"] for s in t.history()] == ["one", "two"] and t.heads["main"] == first
    back = S.Timeline(spark, f"{tmp_path}/t")
    back.restore(json.loads(json.dumps(t.export())))
    assert back.items("two").count() == 2
    for wrong in (lambda: t.rewind("none"), lambda: t.fork("side"), lambda: t.checkout("none")):
        with pytest.raises(ValueError):
            wrong()


def test_insights(spark):
    row = [("p", 1, 2, 0, 0.5, 0.7, 0.1, 0.3, 0.9, 0.6)]
    df = spark.createDataFrame(row, "pack_id string, only_in_a int, only_in_b int, shared int, quality_a double, quality_b double, redundancy_a double, redundancy_b double, utilization_a double, utilization_b double")
    assert sorted(r["insight"] for r in S.insights(df).collect()) == ["additional-items-helped", "nothing-shared", "redundancy-differs", "utilization-differs"]


def test_program_compiles(spark):
    rows = [(1, "system", "the rules of the house are these", 5.0, 9.0, 20), (2, "memory", "old note", 5.0, 1.0, 10), (3, "memory", "new note about cats and dogs", 5.0, 9.0, 10), (4, "memory", "new note about cats and dogs", 4.0, 9.0, 10), (5, None, "free text", 1.0, 9.0, 5)]
    df = spark.createDataFrame(rows, "id long, kind string, content string, priority double, recency double, tokens long").withColumns({"pack_id": F.lit("p"), "ord": F.col("id"), "score": F.col("priority"), "budget": F.lit(100)})
    p = K.Program("claude").slot("rules", "system", 50, position="first", required=True).slot("notes", "memory", 50, max_staleness=5.0, deduplicate=True).slot("ask", "query", 50, position="last", required=True).slot("rest", None, 50)
    chosen, found = p.compile(df)
    assert [(r["id"], r["slot"]) for r in chosen.orderBy("position").collect()] == [(1, "rules"), (3, "notes"), (5, "rest")]
    assert [(r["level"], r["slot"]) for r in found.where("constraint = 'coverage'").collect()] == [("error", "ask")]


def test_issue_files_merge(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"x","title":"X","priority":1}\n# note\n{"id":"y","title":"Y","priority":2}\n')
    new = spark.createDataFrame([("y", "Y2", 3), ("z", "Z", 0)], "id string, title string, priority int")
    from ctxloom.sources.stores import ISSUE_SCHEMA, read_issues

    full = spark.createDataFrame([], ISSUE_SCHEMA)
    new = new.select(*[F.col(f.name).cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in full.schema])
    X.merge_issue_files(spark, f"{tmp_path}/a.jsonl", new, f"{tmp_path}/out")
    assert sorted((r["id"], r["title"]) for r in read_issues(spark, f"{tmp_path}/out").collect()) == [("x", "X"), ("y", "Y2"), ("z", "Z")]


def test_pickup_parts(spark):
    rows = [("handoff-1", "message", ["handoff"], "pinned"), ("item-a", "context", None, "open"), ("item-b", "task", [B.NAMES.source], "deferred"), ("item-c", "context", [], "closed"), ("w", "task", None, "open")]
    df = spark.createDataFrame(rows, "id string, issue_type string, labels array<string>, status string").withColumns({"source_system": F.lit(None).cast("string"), "metadata": F.lit(None).cast("string")})
    assert [r["part"] for r in B.pickup(df).collect()] == ["manifest", "item", "deferred", "closed", "work"]


def test_stores(spark, tmp_path):
    schema = "id string, content string, updated_at long"
    a = spark.createDataFrame([("x", "1", 1), ("y", "1", 1)], schema)
    b = spark.createDataFrame([("x", "2", 2)], schema)
    for store in (X.open_store(spark, "memory", schema=schema), X.open_store(spark, "file", path=f"{tmp_path}/m", schema=schema)):
        store.put(a)
        store.put(b)
        assert sorted((r["id"], r["content"]) for r in store.all().collect()) == [("x", "2"), ("y", "1")]
        store.forget(b.select("id"))
        assert [r["id"] for r in store.all().collect()] == ["y"]
        store.put(b)
        assert sorted(r["id"] for r in store.all().collect()) == ["x", "y"]
    with pytest.raises(ValueError):
        X.open_store(spark, "tape")


def test_sqlite_source_reads_in_ranges(spark, tmp_path):
    with sqlite3.connect(tmp_path / "db") as c:
        c.execute("create table m (id integer, content text)")
        c.executemany("insert into m values (?, ?)", [(i, f"t{i}") for i in range(100)])
        c.execute("create table none (id integer)")
    X.register_sqlite(spark)
    df = spark.read.format("sqlite").schema("id long, content string").option("path", str(tmp_path / "db")).option("table", "m").option("partitions", "4").load()
    assert df.rdd.getNumPartitions() == 4 and sorted((r["id"], r["content"]) for r in df.collect()) == [(i, f"t{i}") for i in range(100)]
    assert spark.read.format("sqlite").schema("id long").option("path", str(tmp_path / "db")).option("table", "none").load().count() == 0


def test_feedback_recordings_payloads(spark, tmp_path):
    f = X.FeedbackStore(spark, f"{tmp_path}/f")
    rows = spark.createDataFrame([("a", "p1", "s", "2024-01-01", 10, 0.5, None, ["i"], []), ("b", "p2", "t", "2024-01-02", 10, 0.5, 0.2, [], [])], X.FEEDBACK.replace("ts timestamp", "ts string"))
    f.record(rows)
    assert [r["id"] for r in f.query().collect()] == ["b", "a"]
    f.report(spark.createDataFrame([("p1", 0.9, "2024-01-03"), ("p1", float("nan"), "2024-01-04")], "pack_id string, quality double, ts string"))
    assert [(r["id"], r["quality"]) for r in f.query(segment="s").collect()] == [("a", 0.9)]
    assert [r["id"] for r in f.query(since="2024-01-02", limit=5).collect()] == ["b"]
    rec = spark.createDataFrame([("r1", [("i", 1, 1.0)], 10, ["i"], 1, {"k": "v"}), (None, [], 1, [], 0, None)], X.RECORDING)
    X.save_recordings(rec, f"{tmp_path}/r")
    assert [r["id"] for r in X.load_recordings(spark, f"{tmp_path}/r").collect()] == ["r1"]
    for kind in X.PAYLOADS:
        row = spark.range(1).select(*[F.lit("v").alias(c) for c in X.PAYLOADS[kind]])
        made = json.loads(X.payloads(row, kind, "t").first()["payload"])
        assert made["type"] == kind and set(X.PAYLOADS[kind]) < set(made)
    X.audit(rec.select("id"), f"{tmp_path}/audit")
    X.audit(rec.select("id"), f"{tmp_path}/audit")
    assert spark.read.json(f"{tmp_path}/audit").count() == 4
    got = X.recommended(spark.createDataFrame([("s", 1, 0.5), ("t", 2, 0.5)], "segment string, budget long, confidence double"), spark.createDataFrame([("s", 9, 7.0)], "segment string, budget long, confidence double"))
    assert sorted(map(tuple, got.collect())) == [("s", 9, 1.0, True), ("t", 2, 0.5, False)]


def test_items_of_arrays_and_plans_and_the_command_line(spark, tmp_path, capsys):
    items = [{"id": "system", "content": "s " * 9, "priority": 10, "tokens": 12}, {"id": "project", "content": "p", "priority": 5, "tokens": 16}, {"id": "long-note", "content": "n", "priority": 1, "tokens": 60}]
    (tmp_path / "a.json").write_text(json.dumps(items))
    (tmp_path / "p.json").write_text(json.dumps({"items": items}))
    assert [X.load_items(spark, f"{tmp_path}/{f}").count() for f in ("a.json", "p.json")] == [3, 3]
    from ctxloom.__main__ import main

    def said(*argv):
        main([str(a) for a in argv])
        return [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    assert [r["id"] for r in said("pack", tmp_path / "p.json", "--tokens", 64)] == ["system", "project"]
    assert [r["decision"] for r in said("trace", tmp_path / "a.json", "--tokens", 64)] == ["include", "include", "exclude"]
    assert said("budget", 200000, "--model", "claude")[0]["effective"] == 140000
    assert said("cost", "--input", 4000, "--cached", 3000, "--output", 500)[0]["cost_cached"] == 0.0114
    assert {r["change"] for r in said("diff", tmp_path / "a.json", tmp_path / "p.json")} == {"kept"}
    assert len(said("issues", tmp_path / "a.json", "--tokens", 64)) == 4 and len(said("place", tmp_path / "a.json")) == 3 and said("quality", tmp_path / "a.json")[0]["item_count"] == 3


# segments, hooks, streams

def test_segments_by_meaning_and_surprise(spark):
    def embed(texts):
        return [[1.0, 0.0] if "cat" in t else [0.0, 1.0] for t in texts]

    text = "A cat sat. The cat ran. A cat ate. Stocks fell. Stocks rose. Bonds held."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "One.")], "doc_id long, text string")
    got = [(r["doc_id"], r["body"]) for r in G.semantic(docs, embed).orderBy("doc_id", "segment").collect()]
    assert " ".join(b for i, b in got if i == 1) == text and got[-1] == (3, "One.") and any(b.endswith("A cat ate.") for _, b in got)
    calm = " ".join(f"Line {i}." for i in range(12)) + " Odd one! Last."
    got = [r["body"] for r in G.surprise(spark.createDataFrame([(1, calm)], "doc_id long, text string"), lambda t: [9.0 if "Odd" in s else 1.0 for s in t]).orderBy("segment").collect()]
    assert len(got) == 2 and got[1].startswith("Odd one!")
    both = G.hybrid(docs, embed, lambda t: [1.0] * len(t)).where("doc_id = 1").orderBy("segment").collect()
    assert [r["segment"] for r in both] == list(range(len(both))) and " ".join(r["body"] for r in both) == text


def test_hooks(spark):
    h = H.Hooks()
    h.register("estimator", "chars", T.estimate_chars)
    assert one(spark, h.use("estimator", "chars")(F.lit("abcde"))) == 2
    for wrong in (lambda: h.register("nothing", "x", None), lambda: h.use("scorer", "x")):
        with pytest.raises(ValueError):
            wrong()
    rows = spark.createDataFrame([(1, "ab", None), (2, "c", [5.0])], "id long, text string, embedding array<double>")
    got = H.embedded(rows, "text", lambda ts: [[float(len(t))] for t in ts]).orderBy("id").collect()
    assert [r["embedding"] for r in got] == [[2.0], [5.0]]
    assert [r["embedding"] for r in H.embedded(rows.drop("embedding"), "text", lambda ts: [[1.0] for _ in ts]).collect()] == [[1.0], [1.0]]
    a = spark.createDataFrame([(1, "a")], "id long, v string")
    assert H.merged(a, a, "id", lambda x, y: x.unionByName(y)).count() == 1
    assert H.evaluated(rows, "text", lambda _: F.count("*") * 1.0).count() == 2
    asked = spark.createDataFrame([(1, "why")], "council long, text string")
    said = H.council(["m1", "m2"], asked, lambda r: r.withColumn("response", F.concat("member", F.lit(" says "), F.col("round").cast("string"))), 3, enough=2.0)
    assert said.count() == 6
    said = H.council(["m1", "m2"], asked, lambda r: r.withColumn("response", F.lit("same words here")), 3)
    assert said.count() == 2


def test_streaming_windows(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{m}:00", 1, float(m)) for m in (0, 1, 2, 9)]
    spark.createDataFrame(rows, "ts string, user_id long, value double").select(F.to_timestamp("ts").alias("ts"), "user_id", "value").write.parquet(f"{tmp_path}/e")
    def run(make, name):
        source = spark.readStream.schema("ts timestamp, user_id long, value double").parquet(f"{tmp_path}/e")
        q = make(source).writeStream.format("memory").queryName(name).outputMode("append" if name == "ses" else "update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert sum(r["n"] for r in run(D.sliding, "sli")) == 8
    batch = D.sessions(spark.read.parquet(f"{tmp_path}/e")).collect()
    assert sorted(r["n"] for r in batch) == [1, 3]
    got = []
    source = spark.readStream.schema("ts timestamp, user_id long, value double").parquet(f"{tmp_path}/e")
    q = source.writeStream.foreachBatch(lambda rows, i: got.append(rows.count())).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/fb").start()
    q.awaitTermination()
    assert got == [4]


def test_streaming_drift_keeps_the_last_values(spark, tmp_path):
    rows = [(f"2024-01-01 00:00:0{i}", 1, v) for i, v in enumerate([1.0, 1.0, 1.0, 5.0])]
    spark.createDataFrame(rows, "ts string, user_id long, value double").select(F.to_timestamp("ts").alias("ts"), "user_id", "value").coalesce(1).write.parquet(f"{tmp_path}/e")
    source = spark.readStream.schema("ts timestamp, user_id long, value double").parquet(f"{tmp_path}/e")
    q = D.last_n(source, size=3).writeStream.format("memory").queryName("lastn").outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    assert [(r["current"], r["baseline"]) for r in spark.table("lastn").collect()] == [(5.0, 1.0)]


def test_selected_rows_stream(spark):
    df = spark.createDataFrame([("p", i, float(i), 0.0, i % 2 == 0) for i in range(6)], "pack_id string, ord long, score double, recency double, chosen boolean")
    assert [r["ord"] for r in D.stream_selected(df)] == [4, 2, 0]


def test_messages_of_interceptors(spark):
    t = spark.createDataFrame([(1, 0, "system", "s", True), (1, 1, "user", "x" * 130, False), (1, 2, "user", "y", True)], "conv_id long, turn int, role string, text string, kept boolean")
    got = [(r["role"], r["text"]) for r in C.reassembled(t, C.digests(t)).orderBy("position").collect()]
    assert got[0] == ("system", "s") and got[2] == ("user", "y")
    assert got[1][1] == "[Context summary of 1 earlier messages]: Earlier conversation (1 messages, summarized):\n- [user]: " + "x" * 120 + "..."


def test_attacks(spark):
    from ctxloom.operators import adversary as A

    assert A.draws(42, 6) == mulberry(42, 6)

    def picks(n, count):
        left, out = list(range(n)), []
        for x in mulberry(42, min(n, count)):
            out.append(left.pop(int(x * len(left))))
        return out

    for n, c in ((1, 1), (7, 4), (33, 33), (50, 10)):
        assert A.picked(n, c, 42) == picks(n, c)
    rows = [(("p", "q")[i % 2], i, f"i{i}", f"Always do thing {i}. More", "k", 5.0, 1.0, None) for i in range(14)]
    df = spark.createDataFrame(rows, "pack_id string, ord long, id string, content string, kind string, priority double, recency double, supersedes string")
    made = {k: A.attack(df, k).where("injected and pack_id = 'p'").collect() for k in A.ATTACKS}
    assert {k: len(v) for k, v in made.items() if k != "temporal-poison"} == {"contradiction": 4, "noise-flood": 11, "authority-spoof": 2, "relevance-dilution": 18}
    x = mulberry(42, 40)
    noise = {r["id"]: r for r in made["noise-flood"]}
    for i in range(11):
        r = noise[f"adversarial-noise-{i}"]
        assert (r["content"], r["priority"], r["recency"]) == (A.NOISE[int(x[3 * i] * 10)], pytest.approx(7 + x[3 * i + 1] * 3), pytest.approx(8 + x[3 * i + 2] * 2))
    at = picks(7, 4)
    said = {r["id"]: r["content"] for r in made["contradiction"]}
    for j, k in enumerate(at):
        t = f"Always do thing {2 * k}"
        want = A.CONTRADICTIONS[int(x[4 + j] * 4)].format(topic=t, original=t.lower(), opposite=t.replace("Always ", "never "))
        assert said[f"adversarial-contradiction-{k}"] == want
    new = [r for r in made["temporal-poison"] if "-new-" in r["id"]]
    assert {r["supersedes"] for r in new} == {f"i{2 * k}" for k in at} and len(made["temporal-poison"]) - len(new) == sum(x[4 + j] < 0.5 for j in range(4))
    for k, bad in zip(picks(7, 2), ((0, 1), (2, 3)), strict=True):
        r = next(r for r in made["authority-spoof"] if r["id"] == f"adversarial-authority-{k}")
        assert r["content"] == A.AUTHORITY[int(x[2 + bad[1]] * 4)].format(topic=f"Always do thing {2 * k}", bad_advice=A.BAD_ADVICE[int(x[2 + bad[0]] * 6)])
    out = A.probe(df, lambda d: d.groupBy("pack_id").agg(F.avg((F.col("kind") == "k").cast("double")).alias("quality"))).collect()
    assert {r["severity"] for r in out if r["attack"] == "contradiction"} == {"resilient"} and {r["severity"] for r in out if r["attack"] == "noise-flood"} == {"critical"}
    assert sum(r["worst"] for r in out) == 2
    with pytest.raises(ValueError):
        A.attack(df, "none")


def test_a_rule_engine_meets_a_limit_that_a_sum_of_floats_misses(spark):
    from ctxloom.operators.rules import CONTACT_CENTRE

    numbers = {"churn": 0.28, "compliance": 0.24, "fraud": 0.7, "low_value": 1 / 7, "wait": 36 / 60, "recontact": 0.0}
    row = spark.range(1).select(*[F.lit(v).alias(c) for c, v in numbers.items()], *[F.lit(None).cast("double").alias(c) for c in ("csat", "hint")], F.lit(36).alias("wait_minutes"), F.lit(0).alias("recontacts"), *[F.lit(False).alias(c) for c in ("severe", "vip", "no_autopilot", "supervisor")])
    for gap in (0.32, 0.32 - 1e-12):
        risk = row.withColumns({c: F.lit(0.0) for c in numbers}).withColumn("hint", F.lit(gap))
        out = CONTACT_CENTRE.decide(risk).first()
        assert (out["risk"], out["route"]) == (0.32, "autopilot_resolution")


def test_information_gain_makes_no_row_of_a_pair(spark, monkeypatch):
    from ctxloom.operators import retrieval as R

    rows = [(i, sorted({f"w{(i * k) % 23}" for k in range(i % 7)})) for i in range(60)]
    sets = spark.createDataFrame(rows, "id long, words array<string>")
    context = sets.where("id % 5 = 0").withColumnRenamed("id", "ctx")
    monkeypatch.setattr(R, "CONTEXT_BLOCK", 5, raising=False)
    monkeypatch.setattr(R, "CANDIDATE_BLOCK", 25, raising=False)
    gains = R.information_gain(sets, context)
    assert "Join Inner" not in gains._jdf.queryExecution().optimizedPlan().toString()
    found = {r["id"]: r["novelty"] for r in gains.collect()}
    for i, w in rows:
        best = max((len(set(w) & set(v)) / len(set(w) | set(v)) for k, v in rows if k % 5 == 0 and set(w) & set(v)), default=0.0)
        assert abs(found[i] - (1 - best)) < 1e-12
