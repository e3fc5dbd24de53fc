"""Functions that no query shows: sinks, state, traces of variants, orders, learned packs, and all constraints at once."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ctxloom.functions import hooks
from ctxloom.operators import compiler as K
from ctxloom.operators import packing as P
from ctxloom.operators import quality as Q
from ctxloom.operators import sets as S
from ctxloom.operators import templates as T
from ctxloom.sources import records as X
from ctxloom.streaming import drift as D


def test_payloads_are_sent_by_partition_and_errors_stop_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("p1", 0.5), ("p2", None)], "pack_id string, density double").repartition(2)
    where = str(tmp_path)

    def post(batch):
        for x in batch:
            open(os.path.join(where, json.loads(x)["pack_id"]), "w").write(x)
        raise OSError("gone")

    X.send(X.payloads(rows, "quality", "now"), post)
    assert json.loads((tmp_path / "p1").read_text()) == {"type": "quality", "timestamp": "now", "pack_id": "p1", "density": 0.5} and (tmp_path / "p2").exists()


def test_each_batch_of_a_stream_is_handed_over(spark, tmp_path):
    spark.range(5).coalesce(1).write.json(f"{tmp_path}/in")
    seen = []
    q = D.each_batch(spark.readStream.schema("id long").json(f"{tmp_path}/in"), lambda df, n: seen.append((n, df.count())), f"{tmp_path}/c")
    q.processAllAvailable()
    q.stop()
    assert seen == [(0, 5)]


def test_state_goes_out_and_comes_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.5], None)], "id string, v array<double>, n long")
    X.state_export(rows, f"{tmp_path}/s")
    assert X.state_import(spark, f"{tmp_path}/s", rows.schema).collect() == rows.collect()


def test_trace_of_variants(spark):
    rows = [("a", 0, 9, 60, None), ("b", 1, 5, 50, [45, 30]), ("c", 2, 1, 90, [80])]
    df = spark.createDataFrame([(1, *r, 0.0, 100) for r in rows], "pack_id int, id string, ord long, score long, tokens long, sizes array<long>, recency double, budget long")
    out = P.variant_trace(P.greedy_variants(df, ["pack_id"]), ["pack_id"]).orderBy("step").collect()
    assert [(r["id"], r["step"], r["decision"], r["reason"], r["taken_tokens"]) for r in out] == [("a", 1, "include", "fits_budget", 60), ("b", 2, "compress", "compressed_to_fit", 30), ("c", 3, "exclude", "over_budget", None)]


def test_order_by_score_and_linear_recency(spark):
    df = spark.createDataFrame([(1, 0, 2.0, 10), (1, 1, 5.0, 30), (1, 2, 5.0, 15), (2, 0, 1.0, 7)], "pack_id int, ord long, score double, at long")
    assert [r["ord"] for r in P.place_by_score(df).where("pack_id = 1").orderBy("position").collect()] == [1, 2, 0]
    got = {(r["pack_id"], r["ord"]): r["x"] for r in df.withColumn("x", P.linear_recency("at", ["pack_id"])).collect()}
    assert got == {(1, 0): 0.0, (1, 1): 1.0, (1, 2): 0.25, (2, 0): 1.0}


def test_learned_weights_turn_a_pack(spark):
    df = spark.createDataFrame([(1, "old", 0, 10.0, 0.0, 0.0, 50, 60), (1, "new", 1, 0.0, 10.0, 0.0, 50, 60)], "pack_id int, id string, ord long, priority double, recency double, salience double, tokens long, budget long")
    chosen = lambda w: [r["id"] for r in P.learned_pack(df, spark.createDataFrame(w, "dimension string, weight double")).where("chosen").collect()]
    assert chosen([("none", 1.0)]) == ["old"] and chosen([("priority", 0.1), ("recency", 2.0)]) == ["new"]


def test_only_what_was_chosen_is_analyzed(spark):
    df = spark.createDataFrame([(1, 0, "one two three", 3, 9.0, True), (1, 1, "one two three", 3, 0.0, False)], "pack_id int, ord long, content string, tokens long, recency double, chosen boolean")
    r = Q.analyze_packs(df).first()
    assert (r["item_count"], r["total_tokens"], r["freshness"], r["redundancy"]) == (1, 3, 1.0, 0.0)


def test_flat_messages(spark):
    df = spark.createDataFrame([(1, 1, 5, "user", "u"), (1, 0, 9, "system", "s"), (1, 1, 2, "assistant", "a")], "pack_id int, section int, first long, role string, content string")
    assert [(r["position"], r["role"]) for r in T.flat_messages(df).orderBy("position").collect()] == [(0, "system"), (1, "assistant"), (2, "user")]


def test_all_five_constraints(spark):
    items = [(1, 1, "memory", "the cache must be enabled for every single request", 9.0, 10), (1, 2, "memory", "the cache must not be enabled for every single request", 1.0, 10), (1, 3, "memory", "the cache must be enabled for every single request", 9.0, 10)]
    packed = spark.createDataFrame(items, "pack_id int, id long, kind string, content string, recency double, tokens long")
    out = {(r["level"], r["slot"], r["constraint"], r["item_id"], r["other_id"]) for r in K.check(packed, spark.createDataFrame([(1, 100)], "pack_id int, budget long"), [("rules", "system")]).collect()}
    assert ("error", "rules", "coverage", None, None) in out and ("warning", None, "freshness", "2", None) in out and ("warning", None, "budget-utilization", None, None) in out
    assert ("error", None, "no-contradiction", "1", "2") in out and ("warning", None, "max-redundancy", "1", "3") in out


def test_branches_with_the_quality_of_each(spark):
    schema = "id string, ord long, content string, tokens long, recency double, priority double, kind string"
    a = spark.createDataFrame([("x", 0, "one two", 2, 9.0, 1.0, "k"), ("y", 1, "three four", 2, 0.0, 1.0, "k")], schema)
    b = spark.createDataFrame([("x", 0, "one two", 2, 9.0, 1.0, "k"), ("z", 1, "five", 1, 9.0, 1.0, "k")], schema)
    r = S.compare_branches(a, b, "id", ["content", "tokens"], "ord").first()
    assert (r["only_in_1"], r["only_in_2"], r["common"], r["modified"]) == (1, 1, 1, 0)
    assert (r["quality_1"]["freshness"], r["quality_2"]["freshness"]) == (0.5, 1.0)
    assert S.compare_branches(a.limit(0), b, "id", ["content"], "ord").first()["quality_1"] is None


def test_one_row_of_a_key_is_always_the_same(spark):
    ours = spark.createDataFrame([("a", 2), ("b", 1)], "id string, v int")
    theirs = spark.createDataFrame([("a", 1), ("a", 3)], "id string, v int")
    out = hooks.merged(ours, theirs, "id", lambda x, y: x.unionByName(y))
    assert sorted(map(tuple, out.collect())) == [("a", 1), ("b", 1)]


@pytest.mark.parametrize("kind", list(X.PAYLOADS))
def test_every_kind_has_its_payload(spark, kind):
    rows = spark.createDataFrame([tuple("x" for _ in X.PAYLOADS[kind])], ", ".join(f"{c} string" for c in X.PAYLOADS[kind]))
    got = json.loads(X.payloads(rows, kind, "t").first()["payload"])
    assert got == {"type": kind, "timestamp": "t", **dict.fromkeys(X.PAYLOADS[kind], "x")}


def test_text_of_message_contents(spark):
    from ctxloom.functions.text import content_text

    given = ['"plain \\"words\\""', '[{"type": "text", "text": "a"}, {"type": "image", "text": "b"}, {"type": "text"}, "x", {"type": "text", "text": "c"}]', '{"a": 1}', "no json", None, "[]", "17"]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, c string").select("i", content_text(F.col("c")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in rows] == ['plain "words"', "a\nc", '{"a": 1}', "no json", "", "", "17"]
