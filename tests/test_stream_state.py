"""The immune memory and the shared mesh over micro-batches, restarts and exported state."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ctxloom.operators import immune as I
from ctxloom.streaming import memory as M

START = datetime(2024, 1, 1)
FIGURES = [f"{n}_{k}" for n in ("priority", "recency") for k in ("min", "max", "mean", "std")] + ["token_utilization", "staleness_ratio", "redundancy"]


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set(*M.STATE_STORE)
    yield
    spark.conf.unset(M.STATE_STORE[0])


def pattern(x, kinds=("memory",), n=4):
    return json.dumps({"kinds": [{"kind": k, "ratio": 1 / len(kinds)} for k in kinds], "item_count": n, **{f: x for f in FIGURES}})


def feed(spark, where, schema, rows):
    names = [c.split()[0] for c in schema.split(", ")]
    full = [{"ts": START + timedelta(seconds=r.pop("at")), **r} for r in map(dict, rows)]
    spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], schema).coalesce(1).write.mode("append").json(where)


def run(spark, tmp_path, name, schema, make):
    """All that is new in the folder, through the query with its checkpoint; what came out."""
    got = []
    out = make(spark.readStream.schema(schema).json(f"{tmp_path}/{name}"))
    q = out.writeStream.outputMode("update").foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return got


def test_likeness_is_that_of_columns(spark):
    a, b = json.loads(pattern(0.2, ("memory", "tool"), 3)), json.loads(pattern(0.5, ("memory",), 7))
    schema = "kinds array<struct<kind:string,ratio:double>>, item_count long, " + ", ".join(f"{f} double" for f in FIGURES)
    df = spark.createDataFrame([(json.dumps(a), json.dumps(b))], "a string, b string").select(F.from_json("a", schema).alias("a"), F.from_json("b", schema).alias("b"))
    assert abs(df.select(I.similarity("a", "b")).first()[0] - M.likeness(a, b)) < 1e-12


def test_immune_memory_over_batches_and_restarts(spark, tmp_path):
    def make(events):
        return M.immune_stream(events, most=2)

    def failure(at, id_, x, severity=None):
        return {"at": at, "system": "s", "action": "failure", "id": id_, "pattern": pattern(x), "symptom": "x", "severity": severity}

    def screen(at, id_, x):
        return {"at": at, "system": "s", "action": "screen", "id": id_, "pattern": pattern(x)}

    feed(spark, f"{tmp_path}/i", M.IMMUNE_EVENT, [failure(0, "a", 0.1), screen(1, "p1", 0.1), failure(2, "b", 0.1, "block"), screen(3, "p2", 0.1), {"at": 4, "system": "t", "action": "screen", "id": "p3", "pattern": pattern(0.1)}])
    got = {(r["system"], r["id"], r["kind"], r["antibody"], r["safe"]) for r in run(spark, tmp_path, "i", M.IMMUNE_EVENT, make)}
    assert got == {("s", "p1", "alert", "a", None), ("s", "p1", "screened", None, True), ("s", "p2", "alert", "a", None), ("s", "p2", "alert", "b", None), ("s", "p2", "screened", None, False), ("t", "p3", "screened", None, True)}
    # the query starts anew and still knows; a third antibody drives out the oldest
    feed(spark, f"{tmp_path}/i", M.IMMUNE_EVENT, [failure(5, "c", 0.9), screen(6, "p4", 0.1), {"at": 7, "system": "s", "action": "export", "id": "e"}])
    rows = run(spark, tmp_path, "i", M.IMMUNE_EVENT, make)
    assert [r["antibody"] for r in rows if r["kind"] == "alert"] == ["b"] and [r["antibody"] for r in rows if r["kind"] == "antibody"] == ["b", "c"]
    # another query begins with the exported state
    exported = spark.createDataFrame([r for r in rows if r["kind"] == "antibody"], M.IMMUNE_OUT)
    feed(spark, f"{tmp_path}/j", M.IMMUNE_EVENT, [screen(8, "p5", 0.1), {"at": 9, "system": "s", "action": "remove", "id": "b"}, screen(10, "p6", 0.1)])
    rows = run(spark, tmp_path, "j", M.IMMUNE_EVENT, lambda e: M.immune_stream(e, start=exported))
    assert [(r["id"], r["antibody"], r["severity"]) for r in rows if r["kind"] == "alert"] == [("p5", "b", "block")]


def test_mesh_over_batches_and_restarts(spark, tmp_path):
    def make(events):
        return M.mesh_stream(events, late="0 seconds", most=3)

    def publish(at, agent, item, **more):
        return {"at": at, "mesh": "m", "action": "publish", "agent": agent, "item_id": item, **more}

    def ask(at, agent, action="pack", **more):
        return {"at": at, "mesh": "m", "action": action, "agent": agent, **more}

    feed(spark, f"{tmp_path}/m", M.MESH_EVENT, [
        publish(0, "x", "a", item_kind="fact"), publish(1, "x", "b", scope=["y"], propagation="immediate"), publish(2, "x", "c", scope=["z"], expires_in=5.0, propagation="on-demand"),
        ask(3, "y"), ask(3, "x"), ask(3, "z"), ask(3, "z", "pending"), ask(4, "y", kinds=["fact"]), {**ask(4, "y", "acknowledge"), "item_id": "b"}, ask(5, "y", "pending"), ask(8, "z", "pending"),
    ])
    rows = run(spark, tmp_path, "m", M.MESH_EVENT, make)
    given = [(r["kind"], r["agent"], r["item_id"]) for r in rows if r["agent"]]
    assert given == [("pack", "y", "a"), ("pack", "y", "b"), ("pack", "z", "a"), ("pending", "z", "a"), ("pending", "z", "c"), ("pack", "y", "a"), ("pending", "y", "a"), ("pending", "z", "a")]
    # after the watermark has passed, what has expired leaves; acknowledgements and items outlive the restart
    feed(spark, f"{tmp_path}/m", M.MESH_EVENT, [ask(60, "y", "pending"), publish(61, "y", "d"), publish(62, "y", "e"), ask(63, "x", "pending"), ask(64, "q", "export")])
    rows = run(spark, tmp_path, "m", M.MESH_EVENT, make)
    assert [(r["agent"], r["item_id"]) for r in rows if r["kind"] == "pending"] == [("y", "a"), ("x", "d"), ("x", "e")]
    assert {r["item_id"] for r in rows if r["kind"] in ("expired", "dropped")} <= {"a", "c"} and {r["item_id"] for r in rows if r["kind"] == "item"} >= {"b", "d", "e"}
    exported = spark.createDataFrame([r for r in rows if r["kind"] in ("item", "ack")], M.MESH_OUT)
    feed(spark, f"{tmp_path}/n", M.MESH_EVENT, [ask(65, "y", "pending"), ask(66, "y", "unregister"), ask(67, "y", "pending")])
    rows = run(spark, tmp_path, "n", M.MESH_EVENT, lambda e: M.mesh_stream(e, start=exported))
    # b was acknowledged by y until it is unregistered; what y published is not given back to it
    assert [r["item_id"] for r in rows if r["kind"] == "pending"].count("b") == 1


def test_the_state_store_is_asked_for(spark):
    spark.conf.unset(M.STATE_STORE[0])
    with pytest.raises(ValueError, match="RocksDB"):
        M.immune_stream(spark.createDataFrame([], M.IMMUNE_EVENT))
    spark.conf.set(*M.STATE_STORE)
