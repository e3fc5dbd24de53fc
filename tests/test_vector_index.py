"""The inverted file against search over all vectors."""

import numpy as np
from pyspark.sql import functions as F

from ctxloom.operators import retrieval as R
from ctxloom.operators import vector_index as V
from ctxloom.plans import queries as L


def asked(v, every):
    return v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def test_all_lists_are_exact_and_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(V, "CELL", 7)
    rng = np.random.default_rng(1)
    rows = [(i, list(map(float, x))) for i, x in enumerate(rng.normal(size=(150, 6)))]
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [(300, None), (301, [0.0] * 6), (302, [1.0]), (303, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = V.build(v, lists=5)
    assert index.rows.count() == 190 and len(index.centres) == 5
    want = sorted(map(tuple, R.vector_top(v.where("vec_id < 300"), asked(v, 10).where("query_id < 300"), 6).select("query_id", "vec_id", "score", "rank").collect()))
    assert sorted(map(tuple, V.search(index, asked(v, 10), 6, probes=5).select("query_id", "vec_id", "score", "rank").collect())) == want
    fewer = V.search(index, asked(v, 10), 6, probes=1)
    assert 0.2 < V.recall(fewer, spark.createDataFrame(want, "query_id long, vec_id long, score double, rank int")) < 1


def test_recall_of_the_query(spark):
    d = "/root/testdata/sf0.1"
    found = L.queries()["indexed_top10"](spark, d)
    exact = L.queries()["cosine_top10"](spark, d)
    assert found.columns == exact.columns and found.count() == exact.count() and V.recall(found, exact) >= 0.9


def test_index_of_nothing(spark):
    v = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<double>")
    for rows in (v, v.limit(0)):
        assert V.nearest(rows, asked(rows, 1), 3).count() == 0


def test_clustered_vectors_need_few_probes(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8)) * 4
    v = spark.createDataFrame([(i, list(map(float, centres[i % 12] + rng.normal(size=8) * 0.2))) for i in range(600)], "vec_id long, embedding array<double>")
    index = V.tuned(V.build(v, lists=12), v, asked(v, 20), 5)
    assert index.probes <= 2
