"""Retrieval by gain: what is read for it, and its cells against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.operators import retrieval as R
from ctxloom.plans import flow_queries as L


def test_texts_are_split_once(spark, tmp_path, monkeypatch):
    """Only texts of a candidate or of the context are split, and each once."""
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"w{x}" for x in rng.choice(60, 1 + i % 9))) for i in range(400)]
    vectors = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    split, own = spark.sparkContext.accumulator(0), L.T.tokens

    @F.udf("string")
    def seen(text):
        split.add(1)
        return text

    monkeypatch.setattr(L.T, "tokens", lambda text: own(seen.asNondeterministic()(text)))
    got = {(r["query_id"], r["id"]): r["gain"] for r in L.retrieve_by_gain(spark, str(tmp_path)).collect()}
    near = {i for _, i in got}
    assert got and near <= set(range(60)) and 0 < split.value <= 68
    sets = {i: {w for w in t.split() if len(w) > 1} for i, t in texts}
    for (_, i), gain in got.items():
        best = max(len(sets[i] & sets[k]) / len(sets[i] | sets[k]) for k in range(0, 400, 50))
        assert abs(gain - ((1 - best) * 0.6 + 0.2)) < 1e-6 and gain >= 0.65 - 1e-6


@pytest.mark.parametrize(("block", "cell_pairs"), [(8, 1 << 21), (500, 40)])
def test_largest_jaccard_of_common_and_rare_words(spark, monkeypatch, block, cell_pairs):
    rng = np.random.default_rng(block)

    def some(i):
        return sorted({f"w{x}" for x in rng.zipf(1.3, int(rng.integers(0, 80))) if x < 3000} | ({"the"} if i % 7 else set()))

    a, b = [(i, some(i)) for i in range(130)], [(i, some(i)) for i in range(90)]
    monkeypatch.setattr(R, "CONTEXT_BLOCK", block)
    monkeypatch.setattr(R, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(R, "SET_WORDS", 20)
    monkeypatch.setattr(R, "_largest_jaccard", lambda own=R._largest_jaccard: own(cell_pairs))
    gains = R.information_gain(spark.createDataFrame(a, "id long, words array<string>"), spark.createDataFrame(b, "ctx long, words array<string>"))
    got = {r["id"]: r["novelty"] for r in gains.collect()}
    want = {i: 1 - max((len(set(x) & set(y)) / len(set(x) | set(y)) for _, y in b if x and y), default=0.0) for i, x in a}
    assert got == want


def test_nearest_vectors_with_ties_lengths_and_no_numbers(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(600)]
    rows[7], rows[11], rows[12], rows[40] = (7, None), (11, []), (12, [1.0, 2.0]), (40, [0.0, 0.0, 0.0])
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))

    def score(x, y):
        if not x or not y or len(x) != len(y):
            return 0.0
        m = np.linalg.norm(x) * np.linalg.norm(y)
        return float(np.floor(np.dot(x, y) / (m or 1) * 1e6 + 0.5) / 1e6)

    got = {}
    for r in R.vector_top(v, asked, 7, cells=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in range(0, 600, 20):
        order = sorted((i for i in range(600) if i != q), key=lambda i: (-score(rows[i][1], rows[q][1]), i))[:7]
        assert [i for _, i in sorted(got[q])] == order
