"""Texts are parted once, whatever is asked of them, and no query makes a row of each pair."""

import math

import numpy as np
from pyspark.sql import functions as F

from ctxloom.functions import text as T
from ctxloom.operators import packing as P
from ctxloom.operators import retrieval as R
from ctxloom.plans import model as M
from ctxloom.plans import text_queries as X

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_query_relevance_parts_each_text_once_a_pattern(spark):
    p = plan(X.query_relevance(spark, SF))
    assert p.count("regexp_extract_all(") == 4, p


def test_own_bm25_counts_without_a_scan_for_each_query_token(spark):
    rows = [(0, ["a", "b", "a", "z"], ["a", "c", "a", "b"]), (1, [], ["a"]), (2, ["a"], []), (3, None, ["a"]), (4, ["a"], None), (5, [], None), (6, ["x", None], [None, "x", None]), (7, ["b"], ["a"])]
    df = spark.createDataFrame(rows, "k int, q array<string>, t array<string>").select("k", T.own_bm25(F.col("q"), F.col("t")).alias("s"))
    assert "lambda" not in plan(df)
    idf = math.log(0.5 / 1.5 + 1)
    one = {n: idf * n * 2.2 / (n + 1.2) for n in (0, 1, 2)}
    want = {0: one[2] + one[1] + one[2] + one[0], 1: 0.0, 2: 0.0, 3: None, 4: None, 5: 0.0, 6: one[1], 7: 0.0}
    got = {r.k: r.s for r in df.collect()}
    assert {k: None if v is None else round(v, 12) for k, v in got.items()} == {k: None if v is None else round(v, 12) for k, v in want.items()}


def ranked_pairs(scored, k):
    kept = {}
    for q, d, s in sorted(scored, key=lambda x: (x[0], [-v for v in (x[2] if isinstance(x[2], tuple) else (x[2],))], x[1])):
        kept.setdefault(q, []).append((d, s))
    return {(q, d, s, n + 1) for q, own in kept.items() for n, (d, s) in enumerate(own[:k])}


def test_best_of_many_queries_in_cells(spark, monkeypatch):
    """Small blocks, repeated documents and query terms, ties, empty and null texts: as from all pairs."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 30, int(rng.integers(0, 25)))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (60, None), (61, texts[1]), (5, "w1 w2 w1"), (62, "w0")], "doc_id long, text string")
    asked = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 33, 6))) for i in range(9)] + [(9, "zz"), (10, None)], "query_id long, text string")
    all_pairs = [(r.query_id, r.doc_id, math.floor(r.score * 1e6 + 0.5) / 1e6) for r in R.bm25(docs, asked).collect()]
    for name, value in (("DOCUMENTS", 7), ("QUERIES", 3), ("MATRIX", 50)):
        monkeypatch.setattr(R, name, value)
    got = R.bm25_top(docs, asked, 4)
    assert {(r.query_id, r.doc_id, r.score, r["rank"]) for r in got.collect()} == ranked_pairs(all_pairs, 4)
    # nothing that is left to run reads a text or makes a row of each pair
    assert "split(" not in plan(got) and "regexp" not in plan(got) and "Join" not in plan(got).split("FlatMapCoGroups")[0]
    words = {}
    for i, t in ((r.doc_id, r.text or "") for r in docs.collect()):
        words.setdefault(i, []).extend(t.split())
    hits = []
    for q, t in ((r.query_id, set((r.text or "").split())) for r in asked.collect()):
        hits += [(q, d, (len(t & set(own)), sum(w in t for w in own))) for d, own in words.items() if t & set(own)]
    counts = R.Counted(docs, asked)
    found = counts.best(counts.weighted(1.2, 0.75), 4, hits=True)
    assert {(r.query_id, r.doc_id, tuple(r.score), r["rank"]) for r in found.collect()} == ranked_pairs(hits, 4)


def test_packed_texts_are_read_for_the_chosen_alone(spark, monkeypatch):
    """The items with a text are the chosen documents, repeated ids and blank texts as in one packing with the texts."""
    docs = [(1, "a b c", "en", "p"), (1, "d " * 3000, "en", "p"), (1, "e", "en", "q"), (2, " ", "en", "p"), (3, "x " * 1000, "en", "p"), (4, "y " * 1400, "en", "p"), (5, None, "en", None), (6, "z", None, None)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(3, 1), (3, 0)], "doc_id long, quality int")
    monkeypatch.setattr(M, "table", lambda spark, d, name: {"documents": rows, "labels": labels}[name])
    seen, items = [], M.items

    def counted(spark, d, content=False, docs=None):
        out = items(spark, d, content, docs)
        if content:
            seen.append(out.count())
        return out

    want = P.greedy(items(spark, SF, content=True), ["pack_id"]).where("chosen")
    monkeypatch.setattr(M, "items", counted)
    got = M.chosen_texts(spark, SF, M.decided(spark, SF)).select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count() == 6
    assert seen == [6]


def test_tokens_are_words_of_one_pattern(spark):
    texts = ["", " ", None, "a", " a  b\n", "\x0b\x1fa b c\x0c", "x" * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string").select("k", T.estimate_tokens(F.col("t")).alias("n"))
    assert [r.n for r in df.orderBy("k").collect()] == [0, 0, 0, 2, 3, 3, 2] and plan(df).count("regexp") == 1
