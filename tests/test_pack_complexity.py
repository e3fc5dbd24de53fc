"""What pack_complexity rests on: words and scripts of odd texts, pairs of very large packs, depths that need not be told apart."""

import numpy as np
from pyspark.sql import functions as F

from ctxloom.functions import text as T
from ctxloom.operators import graph as G
from ctxloom.operators import quality as Q

from .test_graph import longest

TEXTS = ["", None, " ", "  a bb Ccc ccc\x0bDDDD\x0ceeee\r\nffff\t ", "x\x1cyz a\x85bc d\xa0ef", "Äöü äÖÜ ß élan", "日本 ひらがな カタカナ 한글 текст", "שלום مرحبا हिन्दी ไทย", "123 _ ~", "abc " * 50]


def test_words_are_hashed_as_they_are_split(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "id int, t string").repartition(3)
    words = F.filter(F.split(F.lower(F.coalesce("t", F.lit(""))), r"\s+"), lambda x: F.length(x) > 2)
    got = rows.select("t", words.alias("words"), T.word_hashes(F.col("t"), 2).alias("h"), T.estimate_tokens(F.col("t")).alias("n"))
    got = got.withColumn("m", T.tokens_of(F.col("h.words"))).collect()
    assert len(got) == 3 * len(TEXTS) and all(r.n == r.m and len(r.words) == len(r.h.hashes) for r in got)
    pairs = {p for r in got for p in zip(r.words, r.h.hashes, strict=True)}
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs}) > 12


def test_script_bits_are_scripts(spark):
    got = spark.createDataFrame([(t,) for t in [*TEXTS, "Ãⱥ", "a\nи\nb", "Ж" * 3 + "a"]], "t string").select(T.scripts(F.col("t")).alias("n"), T.script_bits(F.col("t")).alias("b")).collect()
    assert [r.n for r in got] == [r.b.bit_count() for r in got] and max(r.n for r in got) > 3


def test_pairs_of_packs_beyond_46341_items(spark):
    n = 3_000_000
    got = Q.redundancy_pairs(spark.createDataFrame([("p", n), ("q", 300), ("r", 3)], "pack_id string, n int"))
    assert dict(got.dtypes)["a"] == dict(got.dtypes)["b"] == "int"
    pairs = {p: {(r.a, r.b) for r in rows} for p in "pqr" for rows in [got.where(F.col("pack_id") == p).collect()]}
    assert pairs["p"] == {(s, s + 1) for s in range(5000)} and pairs["r"] == {(0, 1), (0, 2), (1, 2)}
    assert pairs["q"] == {(s % 300, (s % 300 + 1 + s // 300) % 300) for s in range(3000)}


def test_different_hashes_in_order():
    x = np.random.default_rng(3).integers(0, 50, 400).astype(np.uint64)
    assert Q._different(x).tolist() == sorted(set(x.tolist())) and Q._different(x[:0]).tolist() == []


def test_depths_up_to_enough_are_exact(spark):
    # a ring of five with a tail, a chain, a node above both
    pairs = [(i, (i + 1) % 5) for i in range(5)] + [(2, 20), (20, 21)] + [(i, i + 1) for i in range(30, 34)] + [(50, 3), (50, 31)]
    edges = {a: [y for x, y in pairs if x == a] for a, _ in pairs}
    nodes = sorted({v for p in pairs for v in p})
    df, frame = spark.createDataFrame(pairs, "node long, needs long"), spark.createDataFrame([(v,) for v in nodes], "node long")
    want = {v: longest(edges, v) for v in nodes}
    assert max(want.values()) == 7
    for most, enough in ((2, 3), (G.PATHS, 4)):  # by components, and all at once
        got = {r.node: r.depth for r in G.depth(df, frame, most, enough).collect()}
        assert got.keys() == want.keys() and all(min(got[v], enough) == min(d, enough) for v, d in want.items())
    assert max(got.values()) < 7
