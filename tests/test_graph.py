"""Components and depths of random graphs against a plain search."""

import random

from ctxloom.operators import graph as G


def reach(edges, v):
    seen, open_ = set(), [v]
    while open_:
        for w in edges.get(open_.pop(), ()):
            if w not in seen:
                seen.add(w)
                open_.append(w)
    return seen


def longest(edges, v, seen=()):
    best = 0
    for w in edges.get(v, ()):
        best = max(best, 1 if w in (*seen, v) else 1 + longest(edges, w, (*seen, v)))
    return best


def graph(seed):
    r = random.Random(seed)
    pairs = {(r.randrange(14), r.randrange(16)) for _ in range(17)} | {(20, 20), (21, 20), (30, 31), (31, 32), (32, 30), (32, 33), (33, 34), (34, 33), (40, 30)}
    edges: dict[int, set[int]] = {}
    for a, b in pairs:
        edges.setdefault(a, set()).add(b)
    return pairs, edges


def test_components_and_depths(spark):
    for seed in (1,):
        pairs, edges = graph(seed)
        df = spark.createDataFrame(sorted(pairs), "node long, needs long")
        got = {r["node"]: r["component"] for r in G.cycles(df.withColumnRenamed("needs", "at")).collect()}
        on = {v for v in edges if v in reach(edges, v)}
        assert set(got) == on
        assert all((got[a] == got[b]) == (b in reach(edges, a) and a in reach(edges, b)) for a in on for b in on if a != b)
        nodes = sorted({v for p in pairs for v in p} | {99})
        want = {v: longest(edges, v) for v in nodes}
        for most in (3, G.PATHS):  # by components, and all at once
            depth = {r["node"]: r["depth"] for r in G.depth(df, spark.createDataFrame([(n,) for n in nodes], "node long"), most).collect()}
            assert depth == want


def test_no_edges_and_no_nodes(spark):
    none = spark.createDataFrame([], "node long, needs long")
    assert [tuple(r) for r in G.depth(none, spark.createDataFrame([(1,), (1,)], "node long")).collect()] == [(1, 0)]
    assert G.depth(none, none.select("node")).count() == 0 and G.cycles(none.withColumnRenamed("needs", "at")).count() == 0
