"""Segments by meaning and by surprise against a plain walk over each text's sentences."""

import math
import re
import statistics
from collections import Counter

import numpy as np
import pytest

from ctxloom.functions.text import PROTECTED
from ctxloom.operators import segmentation as G
from ctxloom.plans.segment_queries import embed, surprise

ENTITIES = ["one. Two", "Big! House"]


def tokens(s):
    return max(1, math.ceil(len(s.split()) * 1.3))


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0


def split(text, entities):
    own, at, safe = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()], 0, []
    held = re.compile(PROTECTED + (r"|\b(?:" + "|".join(map(re.escape, entities)) + r")\b" if entities else ""))
    for s in own:
        at = text.index(s, at) + len(s)
        safe.append(not any(m.start() < at < m.end() for m in held.finditer(text)))
    return own, safe


def walk_meaning(text, threshold, limit, entities):
    own, safe = split(text, entities)
    n = len(own)
    if n < 2:
        return own
    v = embed(own)
    scores = []
    for i in range(1, n):
        around = v[max(0, i - 5) : min(n, i + 5)]
        near = [cosine(a, b) for a, b in zip(around, around[1:], strict=False)]
        spread = round(statistics.variance(near), 9) if len(near) > 1 else 0.0
        w = math.ceil(5 - min(1.0, spread * 10) * 4)
        a, b = np.mean(v[max(0, i - w) : i], axis=0), np.mean(v[i : min(n, i + w)], axis=0)
        scores.append(round(cosine(a, b), 9))
    out, now = [], []
    for i, s in enumerate(scores):
        now.append(own[i])
        low = 0 < i < len(scores) - 1 and s < scores[i - 1] and s < scores[i + 1]
        if (s < threshold or low or sum(map(tokens, now)) > limit) and safe[i]:
            out.append(" ".join(now))
            now = []
    if now or not out:
        return [*out, " ".join([*now, own[-1]])]
    return [*out[:-1], out[-1] + " " + own[-1]]


def walk_surprise(text, z, limit, entities):
    own, safe = split(text, entities)
    if len(own) < 2:
        return own
    x = surprise(own)
    mean, dev = statistics.mean(x), statistics.stdev(x)
    out, now, size = [], [], 0
    for s, v, fine in zip(own, x, safe, strict=True):
        if now and dev > 0 and round((v - mean) / dev, 9) > z and fine:
            out.append(" ".join(now))
            now, size = [s], tokens(s)
            continue
        now.append(s)
        size += tokens(s)
        if size > limit and fine:
            out.append(" ".join(now))
            now, size = [], 0
    return [*out, " ".join(now)] if now else out


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    words = ["one", "two", "Big", "House", "extraordinary", "NASA", "2024-01-02", "v1.2.3", "é", "word", "x"]
    out = [None, "", "  \n", "One.", "no end at all", "a. b! c? d", ".. . ! x", "Ends here.  \n"]
    for _ in range(60):
        own = [" ".join(rng.choice(words, rng.integers(1, 12))) + ".!?"[rng.integers(3)] for _ in range(rng.integers(1, 40))]
        out.append("".join(s + [" ", "  ", "\n\n", " \t"][rng.integers(4)] for s in own))
    out += ["say one. Two and Big! House. So it is. one. Two. Big! House! one. Two"]
    return out


@pytest.mark.parametrize("chunk", [5, 8192])
@pytest.mark.parametrize("entities", [[], ENTITIES])
def test_segments_equal_a_walk(spark, monkeypatch, texts, chunk, entities):
    monkeypatch.setattr(G, "CHUNK", chunk)
    docs = spark.createDataFrame([*enumerate(texts), (9, texts[9])], "doc_id long, text string")
    for limit in (12, 60):
        got = Counter(tuple(r) for r in G.semantic(docs, embed, threshold=0.8, limit=limit, entities=entities).collect())
        want = [(i, k, s) for i, t in [*enumerate(texts), (9, texts[9])] for k, s in enumerate(walk_meaning(t or "", 0.8, limit, entities))]
        assert got == Counter(want)
        got = Counter(tuple(r) for r in G.surprise(docs, surprise, z=1.0, limit=limit, entities=entities).collect())
        assert got == Counter((i, k, s) for i, t in [*enumerate(texts), (9, texts[9])] for k, s in enumerate(walk_surprise(t or "", 1.0, limit, entities)))
    assert G.semantic(docs.limit(0), embed).count() == 0


def test_hybrid_numbers_each_row(spark, texts):
    docs = spark.createDataFrame([(1, texts[20]), (1, texts[21]), (2, None)], "doc_id long, text string")
    rows = G.hybrid(docs, embed, surprise, limit=20).collect()
    first = [r["body"] for r in rows if r["segment"] == 0]
    assert len(first) == 2 and all(r["doc_id"] == 1 for r in rows)


def test_table_functions_give_the_same_segments(spark, texts):
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    G.register_segmenters(spark, embed, surprise)
    for name, want in (("meaning_segments", G.semantic(docs, embed)), ("surprise_segments", G.surprise(docs, surprise))):
        got = spark.sql(f"select * from {name}(table(select doc_id, text from {{docs}}) partition by doc_id)", docs=docs)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
