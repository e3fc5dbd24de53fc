"""Packs with variants and summaries against a plain walk, and how often the model is called."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.functions.hooks import summaries
from ctxloom.operators import summary_pack as S

SCHEMA = "pack_id int, ord long, content string, tokens long, sizes array<long>, score double, recency double, budget long"


def shorten(asked):
    out = []
    for text, room in asked:
        words = text.split()
        if len(words) % 4 == 0:
            out.append(None)
        elif len(words) % 4 == 1:
            out.append(("too long", room + 1))
        else:
            out.append((" ".join(words[: max(1, room // 3)]), None if len(words) % 2 else 1 + room // 2))
    return out


def walk(rows):
    out = {}
    for pack in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == pack), key=lambda r: (-(r[5] or 0), -(r[6] or 0), r[1]))
        left = max(0, own[0][7])
        for _, ord_, text, tokens, sizes, *_ in own:
            form = tokens if tokens <= left else max((v for v in sizes or () if v <= left), default=None)
            said = None
            if form is None and left > 0 and text is not None:
                got = shorten([(text, left)])[0]
                if got:
                    size = got[1] if got[1] is not None else max(1, math.ceil(len(got[0].split()) * 1.3)) if got[0].strip() else 0
                    said = (got[0], size) if size <= left else None
            decision = "exclude" if form is None and said is None else "summarize" if form is None else "include" if form == tokens else "compress"
            eaten = form if form is not None else said[1] if said else None
            out[pack, ord_] = (decision, eaten, said[0] if said else None)
            left -= eaten or 0
    return out


@pytest.mark.parametrize(("width", "ahead"), [(3, 1), (5, 4), (1000, 8)])
def test_summary_pack_equals_a_walk(spark, width, ahead):
    rng = np.random.default_rng(7)
    rows = []
    for pack in range(4):
        for i in range(25):
            n = int(rng.integers(1, 60))
            sizes = [int(n * x) for x in rng.random(2)] if rng.random() < 0.7 else None
            text = None if rng.random() < 0.1 else " ".join(["w"] * n)
            rows.append((pack, i, text, n, sizes, float(rng.integers(0, 6)) if rng.random() < 0.9 else None, float(rng.integers(0, 2)), [250, 160, 0, 10_000][pack]))
    got = {(r["pack_id"], r["ord"]): (r["decision"], r["taken_tokens"], r["summary"]) for r in S.summary_pack(spark.createDataFrame(rows, SCHEMA), shorten, width, ahead).collect()}
    want = walk(rows)
    assert got == want and {d for d, _, _ in want.values()} == {"include", "compress", "summarize", "exclude"}


def test_nothing_to_pack(spark):
    assert S.summary_pack(spark.createDataFrame([], SCHEMA), shorten).count() == 0


def test_one_call_for_many_texts(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def count(asked):
        with open(calls, "a") as f:
            f.write(f"{len(asked)}\n")
        return [("x", 1) for _ in asked]

    rows = spark.range(0, 500, 1, 1).select(F.when(F.col("id") % 5 > 0, F.lit("a b c")).alias("t"), (F.col("id") % 2).alias("room"))
    assert summaries(rows, "t", "room", count).where("summary is not null").count() == 200
    assert open(calls).read().split() == ["200"]


def test_a_pack_that_stands_still_is_done_in_few_rounds(spark, monkeypatch):
    rounds, stored = [], S.stored

    def counted(df):
        if "decision" in df.columns and "room" in df.columns:
            rounds.append(1)
        return stored(df)

    monkeypatch.setattr(S, "stored", counted)
    rows = [(0, i, "w w w", 3, None, 0.0, 0.0, 1) for i in range(400)]
    got = S.summary_pack(spark.createDataFrame(rows, SCHEMA), lambda asked: [None for _ in asked], ahead=8)
    assert got.where("decision = 'exclude'").count() == 400 and len(rounds) < 8
