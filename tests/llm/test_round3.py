"""Repeated rows and periodic texts; spelling variants, lexical and vector search against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.llm import common, exact_search, lexical_search, minhash, spelling, suffix_dedup

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_removal(rows, length):
    where = defaultdict(set)
    for k, (_, t) in enumerate(rows):
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            where[raw[i : i + length]].add((k, i))
    out = Counter()
    for k, (doc, t) in enumerate(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - length + 1):
            if len(where[raw[i : i + length]]) > 1:
                gone[i : i + length] = 1
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        out[doc, len(raw), int(gone.sum()), spans] += 1
    return out


@pytest.mark.parametrize("limit", [0, 300, suffix_dedup.HOT_BYTES])
def test_periodic_texts_at_every_size_of_an_index(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", limit)
    rng = np.random.default_rng(7)
    noise = lambda n: "".join(rng.choice(list("bcdefghij "), n))
    texts = []
    for i in range(9):
        texts += ["a" * (57 + 3 * i), noise(20) + "xy" * (28 + i) + noise(9), noise(5) + "abcdefg" * (7 + i) + noise(30), noise(15) + "-" * (55 + i)]
    rows = [(i, t) for i, t in enumerate([*texts, "z" * 130, "q" * 60, None, ""])]
    rows += [rows[3]] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.removal_report(docs, 60).collect())
    assert got == brute_removal(rows, 60)


def test_runs_of_one_character_above_an_index(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), (F.col("id") * 2 + 401).cast("int")).alias("text"))
    assert suffix_dedup.removal_report(docs).agg(F.sum("n_removed")).first()[0] == 1_400_000


def test_copies_do_not_reach_the_index(spark, monkeypatch):
    rng = np.random.default_rng(1)
    body = " ".join(f"w{x}" for x in rng.integers(0, 5000, 300))
    rows, seen = [(1, body + " one"), (2, body + " two")], {}
    for copies in (1, 60):
        made = []

        def write(df, label, made=made):
            out = common.materialize(df, label)
            made.append((label, out.count()))
            return out

        monkeypatch.setattr(suffix_dedup, "materialize", write)
        docs = spark.createDataFrame(rows * copies + [(3 + i, rows[0][1]) for i in range(copies)], "doc_id long, text string").repartition(4)
        assert suffix_dedup.removal_report(docs, 100).where("n_removed > 0").count() == 3 * copies
        seen[copies] = {label: n for label, n in made if label in ("stretches", "bodies", "hot")}
    assert seen[1] == seen[60]


def test_copies_make_no_pairs_of_sets(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"w{x}" for x in rng.integers(0, 9000, 400)]
    a, b = " ".join(words), " ".join([*words[:-1], "end"])
    made = {}

    def write(df, label):
        out = common.materialize(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(minhash, "materialize", write)
    docs = spark.createDataFrame([(1, a)] * 50 + [(2, b)] * 50 + [(3, "")] * 20, "doc_id long, text string").repartition(4)
    out = Counter(tuple(r) for r in minhash.near_duplicates(docs, 3, 85).collect())
    assert out == {(1, 398, 1, True): 50, (2, 398, 1, False): 50, (3, 0, 3, True): 20}
    assert made["sets"] == 2 and made["links"] == 1


# spelling variants


def brute_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def brute_forms(n):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w in n:
        own = [v for v in n if v != w and near(w, v)]
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form = best if best and n[best] >= 2 * n[w] else None
        out[w] = (form, len(own), n[form] if form else None)

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return {(w, f, root(w), n[w], k, fn) for w, (f, k, fn) in out.items()}


@pytest.mark.parametrize("block", [3, spelling.BLOCK])
def test_spelling_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = ["colour", "naïveté", "ÉCOLE", "aaaaaa", "abcabc", "straße", "letters", "zzzzzzzz", "abcdé", "×÷×÷×"]
    words = []
    for _ in range(900):
        w = list(base[rng.integers(len(base))])
        for _ in range(rng.integers(0, 3)):
            i, kind = rng.integers(len(w)), rng.integers(3)
            if kind == 0:
                w.insert(i, "abzéÉ"[rng.integers(5)])
            elif kind == 1:
                w[i] = "abzéÉ"[rng.integers(5)]
            else:
                del w[i]
        words.append("".join(w))
    rows = [(i, " ".join(rng.choice(words, 60)) + ".,9 x" * 3) for i in range(60)]
    rows += [(None, rows[0][1]), (7, None), (8, ""), rows[3], rows[3], (-5, "Colour" * 3 + "-colour1COLOURĀcolour")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in spelling.group_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute_forms(brute_words(rows))
    assert len(got) == len(want) and set(got) == want and any(r[1] for r in want)
    assert any(r[2] != r[0] and r[2] != r[1] for r in want)


def test_one_edit_shares_a_place_whatever_it_is():
    rng = np.random.default_rng(9)
    letters = "abcxyzéÉß×"
    for _ in range(3000):
        a = "".join(rng.choice(list(letters), rng.integers(5, 10)))
        i, c = rng.integers(len(a) + 1), letters[rng.integers(len(letters))]
        for b in {a[:i] + c + a[i:], a[:i] + a[i + 1 :], a[:i] + c + a[i + 1 :]} - {a}:
            assert spelling.one_edit(a, b) and spelling.one_edit(b, a)
            mask = [spelling.letter_mask(w) for w in (a, b)]
            places = [{(k, r, p) for k, r, p in spelling.meeting_places(w, m)} for w, m in zip((a, b), mask, strict=True)]
            met = {p for k, r, p in places[0] for k2, r2, p2 in places[1] if k == k2 and {r, r2} in ({0}, {1, 2}) and p == p2}
            assert spelling._first_place(a, b, *mask) == min(met)


def test_spelling_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, word string")
    assert spelling.group_variants(empty).count() == 0
    rows = spark.createDataFrame([(1, "one two", "x"), (2, None, "y")], "doc_id long, text string, word string")
    assert spelling.group_variants(rows).count() == 0


# lexical search


def brute_ranks(docs, items, k=20):
    terms = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    terms = [(d, c) for d, c in terms if c]
    big_n, big_l = len(terms), sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        want = Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for d, c in terms:
            m = 75 + (25 * c.total() * big_n) // big_l
            s = sum(q * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in want.items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.mark.parametrize("small", [False, True])
def test_lexical_search_equals_brute_force(spark, monkeypatch, small):
    if small:  # many shards, many blocks of items, an index of all terms
        for name, value in (("SHARD_DOCS", 30), ("PAIRS", 40), ("VOCABULARY", 0)):
            monkeypatch.setattr(lexical_search, name, value)
        monkeypatch.setattr(lexical_search, "slices", lambda batches: (b.slice(i, 7) for b in batches for i in range(0, b.num_rows, 7)))
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(60)] + ["Ärger", "naïve", "X9", "日本"]
    weights = 1 / np.arange(1, len(vocab) + 1)
    text = lambda n: "-".join(rng.choice(vocab, n, p=weights / weights.sum()))
    docs = [(i, text(rng.integers(1, 80))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [docs[9], docs[9], (2000, None), (2001, ""), (2002, " .,"), (None, docs[4][1]), (2003, text(5000))]
    items = [(i, text(rng.integers(1, 12)).upper()) for i in range(14)] + [(3, "w1 w1 w2"), (20, None), (21, "absent"), (22, "w59 w0")]
    got = lexical_search.search_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"))
    assert Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == brute_ranks(docs, items)


def test_lexical_search_of_nothing(spark):
    docs, items = (spark.createDataFrame([], f"{c} long, text string, item long") for c in ("doc_id", "item_id"))
    some = spark.createDataFrame([(1, "a b", 3)], "doc_id long, text string, item long")
    asked = spark.createDataFrame([(1, "a", 3)], "item_id long, text string, item long")
    assert lexical_search.search_items(docs, items).count() == 0
    assert lexical_search.search_items(docs, asked).count() == 0
    assert lexical_search.search_items(some, items).count() == 0
    # one document that holds the term: ln(4 / 3) weighs it
    assert [tuple(r) for r in lexical_search.search_items(some, asked).collect()] == [(1, 1, 1, 287 * (10**9 // (1000 + 1200)))]


def test_blocks_cost_the_least_that_any_cut_costs():
    rng = np.random.default_rng(13)
    for n, longest in ((1, 4), (7, 4), (11, 16)):
        x = rng.integers(1, 1000, n)
        price = max(1.0, 2.0 * x.std())
        ends = lexical_search.block_ends(np.concatenate([x, x[::-1]]), np.array([0, n, 2 * n]), longest, 2.0)

        def cost(cut, x=x, price=price):
            parts = np.split(x, cut[:-1])
            return math.inf if max(map(len, parts)) > longest else sum(len(p) * p.max() - p.sum() + price for p in parts)

        every = (cost([*(i + 1 for i in range(n - 1) if mask >> i & 1), n]) for mask in range(1 << (n - 1)))
        assert math.isclose(cost(ends[0].tolist()), min(every))


def test_search_skips_blocks():
    rng = np.random.default_rng(17)
    docs = np.arange(8192)
    impacts = rng.integers(1, 100, 8192)
    impacts[4000:4020] = 5000
    shard = lexical_search.Shard(np.array([3], np.uint64), np.array([0, 8192]), docs, impacts, 8192)
    found, scores = shard.search(np.array([3], np.uint64), np.array([7]), 20)
    assert sorted(found) == list(range(4000, 4020)) and set(scores) == {35000} and shard.read < 1000


# exact vector search


def brute_top(rows, k, every):
    fine = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, (q, v) in enumerate(fine):
        if q is None or q % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), c is None, c or 0) for b, (c, w) in enumerate(fine) if a != b and len(v) == len(w))
        out.update((q, r + 1, None if none else c, -s) for r, (s, none, c) in enumerate(scores[:k]))
    return out


@pytest.mark.parametrize("scale", [1, 3000, 10**5])
def test_exact_search_equals_brute_force(spark, monkeypatch, scale):
    for name, value in (("BLOCK", 40), ("QUERIES", 9), ("STEP", 3), ("BATCH", 4)):
        monkeypatch.setattr(exact_search, name, value)
    rng = np.random.default_rng(19)
    vectors = rng.normal(size=(260, 10)) * scale
    vectors[:, 3] *= 8
    rows = [(i, list(map(float, v))) for i, v in enumerate(vectors)]
    rows += [(300 + i, rows[7][1]) for i in range(30)] + [rows[10]] * 3 + [rows[11]] * 9 + [(20, rows[12][1]), (None, rows[10][1]), (40, None)]
    rows += [(400, [1.0, None] + [0.0] * 8), (410, [math.nan] + [0.0] * 9), (420, [math.inf] + [0.0] * 9), (430, [1.0, 2.0]), (431, [-1.0, 0.5]), (440, []), (441, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dims", F.lit("x"))
    got = exact_search.top_inner_products(df, 5, 10)
    assert Counter(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(rows, 5, 10)
    assert exact_search.top_inner_products(df.limit(0)).count() == 0


def test_products_beyond_doubles_are_exact():
    rng = np.random.default_rng(23)
    block, queries = rng.integers(-(2**30), 2**30, (6, 50)).astype(float), rng.integers(-(2**30), 2**30, (6, 2)).astype(float)
    for i, (at, score) in enumerate(exact_search.survivors(block, queries, np.full(2, -np.inf), 3)):
        assert [int(s) for s in score] == [sum(int(x) * int(y) for x, y in zip(block[:, j], queries[:, i], strict=True)) for j in at]


def test_bounds_compact_candidates():
    rng = np.random.default_rng(29)
    block = np.floor(256 * rng.normal(size=(64, 4000)) * np.linspace(1, 0.05, 64)[:, None])
    queries = block[:, :10]
    for i, (at, score) in enumerate(exact_search.survivors(block, queries, np.full(10, -np.inf), 6)):
        want = np.sort(queries[:, i] @ block)[-6:]
        assert len(at) < 200 and np.array_equal(np.sort(score)[-6:], want.astype(int))
