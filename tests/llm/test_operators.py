"""The training-data operators against brute force, round trips and held-out accuracy, with odd rows throughout."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.llm import common, components, importance, language_id, minhash, mixing, packing, quality_rules, sharding, suffix_dedup, toxicity
from ctxloom.llm.fingerprints import fingerprint_documents

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _block string, size string"


def rows():
    rng = np.random.default_rng(1)
    vocab = [f"w{i}é" if i % 9 == 0 else f"W{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocab, n)) for n in (90, 120, 150, 200, 400, 60, 75)]
    passage = " ".join(rng.choice(vocab, 130))
    out = list(texts)
    out += [texts[0], texts[0].lower(), texts[1] + " tail of it", texts[2].replace(" ", "\n", 3)]
    out += [passage + " " + texts[5], texts[6] + " " + passage, "x " + passage + " y " + passage]
    out += [None, "", " \t\n ", "one", "two words", "two words", "a b c", "A B C", "ab" * 600, "#$%& " * 30, "line\nline\nline\n\n \n"]
    out += [" ".join(texts[4].split()[:380]), "w " * 3000]
    docs = [(i, t, "en", ["s1", "s2", None][i % 3], None, "x", "y", "z") for i, t in enumerate(out)]
    return [*docs, docs[0], (None, texts[3], None, None, None, "x", "y", "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(width, percent):
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for i, t, *_ in rows():
        w = WORDS.findall((t or "").translate(lower))
        grams = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.append((i, grams))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return Counter((i, len(g), least.get(root(k))) for k, (i, g) in enumerate(sets))


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_minhash_equals_brute_force(docs, empty, width, percent):
    got = minhash.near_duplicates(docs, width, percent).collect()
    assert Counter((r[0], r[1], r[2]) for r in got) == brute_components(width, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert minhash.near_duplicates(empty).count() == 0


def test_buckets_of_several_components(spark):
    """Round 2: links that no least member of a bucket shows are found, each joining once."""
    base = np.arange(100, dtype=np.uint64)
    sets = [base, np.concatenate([base[:60], base[60:] + 1000]), np.concatenate([base[:60], base[60:] + 1000])[:-2]]
    sig = np.stack([minhash.signatures(s, np.array([0]))[0] for s in sets])
    assert minhash._links_inside(sig, [np.sort(s) for s in sets], [1, 2, 3], [1, 2, 3], 85) == [(2, 3)]


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 99), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 99: 99, 100: 99}


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(3)).collect()))
    sizes = Counter()
    for _, t, _, s, *_ in rows():
        sizes[s] += len(WORDS.findall(t or ""))
    assert len(got) == len(rows()) and all(r["taken"] <= 2 * r["size"] for r in got)
    total = 0
    for s, size in sizes.items():
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {size}
        target = own[0]["target"]
        assert target <= 2 * size and abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own)
        total += target
    assert abs(total - 1.5 * sum(sizes.values())) < 1e-6
    assert mixing.mix(empty).count() == 0


def test_mixing_keeps_expectations(spark):
    units = spark.createDataFrame([("s", i, 10, 3000, 1000.0) for i in range(300)], "source string, doc_id long, size long, source_size long, target double")
    taken = sum(r["copies"] * r["size"] for r in mixing.pivotal_copies(units).collect())
    assert abs(taken - 1000) <= 10


def test_mixed_documents_repeat_as_taken(docs):
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    words = out.select("source", common.n_words(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n").alias("n"))
    want = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    assert all(abs(r["n"] - want[r["source"]]) <= 3000 for r in words.collect())


def test_boundaries_are_optimal():
    lengths, counts = np.array([1.0, 2, 5, 9, 10, 30]), np.array([3.0, 1, 4, 1, 5, 2])

    def cost(ends):
        return sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts, strict=True))

    for k in (1, 2, 3, 4, 9):
        best = min(cost([*e, 30.0]) for n in range(min(k, 6)) for e in itertools.combinations(lengths[:-1], n))
        ends, padding = packing.optimal_boundaries(lengths, counts, k)
        assert padding == best == cost(ends) and len(ends) <= k
    assert packing.optimal_boundaries(lengths[:0], counts[:0], 3) == ([], 0)


def test_packing(docs, empty):
    got = packing.pack(docs, buckets=4, budget=500).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, len(WORDS.findall(t or ""))) for i, t, *_ in rows())
    for _, batch in itertools.groupby(sorted(got, key=lambda r: r["batch_id"]), key=lambda r: r["batch_id"]):
        batch = list(batch)
        assert len({r["bucket_len"] for r in batch}) == 1 and sorted(r["slot"] for r in batch) == list(range(len(batch)))
        assert len(batch) == 1 or sum(r["n_tokens"] + r["padding"] for r in batch) <= 500
    assert packing.pack(empty).count() == 0


def brute_removal(length):
    raw = [(i, (t or "").encode()) for i, t, *_ in rows()]
    seen = Counter(b[k : k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = Counter()
    for i, b in raw:
        spans = []
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + length
                else:
                    spans.append([k, k + length])
        kept, last = b"", 0
        for a, e in spans:
            kept, last = kept + b[last:a], e
        kept += b[last:]
        out[(i, len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("length", [400, 60])
def test_suffix_dedup_equals_brute_force(docs, empty, length):
    got = suffix_dedup.removal_report(docs, length).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute_removal(length)
    # the text left is that of the digest wherever no run cuts a character
    assert sum(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in got) >= len(got) - 3
    assert suffix_dedup.removal_report(empty).count() == 0


def test_hot_anchors_are_cut_again(docs, monkeypatch):
    """Every anchor counts as hot: whole windows decide at last, and the result is the same."""
    for limit in (0, 300, 3000):
        monkeypatch.setattr(suffix_dedup, "HOT_BYTES", limit)
        assert Counter(tuple(r)[:5] for r in suffix_dedup.removal_report(docs, 60).collect()) == brute_removal(60)


def test_run_index_statistics():
    texts = [b"abracadabra", b"cadabrab", b"zzzzz"]
    index = suffix_dedup.RunIndex(texts)
    best, joined = index.matching_statistics(), texts

    def longest(t, k):
        own, out = texts[t][k:], 0
        for s, x in enumerate(joined):
            for j in range(len(x)):
                if (s, j) != (t, k):
                    n = 0
                    while n < len(own) and j + n < len(x) and x[j + n] == own[n]:
                        n += 1
                    out = max(out, n)
        return out

    for t, x in enumerate(texts):
        assert [best[index.starts[t] + k] for k in range(len(x))] == [longest(t, k) for k in range(len(x))]
    assert index.runs < len(index.text)


def test_removed_text_stays_valid(docs):
    out = suffix_dedup.remove_repeats(docs, 60)
    assert out.columns == docs.columns and out.count() == len(rows())
    assert out.where("n_chars <> char_length(text)").count() == 0


def test_fingerprints(docs, empty):
    ids = [r for r in rows() if r[0] is not None][:-1]
    got = {r["doc_id"]: r for r in fingerprint_documents(docs.dropDuplicates(["doc_id"]).where("doc_id is not null")).collect()}
    text = {i: t or "" for i, t, *_ in ids}
    for i, t in text.items():
        nxt = text[i - 1] if i - 1 in text else text[max(text)]
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (t == edited) and 0 <= r["near_next"] <= 1
    same = Counter(got[i]["fingerprint"] for i in text)
    assert same == Counter({got[i]["fingerprint"]: c for t, c in Counter(text.values()).items() for i in [next(k for k in text if text[k] == t)]})
    assert fingerprint_documents(docs).count() == len(rows()) and fingerprint_documents(empty).count() == 0


def test_fingerprint_ranges_do_not_change_the_next(spark):
    from ctxloom.llm.fingerprints import with_next

    df = spark.createDataFrame([(i * i, f"t{i}", f"f{i}") for i in range(50)], "doc_id long, text string, fingerprint string")
    got = {r["doc_id"]: r["next_text"] for r in with_next(df, block=7).collect()}
    assert got == {i * i: f"t{i - 1 if i else 49}" for i in range(50)}


def brute_base(t):
    t = t or ""
    w = WORDS.findall(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    symbols = sum(c in "#*$%&|<>" for c in t)
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_quality_base_rules(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 1), (23, 0), (None, 1), (2, None)], "doc_id long, quality int")
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = quality_rules.judge(docs, labels).collect()
    assert Counter(tuple(r[c] for c in base) for r in got) == Counter((i, *brute_base(t)) for i, t, *_ in rows())
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality_rules.judge(empty, labels).count() == 0
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_quality_ratio_rejects_junk(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = quality_rules.judge(d, labels).where("not base_failed").join(labels, "doc_id")
    kept = {r["quality"]: r["k"] for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()}
    assert kept[1] > 0.99


def test_importance_draws_exactly_k(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (1, 1), (23, 0)], "doc_id long, quality int")
    got = importance.resample(docs, labels, fraction=0.5).collect()
    k = round(0.5 * len(rows()))
    assert len(got) == len(rows()) and sum(r["selected"] for r in got) == k
    least = min(r["gumbel_key"] for r in got if r["selected"])
    assert all(r["gumbel_key"] <= least for r in got if not r["selected"])
    assert importance.resample(empty, labels).count() == 0


def test_top_k_with_ties(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(100)], "id long, v double")
    for k in (0, 1, 33, 40, 66, 100):
        picked = sorted(r["id"] for r in importance.top_k(df, "v", ["id"], k, "s").where("s").collect())
        assert picked == sorted(i for _, i in sorted((-(i % 3), i) for i in range(100))[:k])


def test_kth_largest_narrows_to_few_rows(spark):
    rng = np.random.default_rng(4)
    for values in (rng.normal(size=3000), rng.integers(0, 3, 3000) * 1.0, np.repeat([7.0, -1.0], [2999, 1]), np.full(50, 2.0)):
        df = spark.createDataFrame([(float(x),) for x in values], "v double")
        for k in (1, len(values) // 3, len(values)):
            cut = sorted(values, reverse=True)[k - 1]
            assert importance.kth_largest(df, k, held=10) == (cut, int((values > cut).sum()))


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_one(spark):
    keys = [0, 1, -1, 42, 2**63 - 1, -(2**63), 123456789012345]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 17, 300):
        got = {r["k"]: r["s"] for r in df.select("k", sharding.jump_hash(F.col("k"), n)["shard"].alias("s")).collect()}
        assert got == {k: plain_jump(k % 2**64, n) for k in keys}


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs, 4).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    grown = {(r["doc_id"], r["shard"]) for r in sharding.shard_rows(docs, "doc_id", 5).collect()}
    assert {(r["doc_id"], r["grown_shard"]) for r in got} == grown
    assert all(r["grown_shard"] in (r["shard"], 4) for r in got)
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(empty).count() == 0


def test_gapless_rank_over_many_blocks(spark):
    df = spark.range(1000).select("id", (F.col("id") % 2).alias("g"))
    got = common.gapless_rank(df, ["g"], ["id"], "r", block=10).collect()
    for g in (0, 1):
        assert sorted(r["r"] for r in got if r["g"] == g) == list(range(500))


def test_toxicity_learns_from_the_training_folds_only(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    a = toxicity.score_toxicity(d, labels)
    hidden = labels.withColumn("toxic", F.when(toxicity.fold(4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert a.exceptAll(toxicity.score_toxicity(d, hidden)).count() == 0
    m = a.join(labels, "doc_id").where("held_out").agg(F.sum(F.expr("if(predicted = 1 and toxic = 1, 1, 0)")).alias("hit"), F.sum("toxic").alias("n"), F.sum(F.expr("if(predicted = 1 and toxic = 0, 1, 0)")).alias("false")).first()
    assert m["hit"] >= 0.6 * m["n"] and m["false"] <= 5


def brute_likelihoods(train, window=8):
    """From (text, class) pairs: a function from a text to its largest mean difference, and the sums of both models, by dictionaries."""
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})

    def words(t):
        return [w.encode() for w in WORDS.findall((t or "").translate(lower))]

    counts = [[Counter(), Counter()], [Counter(), Counter()]]
    for t, c in train:
        for w in words(t):
            counts[c][0][w] += 1
            counts[c][1][w[:4]] += 1
    forms = set(counts[0][0]) | set(counts[1][0])
    types = Counter(w[:4] for w in forms)
    bins = toxicity.BINS

    def cuts(n):
        k = [sum(v == i for v in n.values()) for i in (1, 2, 3, 4)]
        y = k[0] / max(k[0] + 2 * k[1], 1)
        d = [min(max(i + 1 - (i + 2) * y * k[i + 1] / max(k[i], 1), 0.5), i + 1) for i in range(3)]
        return {w: d[min(v, 3) - 1] for w, v in n.items()}

    def p(c, w):
        stem = w[:4]
        out = (types[stem] + 0.5) / (len(forms) + 0.5 * bins)
        for n, key, share in ((counts[c][1], stem, 1), (counts[c][0], w, types[stem] + 1)):
            total, d = max(sum(n.values()), 1), cuts(n)
            out = (n[key] - d.get(key, 0)) / total + (sum(d.values()) / total if n else 1.0) * out / share
        return out

    def difference(t):
        r = [np.log(p(1, w)) - np.log(p(0, w)) for w in words(t)]
        k = min(len(r), window)
        return max((sum(r[i : i + k]) / k for i in range(len(r) - k + 1)), default=0.0) if r else 0.0

    def whole(c):
        """All known words, and for each stem the words not known: those of stems in the table, and the rest of the bins."""
        rest = sum(p(c, s + b"\x00\x01unknown") for s in types)
        return sum(p(c, w) for w in forms) + rest + (bins - len(types)) * p(c, b"\x02\x03\x04\x05none")

    return difference, whole


def test_toxicity_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    vocab = [f"{a}{b}x{i}" for i, (a, b) in enumerate(itertools.product("bcdfgh", ("ra", "lo", "ti", "nu")))]
    bad = ["Idiotic", "vermint", "scumbag"]
    docs, labels = [], []
    for i in range(90):
        w = list(rng.choice(vocab, int(rng.integers(3, 40))))
        if i % 3 == 0:
            w.insert(int(rng.integers(0, len(w))), str(rng.choice(bad)))
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    docs += [(200, None), (201, ""), (202, "unseen Idiotic words idiotic"), (0, "braxx0 lone")]
    got = toxicity.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()

    kind = {i: c for i, c in labels}
    part = {i: zlib.crc32(str(i).encode()) % 4 for i, _ in docs}
    train = [(t, kind[i], {3: 2}.get(part[i], part[i])) for i, t in docs if i in kind and part[i] != 2]
    x, y = [], []
    for f in range(3):
        difference, _ = brute_likelihoods([(t, c) for t, c, g in train if g != f])
        x += [difference(t) for t, _, g in train if g == f]
        y += [c for _, c, g in train if g == f]
    b = toxicity._logistic(np.array(x), np.array(y, float))
    difference, whole = brute_likelihoods([(t, c) for t, c, _ in train])
    want = sorted((i, part[i] == 2, round(float(1 / (1 + np.exp(-(b[0] + b[1] * difference(t))))), 4)) for i, t in docs)
    assert sorted((r["doc_id"], r["held_out"], round(r["score"], 4)) for r in got) == want
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(abs(whole(c) - 1) < 1e-9 for c in (0, 1))


def test_toxicity_models_sum_to_one():
    import pandas as pd

    rng = np.random.default_rng(0)
    stem = rng.integers(0, toxicity.BINS, 300)
    frames = []
    for bins, types in ((np.arange(300) * 7, np.ones(300)), (stem, np.ones(300))):
        f = pd.DataFrame({"bin": bins, "ordinary": rng.integers(0, 9, 300), "toxic": rng.integers(0, 3, 300), "types": types})
        frames.append(f.groupby("bin", as_index=False).sum())
    model = toxicity.Model(frames)
    for c in (0, 1):
        stems = model.stems[c][0].astype(float) + model.stems[c][1] * model.base
        assert abs(stems.sum() - 1) < 1e-5
        # a stem's share is split evenly between its known words and the unknown ones
        assert abs(model.words[c][0].sum(dtype=float) + model.words[c][1] - 1) < 1e-5


def test_toxicity_of_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (0, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_language_gradients():
    rng = np.random.default_rng(0)
    net = language_id.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 257, (5, 4)), rng.integers(0, 3, 4)

    def loss():
        p = net.probabilities(x)
        real = x < 256
        return -np.log(p[:, np.arange(4), y])[real].sum() / real.sum()

    g = net.gradients(x, y)
    for k, at in (("u", (0, 2, 5)), ("u", (1, 3, 20)), ("e", (0, x[2, 1], 3)), ("e", (1, x[0, 0], 17)), ("v", (9, 1)), ("c", (2,))):
        old = net.p[k][at]
        net.p[k][at] = old + 1e-2
        up = loss()
        net.p[k][at] = old - 1e-2
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / 2e-2 - g[k][at]) < 1e-3


def plain_pooled(net, raw):
    """One text by two recurrences over all of its bytes, one byte at a time."""
    h, p = language_id.HIDDEN, {k: v.astype(np.float64) for k, v in net.p.items()}

    def soft(x):
        return x / (1 + abs(x))

    states = np.zeros((2, len(raw), h))
    for d, order in enumerate((range(len(raw)), reversed(range(len(raw))))):
        s = np.zeros(h)
        for i in order:
            g, q = p["e"][d][raw[i]], s @ p["u"][d]
            z, r = 0.5 + 0.5 * soft(g[:h] + q[:h]), 0.5 + 0.5 * soft(g[h : 2 * h] + q[h : 2 * h])
            n = soft(g[2 * h :] + r * q[2 * h :])
            s = (1 - z) * n + z * s
            states[d, i] = s
    logits = states[0] @ p["v"][:h] + states[1] @ p["v"][h:] + p["c"]
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return (e / e.sum(axis=1, keepdims=True)).mean(axis=0)


def test_language_probabilities_equal_whole_recurrences():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    net = language_id.Network(2)
    texts = ["a", "abc xyz", "mnopq" * 25, "é" * 64, "".join(map(chr, rng.integers(97, 118, 128))), "".join(map(chr, rng.integers(97, 118, 3000))), "abcdefg " * 200 + "mnopqrs " * 200]
    got = language_id.pooled(net, pa.array([*texts, "", None]), 2)
    assert not got[-2:].any()
    for text, have in zip(texts, got, strict=False):
        raw = text.encode()
        # within a window the recurrences are whole; beyond, CONTEXT bytes run them in
        assert np.abs(have - plain_pooled(net, raw)).max() < (1e-6 if len(raw) <= language_id.WINDOW else 1e-4)


def test_language_context_is_enough_for_a_trained_network():
    """Whole recurrences and windows with their run-in: the same label for nearly every text, and near probabilities."""
    import duckdb
    import pyarrow as pa

    rows = duckdb.sql("select text, lang from '/root/testdata/sf0.01/documents.parquet' where text <> '' and lang is not null order by doc_id").fetchall()
    langs = sorted({x for _, x in rows})
    windows, labels = [], []
    for text, lang in rows[:400]:
        raw = np.frombuffer(text.encode(), np.uint8)
        for k in np.unique(np.linspace(0, max(len(raw) - 32, 0), 12).astype(int)):
            windows.append(np.pad(raw[k : k + 32].astype(np.int64), (0, max(0, 32 - len(raw))), constant_values=256))
            labels.append(langs.index(lang))
    net = language_id.train(np.array(windows), np.array(labels), len(langs))
    texts = [t for t, _ in rows[400:] if 300 < len(t) < 3000][:40]
    got = language_id.pooled(net, pa.array(texts), len(langs))
    want = np.array([plain_pooled(net, t.encode()) for t in texts])
    assert (got.argmax(axis=1) == want.argmax(axis=1)).mean() >= 0.95
    assert np.abs(got - want).mean() < 0.01


def test_language_id(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = language_id.identify(d).join(d, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a")).first()
    assert r["a"] > 0.97
    got = language_id.identify(docs).collect()
    text = dict((i, t) for i, t, *_ in rows())
    assert len(got) == len(rows())
    assert all(x["lang_pred"] == "und" for x in got if x["doc_id"] is not None and not re.search(r"[^\W\d_]", text[x["doc_id"]] or ""))
    assert language_id.identify(empty).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, DATA), "stage")
        assert out.count() > 0 and (name == "packing" or out.columns == docs.columns)
        docs = out


def test_one_row_of_a_near_duplicate_group_stays_with_repeated_rows_and_null_ids(spark):
    rng = np.random.default_rng(5)
    a, b, c, d, e = (" ".join(rng.choice([f"w{i}" for i in range(3000)], 120)) for _ in range(5))
    given = [
        (1, a), (1, a), (None, a + " tail"), (None, a),  # one group: repeated rows and null ids
        (None, b), (None, b), (None, b + " tail"),  # null ids only
        (7, c), (7, d), (9, d), (3, d + " tail"),  # one doc_id on two texts
        (5, e + " tail"), (6, e), (5, ""), (5, ""), (None, None), (None, None), (2, " "),
    ]
    out = minhash.drop_near_duplicates(spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(given)], "doc_id long, text string, k int")).collect()
    assert len({r["k"] for r in out}) == len(out) and all(given[r["k"]] == (r["doc_id"], r["text"]) for r in out)
    full = [(r["doc_id"], r["text"]) for r in out if r["text"] and r["text"].strip()]
    nulls = [t for i, t in full if i is None]
    assert sorted(x for x in full if x[0] is not None) == sorted([(1, a), (7, c), (3, d + " tail"), (5, e + " tail")])
    assert len(nulls) == 1 and nulls[0] in (b, b + " tail")
    assert sorted(r["k"] for r in out if not (r["text"] or "").strip()) == [13, 14, 15, 16, 17]


def test_the_thirteen_queries_are_registered():
    import inspect
    import re as regex

    from ctxloom.llm import queries

    found = queries.queries()
    assert [int(regex.match(r"op(\d+)_", k)[1]) for k in found] == list(range(1, 14))
    assert all(list(inspect.signature(f).parameters) == ["spark", "sf_dir"] for f in found.values())
