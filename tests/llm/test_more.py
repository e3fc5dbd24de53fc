"""Odd columns, hot rows, brute force of weights, ratios, targets and trees, and recall of the candidates."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.llm import common, fingerprints, importance, minhash, mixing, ngram_ratio, packing, quality_rules, sharding, suffix_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["_id", "_hash", "spans", "text_key", "_copy", "_copies", "_key", "key", "row", "rest", "number", "_row", "copies", "id", "hash", "doc", "hot"]


@pytest.fixture(scope="module")
def odd(spark):
    """documents with columns of every name that a stage uses inside."""
    rng = np.random.default_rng(3)
    vocab = [f"word{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocab, 70))
    texts = [" ".join(rng.choice(vocab, 120)) for _ in range(12)]
    texts += [texts[0] + " tail", texts[1], passage + " " + texts[2], texts[3] + " " + passage, None, "", "one two"]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or ""), *[f"{c}{i}" for c in ODD]) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[2]], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in ODD))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1) for i in range(8)] + [(18, 0)], "doc_id long, quality int")


def stages(labels):
    return {
        "quality": lambda d: quality_rules.keep_good(d, labels),
        "near": minhash.drop_near_duplicates,
        "repeats": suffix_dedup.remove_repeats,
        "mix": mixing.mix_documents,
    }


@pytest.mark.parametrize("name", ["quality", "near", "repeats", "mix"])
def test_stages_keep_columns_of_any_name(odd, labels, name):
    out = stages(labels)[name](odd)
    assert out.columns == odd.columns
    given = {r["doc_id"]: r for r in odd.collect()}
    rows = out.collect()
    assert rows and all(r[c] == given[r["doc_id"]][c] for r in rows for c in ["lang", "source", *ODD])
    if name != "repeats":
        assert all(r["text"] == given[r["doc_id"]]["text"] for r in rows)
    assert stages(labels)[name](odd.limit(0)).count() == 0


def test_pipeline_of_an_empty_table(spark, labels, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels.withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, str(tmp_path)), "empty")
        assert docs.count() == 0 and (name == "packing" or "text" in docs.columns)


def test_pipeline_runs_and_leaves_only_what_is_read(spark):
    import corpus_pipeline

    point = common.mark()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = [path.rsplit("/", 1)[1].split("-")[0] for _, path in common._written[point:]]
    assert out.count() > 0 and sorted(left) == ["counted", "lengths", "source_mixing"]


def test_materialized_files_go_when_released(spark):
    import os

    a = common.materialize(spark.range(3), "x")
    point = common.mark()
    b, c = common.materialize(spark.range(4), "x"), common.materialize(spark.range(5), "x")
    common.release_since(point, keep=c)
    there = [os.path.exists(f._written_at.removeprefix("file://")) for f in (a, b, c)]
    assert there == [True, False, True]
    common.release(a, c)


def test_expand_and_ranks_of_rows_that_come_very_often(spark):
    df = spark.createDataFrame([("a", 25), ("b", 1), ("c", 3)], "x string, n long")
    got = Counter(map(tuple, common.expand(df, "n", 25, chunk=4).select("x", "_nth").collect()))
    assert got == Counter((x, i) for x, n in (("a", 25), ("b", 1), ("c", 3)) for i in range(n))
    rows = spark.createDataFrame([(1, 7)] * 30_000 + [(i, 8) for i in range(50)], "id long, g long")
    ranked = common.gapless_rank(rows, ["g"], ["id"], "r", block=20).collect()
    for g, n in ((7, 30_000), (8, 50)):
        assert sorted(r["r"] for r in ranked if r["g"] == g) == list(range(n))


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"))
    got = {r["x"]: r["k"] for r in common.global_rank(df, [F.col("x").desc()], "k").collect()}
    assert got == {i: 999 - i for i in range(1000)}


def test_mixing_of_one_row_that_comes_very_often(spark):
    rows = [(1, "a b c", "s")] * 12_000 + [(i, "w " * (i % 9 + 1), "t") for i in range(2, 300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    for s in ("s", "t"):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 9 and all(r["taken"] <= 2 * r["size"] for r in own)


def brute_targets(sizes, weights, share, cap):
    """By handing the excess on by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full = {s: 0.0 for s in order}, {s: cap * sizes[s] for s in order}
    left, open_ = share * sum(sizes.values()), list(order)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        for s in open_:
            target[s] += left * w[s] / total
        left = sum(max(0.0, target[s] - full[s]) for s in open_)
        for s in open_:
            target[s] = min(target[s], full[s])
        open_ = [s for s in open_ if target[s] < full[s] - 1e-9]
    return target


def test_mixing_targets_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    for n in (1, 2, 5, 40):
        sizes = {f"s{i}": int(rng.integers(0, 10_000)) for i in range(n)} | {None: 123}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df, [5, 2, 1], 1.5, 2.0).collect()}
        want = brute_targets(sizes, [5, 2, 1], 1.5, 2.0)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-3 for s in want)


def brute_ratios(spark, docs, good, bins, prior=10.0):
    """Sums of the log ratios and numbers of n-grams of each text; Spark only hashes the n-grams."""
    texts = {i: ("" if t is None else t).split(" ") for i, t in docs}
    grams = {i: [(w,) for w in ws] + list(itertools.zip_longest(ws, ws[1:])) for i, ws in texts.items()}
    kinds = sorted({g for gs in grams.values() for g in gs}, key=str)
    df = spark.createDataFrame([(k, g[0], g[1] if len(g) > 1 else None, len(g)) for k, g in enumerate(kinds)], "k long, a string, b string, n int")
    hashed = {r["k"]: r["h"] for r in df.select("k", F.pmod(F.when(F.col("n") == 1, F.xxhash64("a")).otherwise(F.xxhash64("a", "b")), F.lit(bins)).alias("h")).collect()}
    bin_of = {g: hashed[k] for k, g in enumerate(kinds)}
    raw, target = Counter(), Counter()
    for i, gs in grams.items():
        raw.update(bin_of[g] for g in gs)
        if i in good:
            target.update(bin_of[g] for g in gs)
    rate = sum(target.values()) / sum(raw.values())
    ratio = {b: math.log((target[b] + prior) / (n * rate + prior)) for b, n in raw.items()}
    return {i: (sum(ratio[bin_of[g]] for g in gs), len(gs)) for i, gs in grams.items()}


def test_importance_weights_and_quality_ratios_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    docs = [(i, " ".join(rng.choice([f"t{j}" for j in range(60 if i < 20 else 30)], int(rng.integers(1, 60))))) for i in range(50)] + [(100, None), (101, ""), (102, "a  b")]
    good = set(range(15))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(30)], "doc_id long, quality int")
    want = brute_ratios(spark, docs, good, 1 << 16)
    got = {r["doc_id"]: r for r in importance.resample(df, labels, fraction=0.3).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i]["log_weight"] - want[i][0]) < 1e-6 and got[i]["n_grams"] == want[i][1] for i in want)
    judged = {r["doc_id"]: r for r in quality_rules.judge(df, labels).collect()}
    assert all(abs(judged[i]["score"] - s / n) < 1e-9 for i, (s, n) in want.items())
    assert all(judged[i]["kept"] == (not judged[i]["base_failed"] and judged[i]["score"] >= quality_rules.THRESHOLD) for i in want)
    assert ngram_ratio.BROADCAST_IDS > 0


def plain_tree(text):
    def digest(x):
        return hashlib.sha256(x.encode()).hexdigest()[:16]

    paragraphs = []
    for line in text.split("\n"):
        leaves = [digest(x) for x in re.findall(r"[^.!?|]{1,160}[.!?|]*\x20*|[.!?|]+\x20*", line)]
        paragraphs.append((digest("".join(leaves)), leaves))
    sections, now = [], []
    for p in paragraphs:
        now.append(p)
        if p[0][-1] in "01":
            sections.append(now)
            now = []
    if now:
        sections.append(now)
    ends = [[(p, "," if i < len(s) - 1 or p[0][-1] not in "01" else "") for i, p in enumerate(s)] for s in sections]
    bodies = ["".join(p[0] + "=" + "".join(p[1]) + e for p, e in s) for s in ends]
    tops = [digest(re.sub("=[0-9a-f]*", "", b)) for b in bodies]
    return hashlib.sha256(".".join(tops).encode()).hexdigest() + "/" + ";".join(f"{t}:{b}" for t, b in zip(tops, bodies, strict=True)), sections


def test_fingerprint_is_the_tree_and_edits_are_located(spark):
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(50)]
    lines = [" ".join(rng.choice(words, 12)) + ". " + " ".join(rng.choice(words, 9)) + "! end" for _ in range(40)]
    changed = list(lines)
    changed[17] = changed[17].replace("! end", "! other")
    texts = ["", "x", "a. b? c", "\n\n", "\n".join(lines), "\n".join(changed), "\n".join(lines[:20] + ["new line. here"] + lines[20:])]
    df = fingerprints.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "f").drop("t")
    rows = {r["i"]: r for r in df.collect()}
    for i, t in enumerate(texts):
        tree, sections = plain_tree(t)
        assert rows[i]["f"] == tree
        assert set(rows[i]["f_leaves"]) == {x for s in sections for p in s for x in p[1]}
    f = {i: rows[i]["f"] for i in rows}
    pairs = spark.createDataFrame([(4, 5, f[4], f[5]), (4, 6, f[4], f[6]), (4, 4, f[4], f[4]), (0, 2, f[0], f[2])], "a int, b int, x string, y string")
    found = defaultdict(list)
    for r in fingerprints.locate_edits(pairs, "x", "y").collect():
        if r["edits"] is not None:
            found[(r["a"], r["b"])].append(r["edits"])
    assert not found[(4, 4)] and len(found[(4, 5)]) == 1 and len(found[(4, 6)]) == 2 and len(found[(0, 2)]) == 3
    edit = found[(4, 5)][0]
    _, sections = plain_tree(texts[5])
    assert sections[edit["section"]][edit["paragraph"]][1][edit["leaf"]] == edit["digest"] == hashlib.sha256(b" other").hexdigest()[:16] or edit["digest"] in rows[5]["f_leaves"]
    # likeness is the Dice coefficient of the leaf sets
    both = df.alias("p").join(df.alias("q"), F.col("p.i") + 1 == F.col("q.i")).select(F.col("p.i").alias("i"), F.col("p.f").alias("f"), F.col("p.f_leaves").alias("f_leaves"), F.col("q.f").alias("g"), F.col("q.f_leaves").alias("g_leaves"))
    for r in both.select("i", fingerprints.likeness("f", "g").alias("s")).collect():
        x, y = set(rows[r["i"]]["f_leaves"]), set(rows[r["i"] + 1]["f_leaves"])
        assert r["s"] == (2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0)


def test_next_documents_with_hot_ids(spark):
    rows = [(5, f"t{i}") for i in range(60)] + [(5, "same")] * 40 + [(10**12 + i, f"u{i}") for i in range(30)] + [(None, "n")] * 3 + [(1, "low")]
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"), block=7).collect()
    assert sum(r["times"] for r in got) == len(rows)
    follows = Counter()
    for r in got:
        follows[(r["doc_id"], r["text"])] += r["times"]
    assert follows == Counter(rows)
    # the whole is one cycle: every text is the next one as often as it stands there
    assert Counter(t for _, t in rows) == sum((Counter({r["next_text"]: r["times"]}) for r in got), Counter())
    by = {r["text"]: r["next_text"] for r in got if r["doc_id"] is not None and r["doc_id"] > 10**11}
    assert all(by[f"u{i}"] == f"u{i - 1}" for i in range(1, 30))


@pytest.mark.parametrize("sf", ["sf0.01"])
@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_minhash_finds_every_link_of_an_inverted_index(spark, sf, width, percent):
    """All pairs of different sets at the threshold, by an inverted index; the candidates must hold every one."""
    import duckdb

    rows = duckdb.sql(f"select doc_id, text from '/root/testdata/{sf}/documents.parquet'").fetchall()
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = WORDS.findall((t or "").translate(lower))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    reps = {}
    for i in sorted(sets):
        reps.setdefault(sets[i], i)
    index = defaultdict(list)
    for s, i in reps.items():
        for x in s:
            index[x].append(i)
    shared = Counter()
    for ids in index.values():
        shared.update(itertools.combinations(sorted(ids), 2))
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    component = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), width, percent).collect()}
    assert links and all(component[a] == component[b] for a, b in links)


def test_sql_of_the_queries(spark):
    """The SQL of the exact queries gives their rows."""
    import duckdb

    from ctxloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    for name, text in queries.oracle_sql().items():
        want = con.sql(text)
        got = queries.queries()[name](spark, "/root/testdata/sf0.001").select(*want.columns)
        assert Counter(map(tuple, got.collect())) == Counter(want.fetchall()), name


def test_packing_reads_texts_once(spark, odd):
    assert packing.pack(odd).count() == odd.count() and sharding.shard_documents(odd).count() == odd.count()
