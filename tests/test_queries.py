"""Every query with SQL gives DuckDB's rows on the smallest tables; goldens of the core operators."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from ctxloom.functions import text as T
from ctxloom.operators import compiler as K
from ctxloom.operators import graph as GR
from ctxloom.operators import monitoring as M
from ctxloom.operators import packing as P
from ctxloom.operators import quality as Q
from ctxloom.operators import retrieval as R
from ctxloom.operators import sets as S
from ctxloom.plans import queries as L

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rounded(row):
    return tuple(round(v, 5) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(L.oracle_sql()))
def test_oracle(spark, duck, name):
    df = L.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(rounded(r)) for r in df.select(*cols).collect())
    cur = duck.execute(L.oracle_sql()[name])
    at = [[c[0] for c in cur.description].index(c) for c in cols]
    assert got == sorted(repr(rounded([r[i] for i in at])) for r in cur.fetchall())


def packed(spark, rows, budget, columns="id string, score double, recency double, tokens long"):
    df = spark.createDataFrame(rows, columns).withColumn("pack_id", F.lit(1)).withColumn("budget", F.lit(budget)).withColumn("ord", F.monotonically_increasing_id())
    return {r["id"]: r["chosen"] for r in P.greedy(df, ["pack_id"]).collect()}


def test_pack_skips_what_does_not_fit(spark):
    assert packed(spark, [("a", 10.0, 0.0, 50), ("b", 5.0, 0.0, 60), ("c", 1.0, 0.0, 40)], 90) == {"a": True, "b": False, "c": True}


def test_pack_zero_tokens_and_oversize(spark):
    assert packed(spark, [("z", 0.0, 0.0, 0), ("big", 9.0, 0.0, 11)], 10) == {"z": True, "big": False}


def test_allocation_never_exceeds_the_budget(spark):
    rows = L.pack_allocation(spark, DATA).where("chosen").join(L.score_items(spark, DATA).select("id", "tokens"), "id")
    assert rows.groupBy("pack_id").agg(F.sum("tokens").alias("t")).agg(F.max("t")).first()[0] <= 2000


def test_variant_golden(spark):
    rows = [("a", 10.0, 0.0, 100, [30, 60])]
    df = spark.createDataFrame(rows, "id string, score double, recency double, tokens long, sizes array<long>").withColumns({"pack_id": F.lit(1), "budget": F.lit(40), "ord": F.lit(1)})
    assert [(r["taken_tokens"], r["decision"]) for r in P.greedy_variants(df, ["pack_id"]).collect()] == [(30, "compress")]


def test_contradiction_needs_overlap_and_negation(spark):
    rows = [(1, 1, "use the cache for reads"), (1, 2, "never use the cache for reads"), (1, 3, "use the cache for all reads"), (1, 4, "never mind"), (2, 5, "use the cache for reads")]
    got = {(r["a"], r["b"]) for r in K.contradictions(spark.createDataFrame(rows, "pack_id int, id int, content string")).collect()}
    assert got == {(1, 2), (2, 3)}


def test_indicators(spark):
    from ctxloom.operators import rules as U

    rows = [(1, "10.0.0.7 and 10.0.0.7, a.b@c.org, USER-77: ransomware"), (2, None)]
    got = {r["incident_id"]: r for r in U.indicators(spark.createDataFrame(rows, "incident_id int, text string")).collect()}
    assert (got[1]["ips"], got[1]["emails"], got[1]["users"], got[1]["high_risk"]) == (["10.0.0.7"], ["a.b@c.org"], ["user-77"], True)
    assert (got[2]["ips"], got[2]["high_risk"]) == ([], False)


def test_cost_golden(spark):
    df = spark.createDataFrame([(4000, 3000, 500)], "input_tokens long, cached_tokens long, output_tokens long")
    r = Q.costs(df, "claude-sonnet-4-6").first()
    assert (r["cost_uncached"], r["cost_cached"]) == (0.0195, 0.0114)
    with pytest.raises(ValueError):
        Q.costs(df, "none")


def test_ranking_golden(spark):
    rows = [("q", i + 1, x in "bd") for i, x in enumerate("abcd")]
    m = R.ranking_metrics(spark.createDataFrame(rows, "query_id string, rank int, relevant boolean"), 2).first()
    assert (m["precision_at_k"], m["recall_at_k"], m["mrr"]) == (0.5, 0.5, 0.5)


def test_token_estimates(spark):
    df = spark.createDataFrame([("",), ("  ",), ("one",), ("a b c",), (None,)], "t string")
    assert [r[0] for r in df.select(T.estimate_tokens(F.col("t"))).collect()] == [0, 0, 2, 4, 0]


def test_leaders_follow_input_order(spark):
    items = spark.createDataFrame([("g", i) for i in range(4)], "group string, ord long")
    edges = spark.createDataFrame([("g", 0, 1), ("g", 1, 2)], "group string, a long, b long")
    assert sorted((r["ord"], r["leader"]) for r in R.leaders(items, edges).collect()) == [(0, 0), (1, 0), (2, 2), (3, 3)]


def test_depth_ends_where_a_cycle_closes(spark):
    """No cap: a cycle's last step counts, chains of any length do, and needs that are no node are one step."""
    def depths(edges, nodes):
        e = spark.createDataFrame(edges, "node long, needs long")
        return {r["node"]: r["depth"] for r in GR.depth(e, spark.createDataFrame([(n,) for n in nodes], "node long")).collect()}

    assert depths([(1, 2), (2, 1)], [1, 2]) == {1: 2, 2: 2}
    assert depths([(0, 1), (1, 2), (2, 3), (3, 1)], [0])[0] == 4
    assert depths([(i, i + 1) for i in range(14)] + [(7, 99)], range(14)) == {i: 14 - i for i in range(14)}


def test_diff_pairs_duplicates(spark):
    a = spark.createDataFrame([("x", 1, "p"), ("x", 2, "q"), ("b", 3, "r")], "id string, ord long, v string")
    b = spark.createDataFrame([("x", 1, "p"), ("c", 2, "s")], "id string, ord long, v string")
    got = {(r["id"], r["nth"]): r["change"] for r in S.diff(a, b, "id", ["v"], "ord").collect()}
    assert got == {("x", 1): "kept", ("x", 2): "removed", ("b", 1): "removed", ("c", 1): "added"}


def test_task_jsonl_skips_bad_lines(spark, tmp_path):
    from ctxloom.sources.stores import read_issues, write_issues

    (tmp_path / "t.jsonl").write_text('# note\n\n{"id": "a", "title": "x"}\nnot json\n{"title": "no id"}\n')
    rows = read_issues(spark, f"file://{tmp_path}/t.jsonl")
    assert [r["id"] for r in rows.collect()] == ["a"]
    write_issues(rows, f"file://{tmp_path}/out")
    assert read_issues(spark, f"file://{tmp_path}/out").count() == 1


def test_memory_store_keeps_the_latest(spark, tmp_path):
    from ctxloom.sources.stores import append_memories, read_memories

    path = f"file://{tmp_path}/m"
    for v in ("old", "new"):
        append_memories(spark.createDataFrame([("a", v, 1)], "id string, content string, updated_at long"), path)
    assert [r["content"] for r in read_memories(spark, path).collect()] == ["new"]


def test_streaming_observations_equal_the_batch(spark, tmp_path):
    from ctxloom.streaming.drift import observations

    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{tmp_path}/in")
    stream = observations(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), late="3650 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("obs").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    batch = events.groupBy(F.window("ts", "5 minutes"), "user_id").agg(F.count("*").alias("n"))
    assert spark.table("obs").select("window", "user_id", "n").exceptAll(batch.select("window", "user_id", "n")).count() == 0
    assert spark.table("obs").count() == batch.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def leaders_by_hand(texts):
    sets = {i: {w for w in re.split(r"\s+", (t or "").lower()) if len(w) > 2} for i, t in texts}
    lead = {}
    for i in sorted(sets):
        alike = [j for j in sorted(set(lead.values())) if (5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))]
        lead[i] = alike[0] if alike else i
    return lead


def test_leader_clusters_keep_documents_without_words(spark, tmp_path):
    texts = [(1, "one two three four five"), (2, "A."), (3, None), (4, "five four three two one"), (5, ""), (6, "six seven"), (7, "a an")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["leader"] for r in L.leader_clusters(spark, str(tmp_path)).collect()}
    assert got == leaders_by_hand(texts) == {1: 1, 2: 2, 3: 2, 4: 1, 5: 2, 6: 6, 7: 2}
    assert sorted(map(tuple, L.jaccard_pairs(spark, str(tmp_path)).collect())) == [("copy", 1, 4), ("copy", 2, 3), ("copy", 2, 5), ("copy", 2, 7)]


def test_items_for_all_reach_the_operator(spark):
    agents = spark.createDataFrame([(i,) for i in range(1, 6)], "agent long")
    late = "timestamp '2024-02-01'"
    rows = [(10, 1, [2, 3, 1, 99]), (11, 1, None), (12, 2, None), (13, 1, [])]
    items = spark.createDataFrame(rows, "item_id long, source_agent long, scope array<long>").withColumn("expires_at", F.expr(late))
    old = spark.createDataFrame([(14, 1, None)], "item_id long, source_agent long, scope array<long>").withColumn("expires_at", F.expr("timestamp '2023-01-01'"))
    acks = [(3, 10), (4, 11), (4, 11), (99, 11), (5, 14)]
    out = M.visible(items.unionByName(old), agents, spark.createDataFrame(acks, "agent long, item_id long"), "2024-01-02 00:00:00").collect()
    assert len(out) == len(set(out))
    without = {(r["item_id"], r["agent"]) for r in out if r["rule"] == "except"}
    got = {(r["agent"], r["item_id"]) for r in out if r["rule"] == "agent"}
    got |= {(a, r["item_id"]) for r in out if r["rule"] == "all" for a in range(1, 6) if (r["item_id"], a) not in without}
    want = {(a, i) for i, src, scope in rows for a in range(1, 6) if a != src and (scope is None or a in scope) and (a, i) not in acks}
    assert got == want and (2, 11) in got


def test_every_live_event_is_shared(spark):
    live = spark.read.parquet(f"{DATA}/events.parquet").where("cast(ts as timestamp) > timestamp '2024-01-02'")
    out = L.shared_visibility(spark, DATA)
    assert out.where("rule = 'all'").count() == live.where("event_id % 4 = 0").count() > 0
    assert out.where("rule = 'except' and item_id % 10 = 0").count() > out.where("rule = 'all' and item_id % 10 = 0").count()


def segments_by_hand(text, limit, markdown):
    def estimate(t):  # words by ASCII white space, as estimate_tokens has it
        return math.ceil(len(re.findall(r"[^ \t-\r]+", t)) * 1.3)

    out, now = [], ""
    for part in re.split(r"(^#+\s+.*$)", text, flags=re.MULTILINE) if markdown else re.split(r"(\n\n+)", text):
        if not part.strip():
            continue
        grown = (now + "\n" + part).strip()
        if estimate(grown) > limit and now:
            out.append(now)
            now = part
        else:
            now = grown
    return [*out, now] if now else out


@pytest.mark.parametrize("markdown", [True, False])
def test_segments_end_at_headings_or_blank_lines(spark, markdown):
    from ctxloom.operators.conversations import segments

    line = "one two three four five six seven eight"
    texts = [
        "\n".join([line] * 9), f"# a\n{line}\n{line}\n## b c\n\n{line}\n#no heading\n  # none\n{line}\n\n\n\n{line}\n", f"{line}\n\n{line}\n\n\n \n\n{line}  \n# end",
        "#\n\nnext line is the heading's\nrest of it", f"\r\n# a\r\n{line}\r\n\r\n{line} # b\n# c \n　\n", "## a\n## b\n## c\n" * 5, "", " \n\n \n", "# x", f"{line}\n\n" * 6,
    ]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    for limit in (5, 12, 25, 500):
        rows = segments(df, limit, markdown).orderBy("doc_id", "segment").collect()
        assert [(r["doc_id"], r["segment"], r["body"]) for r in rows] == [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate(segments_by_hand(t, limit, markdown))]
