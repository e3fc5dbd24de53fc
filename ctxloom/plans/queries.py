"""The library's queries, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import conversations as C
from ..operators import graph as G
from ..operators import monitoring as M
from ..operators import packing as P
from ..operators import quality as Q
from ..operators import retrieval as R
from ..operators import sets as S
from ..operators.scratch import stored
from .model import BUDGET, ITEMS, NOW, items, sql_greedy, sql_tokens, table
from .registry import oracle_sql, queries, query  # noqa: F401  the first two are read from here

def r6(x: str) -> str:
    return f"floor(({x}) * 1000000 + 0.5) / 1000000.0::double"


def q6(x):
    return T.half_up(x, 6)


# scalars

@query(f"select doc_id, {sql_tokens('text')} as tokens, {sql_tokens('text', 1.4)} as tokens_b, ceil(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) / 4.0::double)::bigint as tokens_chars from documents")
def estimate_tokens(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.estimate_tokens(t).alias("tokens"), T.estimate_tokens(t, 1.4).alias("tokens_b"), T.estimate_chars(t).alias("tokens_chars"))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_TOK = r"list_filter(regexp_extract_all(lower({0}), '([\p{{L}}\p{{N}}]+)', 1), lambda x: length(x) > 1)"


@query(f"select doc_id, len(t)::bigint as n_tokens, len(list_filter(list_distinct(t), lambda x: not list_contains({_STOP}, x)))::bigint as n_keywords from (select doc_id, {_TOK.format('text')} as t from documents)")
def keyword_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens(t)).cast("long").alias("n_tokens"), F.size(T.keywords(t)).cast("long").alias("n_keywords"))


@query(f"with {ITEMS} select id, pack_id, tokens, {r6('score')} as score, {r6('score * -0.5::double + tokens')} as mixed from items")
def score_items(spark, d):
    return items(spark, d).select("id", "pack_id", "tokens", q6(F.col("score")).alias("score"), q6(F.col("score") * -0.5 + F.col("tokens")).alias("mixed"))


@query(f"""with {ITEMS}, s as (select *, case id % 3 when 0 then 'closed' when 1 then 'open' end as st, id % 7 = 0 as act, id % 5 = 0 as outc, id % 13 = 0 as pin from items)
select id, {r6("score * case when act then 2.0::double when outc then 1.5::double when st in ('open','in_progress') then 1.2::double when st = 'closed' then 0.1::double when pin then 2.0::double else 1.0::double end")} as score from s""")
def score_causal(spark, d):
    s = items(spark, d).withColumns(
        {"issue_status": F.when(F.col("id") % 3 == 0, "closed").when(F.col("id") % 3 == 1, "open"), "issue_active": F.col("id") % 7 == 0, "is_outcome": F.col("id") % 5 == 0, "pinned": F.col("id") % 13 == 0}
    )
    return s.select("id", q6(P.causal_score(F.col("score"))).alias("score"))


@query(f"with {ITEMS} select id, {r6('score - 0.3::double * (id % 4) - 0.2::double * (id % 3) + case when id % 9 = 0 then 5.0::double else 0.0::double end')} as score from items")
def score_weighted(spark, d):
    s = items(spark, d).withColumns({"cost": (F.col("id") % 4).cast("double"), "latency": (F.col("id") % 3).cast("double"), "supersedes": F.when(F.col("id") % 9 == 0, F.col("id") - 1)})
    return s.select("id", q6(P.weighted_score()).alias("score"))


# packing

@query(f"with recursive {ITEMS}, {sql_greedy('items', 'pack_id')} select pack_id, id, tokens, {r6('score')} as score, chosen from g")
def pack_greedy(spark, d):
    # the texts are read once for their tokens, not again for the join
    return P.greedy(stored(items(spark, d)), ["pack_id"]).select("pack_id", "id", "tokens", q6(F.col("score")).alias("score"), "chosen")


@query(f"""with recursive {ITEMS}, {sql_greedy('items', 'pack_id')} select pack_id, coalesce(sum(tokens) filter (chosen), 0)::bigint as total_tokens,
({BUDGET} - coalesce(sum(tokens) filter (chosen), 0))::bigint as remaining, count(*) filter (chosen) as selected_count, count(*) filter (not chosen) as dropped_count from g group by 1""")
def pack_summary(spark, d):
    # the texts are read once for their tokens, not again for each test of them and for the join
    return P.summary(P.greedy(stored(items(spark, d)), ["pack_id"]), ["pack_id"])


@query(f"""with recursive {ITEMS}, {sql_greedy('items', 'pack_id')} select pack_id, rn::bigint as step, id, case when chosen then 'include' else 'exclude' end as decision,
case when chosen then 'fits_budget' else 'over_budget' end as reason from g""")
def pack_trace(spark, d):
    return P.trace(P.greedy(items(spark, d), ["pack_id"]), ["pack_id"]).select("pack_id", "step", "id", "decision", "reason")


@query(f"""with recursive {ITEMS}, sup as (select *, case when id % 4 = 3 then id - 20 end as supersedes from items),
alive as (select * from sup s where not exists (select 1 from sup o where o.pack_id = s.pack_id and o.supersedes = s.id)), {sql_greedy('alive', 'pack_id')} select pack_id, id, chosen from g""")
def pack_supersession(spark, d):
    s = items(spark, d).withColumn("supersedes", F.when(F.col("id") % 4 == 3, F.col("id") - 20))
    return P.greedy(P.without_superseded(s), ["pack_id"]).select("pack_id", "id", "chosen")


@query(f"""with recursive {ITEMS}, b as (select unnest([500, 1000, 1500, 2000, 2500])::bigint as bb),
x as (select i.pack_id || '/' || bb as run, i.* exclude (budget), bb as budget from items i, b), {sql_greedy('x', 'run')}
select pack_id, budget, coalesce(sum(tokens) filter (chosen), 0)::bigint as total_tokens, count(*) filter (chosen) as selected_count from g group by 1, 2""")
def simulate_budgets(spark, d):
    s = items(spark, d).drop("budget").withColumn("budget", F.explode(F.array(*[F.lit(b).cast("long") for b in range(500, 2501, 500)]))).withColumn("b", F.col("budget"))
    return P.summary(P.greedy(s, ["pack_id", "b"]), ["pack_id", "b"]).select("pack_id", F.col("b").alias("budget"), "total_tokens", "selected_count")


KINDS = [("system", 0.2, 100, None, 3), ("memory", 0.3, 0, 500, 2), ("retrieval", 0.4, 200, None, 1)]


@query(f"""with {ITEMS}, p as (select distinct pack_id, budget from items),
a as (select pack_id, 'system' as kind, greatest(floor(budget * 0.2::double), 100)::bigint as kind_budget from p
union all select pack_id, 'memory', least(greatest(floor(budget * 0.3::double), 0), 500)::bigint from p
union all select pack_id, 'retrieval', greatest(floor(budget * 0.4::double), 200)::bigint from p) select * from a""")
def kind_budgets(spark, d):
    return P.kind_budgets(items(spark, d).select("pack_id", "budget").distinct(), KINDS)


@query()
def pack_allocation(spark, d):
    s = items(spark, d)
    return P.allocate(s, s.select("pack_id", "budget").distinct(), KINDS).select("pack_id", "id", "kind", "chosen")


@query(f"""with recursive {ITEMS}, v as (select *, case when kind = 'system' then 'static' when kind = 'memory' then 'session' else 'request' end as volatility from items),
s0 as (select * from v where volatility = 'static'), {sql_greedy('s0', 'pack_id', 'a', 'id')},
l1 as (select v.pack_id, max(v.budget) - coalesce((select sum(tokens) from a where a.chosen and a.pack_id = v.pack_id), 0) as b from v group by 1),
s1 as (select v.* exclude (budget), l1.b::bigint as budget from v join l1 on v.pack_id = l1.pack_id where volatility = 'session'), {sql_greedy('s1', 'pack_id', 'm')},
l2 as (select l1.pack_id, l1.b - coalesce((select sum(tokens) from m where m.chosen and m.pack_id = l1.pack_id), 0) as b from l1),
s2 as (select v.* exclude (budget), l2.b::bigint as budget from v join l2 on v.pack_id = l2.pack_id where volatility = 'request'), {sql_greedy('s2', 'pack_id', 'z')}
select pack_id, id, volatility, chosen from a union all select pack_id, id, volatility, chosen from m union all select pack_id, id, volatility, chosen from z""")
def pack_cache_topology(spark, d):
    s = items(spark, d).withColumn("volatility", P.volatility(F.col("kind"), ["system"], ["memory"]))
    return P.by_volatility(s).select("pack_id", "id", "volatility", "chosen")


_ATT = "[" + ", ".join(f"{x}::double" for x in P.ATTENTION["claude"]) + "]"


@query(f"""with {ITEMS}, r as (select *, row_number() over (partition by pack_id order by score desc, ord) as k, count(*) over (partition by pack_id) as n from items),
s as (select pack_id, k - 1 as position, row_number() over (partition by pack_id order by {_ATT}[least(floor((k - 1)::double / n * 10), 9)::int + 1] desc, k) as k2 from r)
select r.pack_id, r.id, case when n <= 2 then r.k - 1 else s.position end::bigint as position from r join s on r.pack_id = s.pack_id and r.k = s.k2""")
def place_attention(spark, d):
    return P.place(items(spark, d), "claude").select("pack_id", "id", "position")


# retrieval

_BM = rf"""t as (select doc_id, {_TOK.format('text')} as t from documents), sz as (select doc_id, len(t) as n from t),
st as (select count(*) as nd, avg(n) as av from sz), q as (select item_id as query_id, unnest({_TOK.format('text')}) as term from benchmark),
qt as (select query_id, term, count(*) as times from q group by 1, 2), e as (select doc_id, unnest(t) as term from t),
tf as (select doc_id, term, count(*) as tf from e where term in (select term from qt) group by 1, 2), df as (select term, count(*) as df from tf group by 1),
bm as (select qt.query_id, tf.doc_id, sum(times * ln((nd - df + 0.5::double) / (df + 0.5::double) + 1) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * n / av))) as score
from tf join df on tf.term = df.term join sz on tf.doc_id = sz.doc_id cross join st join qt on qt.term = tf.term group by 1, 2)"""


def _searched(spark, d):
    return table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"with {_BM} select query_id, doc_id, {r6('score')} as score from bm qualify row_number() over (partition by query_id order by floor(score * 1000000 + 0.5) desc, doc_id) <= 10")
def bm25_top10(spark, d):
    return R.bm25_top(*_searched(spark, d), 10).select("query_id", "doc_id", "score")


_VEC = """v as (select vec_id, list_transform(embedding, lambda x: x::double) as e, label from embeddings),
n as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as m from v),
c as (select a.vec_id as query_id, b.vec_id, a.label = b.label as relevant, case when a.m * b.m = 0 then 0 else floor(list_dot_product(a.e, b.e) / (a.m * b.m) * 1000000 + 0.5) / 1000000.0::double end as score
from n a join n b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
top as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from c qualify rank <= 10)"""


def _nearest(spark, d, k=10):
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.vector_top(v, asked, k)


@query(f"with {_VEC} select query_id, vec_id, score, rank::int as rank from top")
def cosine_top10(spark, d):
    return _nearest(spark, d)


@query(f"""with {_VEC}, h as (select query_id, rank, relevant::int as r, sum(relevant::int) over (partition by query_id order by rank) as hits from top)
select query_id, {r6('sum(r) / 10.0::double')} as precision_at_k, {r6('coalesce(1.0::double / min(case when r = 1 then rank end), 0)')} as mrr,
{r6('coalesce(sum(r * hits / rank::double) / nullif(sum(r), 0), 0)')} as average_precision from h group by 1""")
def ranking_metrics(spark, d):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    near = _nearest(spark, d).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    m = R.ranking_metrics(near.select("query_id", "rank", (F.col("label") == F.col("own")).alias("relevant")), 10)
    return m.select("query_id", *[q6(F.col(c)).alias(c) for c in ("precision_at_k", "mrr", "average_precision")])


@query(f"""with {_BM}, b as (select query_id, doc_id, row_number() over (partition by query_id order by floor(score * 1000000 + 0.5) desc, doc_id) as rank from bm qualify rank <= 20),
k as (select qt.query_id, tf.doc_id, count(*) as hits, sum(tf) as s from qt join tf on qt.term = tf.term group by 1, 2),
kr as (select query_id, doc_id, row_number() over (partition by query_id order by hits desc, s desc, doc_id) as rank from k qualify rank <= 20),
u as (select query_id, doc_id, 0.4::double / (60 + rank) as part from b union all select query_id, doc_id, 0.6::double / (60 + rank) from kr)
select query_id, doc_id, {r6('sum(part)')} as score from u group by 1, 2""")
def hybrid_rrf(spark, d):
    return R.words_and_bm25(*_searched(spark, d), 20, (0.4, 0.6)).select("query_id", "doc_id", q6(F.col("score")).alias("score"))


_SET = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: length(x) > 2))"


def _word_sets(spark, d):
    return table(spark, d, "documents").select(F.lit(0).alias("group"), F.col("doc_id").alias("ord"), T.word_set(F.col("text")).alias("words"))


@query(rf"""with s as (select doc_id, list_sort({_SET.format('text')}) as w from documents), r as (select doc_id, w, min(doc_id) over (partition by w) as rep from s),
x as (select doc_id, unnest(w) as t, len(w) as n from r where doc_id = rep),
p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as i from x a join x b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2)
select 'link' as kind, a, b from p where i * 5 >= (na + nb - i) * 4 union all select 'copy', rep, doc_id from r where doc_id <> rep""")
def jaccard_pairs(spark, d):
    """Links between representatives, the least documents of each word set, and the copies of each."""
    links, members = R.class_pairs(_word_sets(spark, d), 4, 5)
    copies = members.where("ord <> rep").select(F.lit("copy").alias("kind"), F.col("rep").alias("a"), F.col("ord").alias("b"))
    return links.select(F.lit("link").alias("kind"), "a", "b").unionByName(copies)


@query()
def leader_clusters(spark, d):
    links, members = R.class_pairs(_word_sets(spark, d), 4, 5)
    led = R.leaders(members.where("ord = rep").select("group", "ord"), links)
    return members.join(led.select("group", F.col("ord").alias("rep"), "leader"), ["group", "rep"]).select(F.col("ord").alias("doc_id"), "leader")


# quality

@query(rf"""with {ITEMS}, w as (select *, list_filter(regexp_split_to_array(lower(content), '\s+'), lambda x: length(x) > 2) as w, list_distinct(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda x: length(x) > 2)) as s,
row_number() over (partition by pack_id order by ord) - 1 as k from items),
tot as (select pack_id, count(*) as item_count, sum(tokens)::bigint as total_tokens, avg(case when recency > 5 then 1.0::double else 0.0::double end) as freshness from w group by 1),
u as (select pack_id, count(distinct x) as u from (select pack_id, unnest(w) as x from w) group by 1),
g as (select pack_id, count(distinct x) / count(*)::double as diversity from (select pack_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as x from w) group by 1),
sz as (select pack_id, count(*) as n from w group by 1),
pr as (select pack_id, unnest(range(0, least(5000, 10 * n))) as q, n from sz where n * (n - 1) / 2 > 5000), ci as (select pack_id, q % n as a, (q % n + 1 + q // n) % n as b from pr),
al as (select x.pack_id, x.k as a, y.k as b from w x join w y on x.pack_id = y.pack_id and x.k < y.k join sz on sz.pack_id = x.pack_id where n * (n - 1) / 2 <= 5000),
j as (select x.pack_id, len(list_intersect(x.s, y.s)) as i, len(x.s) + len(y.s) as m from (select * from ci union all select * from al) p join w x on x.pack_id = p.pack_id and x.k = p.a join w y on y.pack_id = p.pack_id and y.k = p.b),
rd as (select pack_id, avg(case when m - i = 0 then 0 else i / (m - i)::double end) as redundancy from j group by 1),
z as (select tot.pack_id, item_count, total_tokens, least(u / greatest(total_tokens, 1)::double, 1.0::double) as dn, diversity, freshness, redundancy from tot join u using (pack_id) join g using (pack_id) join rd using (pack_id))
select pack_id, item_count, total_tokens, floor(dn * 1000 + 0.5) / 1000.0::double as density, floor(diversity * 1000 + 0.5) / 1000.0::double as diversity, floor(freshness * 1000 + 0.5) / 1000.0::double as freshness,
floor(redundancy * 1000 + 0.5) / 1000.0::double as redundancy, floor((dn * 0.25::double + diversity * 0.25::double + freshness * 0.2::double + (1 - redundancy) * 0.3::double) * 100 + 0.5) / 100.0::double as overall from z""")
def quality_metrics(spark, d):
    return Q.analyze_parted(Q.parted(items(spark, d, content=True), estimated=True))


@query(f"""with {ITEMS} select pack_id, count(*) as item_count, min(priority) as priority_min, max(priority) as priority_max, {r6('avg(priority)')} as priority_mean, {r6('stddev_pop(priority)')} as priority_std,
{r6('avg(recency)')} as recency_mean, {r6('stddev_pop(recency)')} as recency_std, {r6('least(sum(tokens) / max(budget)::double, 1)')} as token_utilization, {r6('avg(case when recency < 0.2::double then 1.0::double else 0.0::double end)')} as staleness_ratio from items group by 1""")
def fingerprints(spark, d):
    f = Q.fingerprint(items(spark, d))
    return f.select("pack_id", "item_count", "priority_min", "priority_max", *[q6(F.col(c)).alias(c) for c in ("priority_mean", "priority_std", "recency_mean", "recency_std", "token_utilization", "staleness_ratio")])


@query(f"with {ITEMS} select pack_id, kind, count(*) as n, {r6('count(*) / (sum(count(*)) over (partition by pack_id))::double')} as ratio from items group by 1, 2")
def kind_ratios(spark, d):
    from pyspark.sql import Window as W

    n = items(spark, d).groupBy("pack_id", "kind").agg(F.count("*").alias("n"))
    return n.withColumn("ratio", q6(F.col("n") / F.sum("n").over(W.partitionBy("pack_id"))))


@query("""select o_orderkey, floor((o_orderkey % 5000 * (3.0::double / 1000000) + 500 * (15.0::double / 1000000)) * 1000000 + 0.5) / 1000000.0::double as cost_uncached,
floor(((o_orderkey % 5000 - o_orderkey % 5000 // 2) * (3.0::double / 1000000) + o_orderkey % 5000 // 2 * (0.3::double / 1000000) + 500 * (15.0::double / 1000000)) * 1000000 + 0.5) / 1000000.0::double as cost_cached from orders""")
def cost_estimates(spark, d):
    n = F.col("o_orderkey") % 5000
    o = table(spark, d, "orders").select("o_orderkey", n.alias("input_tokens"), F.floor(n / 2).alias("cached_tokens"), F.lit(500).alias("output_tokens"))
    return Q.costs(o, "claude-sonnet-4-6").select("o_orderkey", "cost_uncached", "cost_cached")


# sets

_DIFF = """a as (select doc_id as id, doc_id as ord, n_chars as tokens, md5(text) as content from documents where doc_id % 10 <> 0),
b as (select doc_id as id, doc_id as ord, n_chars + case when doc_id % 7 = 0 then 1 else 0 end as tokens, md5(text) as content from documents where doc_id % 10 <> 1)"""


def _versions(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.col("n_chars").alias("tokens"), F.md5("text").alias("content"))
    return docs.where("id % 10 <> 0"), docs.where("id % 10 <> 1").withColumn("tokens", F.col("tokens") + F.when(F.col("id") % 7 == 0, 1).otherwise(0))


@query(f"""with {_DIFF} select coalesce(a.id, b.id) as id, 1::bigint as nth, case when a.id is null then 'added' when b.id is null then 'removed' when a.tokens = b.tokens and a.content = b.content then 'kept' else 'changed' end as change
from a full outer join b on a.id = b.id""")
def diff_items(spark, d):
    return S.diff(*_versions(spark, d), "id", ["content", "tokens"], "ord").select("id", "nth", "change")


_SIDES = """a as (select doc_id as id, (doc_id % 11)::double as priority, (doc_id * 7 % 101)::double as recency, 'ours' as side from documents where doc_id % 3 <> 0),
b as (select doc_id as id, (doc_id % 5)::double as priority, (doc_id * 3 % 101)::double as recency, 'theirs' as side from documents where doc_id % 4 <> 0)"""


def _sides(spark, d):
    i = F.col("id")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"))

    def side(p, r, name):
        return docs.select("id", (i % p).cast("double").alias("priority"), (i * r % 101).cast("double").alias("recency"), F.lit(name).alias("side"))

    return side(11, 7, "ours").where("id % 3 <> 0"), side(5, 3, "theirs").where("id % 4 <> 0")


def _sql_merge(by):
    return f"with {_SIDES} select coalesce(a.id, b.id) as id, case when a.id is null or coalesce(b.{by}, 0) > a.{by} then b.side else a.side end as side from a full outer join b on a.id = b.id"


@query(_sql_merge("recency"))
def merge_union(spark, d):
    return S.merge(*_sides(spark, d), "id", "union").select("id", "side")


@query(_sql_merge("priority"))
def merge_highest_priority(spark, d):
    return S.merge(*_sides(spark, d), "id", "priority").select("id", "side")


@query(f"with {_SIDES} select id, side from a where id in (select id from b)")
def merge_intersection(spark, d):
    return S.merge(*_sides(spark, d), "id", "intersection").select("id", "side")


@query("""with e as (select event_type as id, max(struct_pack(t := ts, i := event_id)) as m, count(*) as n from events group by 1) select id, m.i as event_id from e""")
def memory_upsert(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("id"), F.struct("ts", "event_id").alias("at"), "event_id")
    return S.upsert(e.limit(0), e, "id", "at").select("id", "event_id")


@query("""with m as (select user_id as session, row_number() over (partition by user_id order by ts, event_id) as k, event_type as id, floor(value)::bigint as tokens from events),
x as (select session, (k - 1) // 5 as step, (k - 1) % 5 as pos, id || '-' || row_number() over (partition by session, (k - 1) // 5, id order by k) as id, md5(id || (tokens // 4)) as h, tokens from m),
j as (select coalesce(n.session, p.session) as session, coalesce(n.step, p.step + 1) as step, n.pos as np, p.pos as pp, case when p.pos is null then 'added' when n.pos is null then 'removed' when n.h = p.h then 'kept' else 'changed' end as st,
coalesce(n.tokens, p.tokens) as t, p.tokens as pt from x n full outer join x p on p.session = n.session and p.step = n.step - 1 and p.id = n.id),
c as (select session, step, count(*) filter (st = 'added') as added, count(*) filter (st = 'removed') as removed, count(*) filter (st = 'changed') as changed, count(*) filter (st = 'kept') as kept,
coalesce(sum(t) filter (st <> 'kept'), 0)::bigint as delta_tokens, coalesce(sum(pt), 0)::bigint as prev_tokens from j group by 1, 2 having count(np) > 0 and count(pp) > 0),
q as (select p.session, p.step + 1 as step, p.pos, p.tokens, n.id is not null and n.id = p.id and n.h = p.h as same from x p left join x n on n.session = p.session and n.step = p.step + 1 and n.pos = p.pos),
u as (select session, step, coalesce(sum(tokens) filter (pos < coalesce(e, 99)), 0)::bigint as reusable_tokens from (select *, min(case when not same then pos end) over (partition by session, step) as e from q) group by 1, 2)
select c.*, u.reusable_tokens, case when prev_tokens > 0 then floor(u.reusable_tokens / prev_tokens::double * 1000 + 0.5) / 1000.0::double else 0 end as reuse_ratio from c join u using (session, step)""")
def session_delta(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("session")
    m = table(spark, d, "events").select(F.col("user_id").alias("session"), "ts", "event_id", "event_type", F.floor("value").alias("tokens"))
    m = m.withColumn("k", F.row_number().over(w.orderBy("ts", "event_id")) - 1).withColumn("step", F.floor(F.col("k") / 5)).withColumn("pos", F.col("k") % 5)
    nth = F.row_number().over(W.partitionBy("session", "step", "event_type").orderBy("k"))
    m = m.select("session", "step", "pos", F.concat("event_type", F.lit("-"), nth.cast("string")).alias("id"), F.md5(F.concat("event_type", F.floor(F.col("tokens") / 4).cast("string"))).alias("content_hash"), "tokens")
    return S.session_delta(m)


# memories, monitoring, sharing

_DEC = "value * exp(-0.6931471805599453::double * ((epoch_ms(timestamp '2024-02-01') - epoch_ms(ts)) / 1000.0::double) / 2592000.0::double)"


@query(f"select event_id, floor({_DEC} * 1000 + 0.25) / 1000.0::double as decayed from events where not (event_id % 3 = 0 and epoch_ms(ts) + 1296000 * 1000 <= epoch_ms(timestamp '2024-02-01')) and {_DEC} >= 5")
def memory_recall(spark, d):
    m = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("created_at"), F.col("value").alias("salience"), F.when(F.col("event_id") % 3 == 0, 1296000).alias("ttl_seconds"))
    return M.recall(m, NOW, 2592000, 5.0).select("event_id", (F.floor(F.col("decayed") * 1000 + 0.25) / 1000.0).alias("decayed"))


@query("select event_id, floor(pow(0.5::double, (epoch_ms(timestamp '2024-02-01') - epoch_ms(ts)) / 1000.0::double / 604800.0::double) * 1000 + 0.5) / 100.0::double as recency from events")
def memory_bridge(spark, d):
    age = (F.unix_millis(F.lit(NOW).cast("timestamp")) - F.unix_millis(F.col("ts").cast("timestamp"))) / 1000.0
    return table(spark, d, "events").select("event_id", M.bridge_recency(age, 604800.0).alias("recency"))


@query(f"""with o as (select user_id as stream, ts, event_id, list(value / 10) over w as v from events window w as (partition by user_id order by ts, event_id rows between 9 preceding and current row)),
x as (select *, len(v) as n, v[-1] as cur, list_avg(v[1:greatest(len(v) // 3, 1)]) as base, list_avg(v[len(v) // 2 + 1:]) - list_avg(v[1:len(v) // 2]) as trend from o where len(v) >= 3)
select stream, event_id, {r6('cur')} as current, {r6('base')} as baseline, {r6('trend')} as trend, case when cur - base >= 0 then 'healthy' when base - cur >= 0.2::double then 'critical' when base - cur >= 0.1::double then 'warning' else 'healthy' end as severity from x""")
def drift_windows(spark, d):
    o = table(spark, d, "events").select(F.col("user_id").alias("stream"), "ts", F.col("event_id").alias("obs_id"), (F.col("value") / 10).alias("overall"))
    r = M.drift(o, ["overall"])
    return r.select("stream", F.col("obs_id").alias("event_id"), q6(F.col("current")).alias("current"), q6(F.col("baseline")).alias("baseline"), q6(F.col("trend")).alias("trend"), "severity")


def _visible(spark, d):
    """Every event is a shared item, every fourth for all; the two agents after its source have acknowledged every tenth."""
    e = table(spark, d, "events")
    near = F.array(F.col("user_id") + 1, F.col("user_id") + 2)
    shared = e.select(F.col("event_id").alias("item_id"), F.col("user_id").alias("source_agent"), F.when(F.col("event_id") % 4 != 0, near).alias("scope"), F.col("ts").cast("timestamp").alias("expires_at"))
    agents = e.select(F.col("user_id").alias("agent")).distinct()
    acks = e.where("event_id % 10 = 0").select(F.explode(near).alias("agent"), F.col("event_id").alias("item_id"))
    return M.visible(shared, agents, acks, "2024-01-02 00:00:00")


@query("""with a as (select distinct user_id as agent from events), e as (select event_id as item_id, user_id as src, case when event_id % 4 <> 0 then [user_id + 1, user_id + 2] end as scope, ts from events where ts > timestamp '2024-01-02')
select agent, item_id from e join a on agent <> src and scope is not null and list_contains(scope, agent) where not (item_id % 10 = 0)""")
def shared_items(spark, d):
    """The scoped items among `shared_visibility`, by agent."""
    return _visible(spark, d).where("rule = 'agent'").select("agent", "item_id")


@query("""with a as (select distinct user_id as agent from events), k as (select distinct event_id as item_id, unnest([user_id + 1, user_id + 2]) as agent from events where event_id % 10 = 0),
e as (select event_id as item_id, user_id as src, case when event_id % 4 <> 0 then [user_id + 1, user_id + 2] end as scope from events where ts > timestamp '2024-01-02'),
x as (select item_id, src as agent from e where scope is null union select item_id, k.agent from e join k using (item_id) where scope is null)
select e.item_id, a.agent, 'agent' as rule from e join a on e.scope is not null and list_contains(e.scope, a.agent) where a.agent <> e.src and not exists (select 1 from k where k.item_id = e.item_id and k.agent = a.agent)
union all select item_id, null, 'all' from e where scope is null
union all select x.item_id, x.agent, 'except' from x join a on a.agent = x.agent""")
def shared_visibility(spark, d):
    return _visible(spark, d)


# learning, routing, graphs

_FEAT = "f as (select l_orderkey as r, l_quantity as q, l_discount as dc, o_totalprice as y from lineitem join orders on l_orderkey = o_orderkey where l_returnflag <> 'R'), m as (select r, max(y) as y, avg(q) as q, avg(dc) as dc from f group by 1)"


def _features(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_totalprice").alias("quality"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_quantity").alias("priority"), F.col("l_discount").alias("recency"), (F.col("l_returnflag") != "R").alias("selected"))
    return lines.join(o, "record_id")


@query(f"""with {_FEAT}, c as (select 'priority' as dimension, count(*) as samples, corr(q, y) as c from m union all select 'recency', count(*), corr(dc, y) from m)
select dimension, samples, {r6('c')} as correlation, {r6('1.0::double * 0.9::double + (1.0::double + c) * 0.1::double - ((1.0::double * 0.9::double + (1.0::double + c) * 0.1::double) - 1.0::double) * 0.01::double')} as weight from c""")
def learned_weights(spark, d):
    c = M.correlations(_features(spark, d), ["priority", "recency"])
    w = M.learned_weight(F.lit(1.0), F.col("correlation"), F.col("samples"))
    return c.select("dimension", "samples", q6(F.col("correlation")).alias("correlation"), q6(w).alias("weight"))


TIERS = [("small", 1000, 0.1, 0.3, []), ("medium", 4000, 0.5, 0.7, ["tools"]), ("large", 20000, 2.0, 1.0, ["tools", "vision"])]


@query(f"""with {ITEMS}, r as (select id, tokens, (id % 100) / 100.0::double as c, id % 8 = 3 as tools, id % 16 = 5 as vision from items),
m as (select *, case when c <= 0.3::double and tokens <= 1000 and not tools and not vision then 'small' when c <= 0.7::double and tokens <= 4000 and not vision then 'medium' when c <= 1.0::double and tokens <= 20000 then 'large' else 'medium' end as model from r)
select id as request_id, model, case model when 'small' then 'medium' when 'medium' then 'large' end as alternative, case model when 'small' then 0.4::double when 'medium' then 1.5::double else -1.0::double end as cost_delta from m""")
def route_models(spark, d):
    i = F.col("id")
    needs = F.when(i % 8 == 3, F.array(F.lit("tools"))).when(i % 16 == 5, F.array(F.lit("vision")))
    r = items(spark, d).select(i.alias("request_id"), ((i % 100) / 100.0).alias("complexity"), "tokens", needs.alias("needs"))
    return M.route(r, TIERS, default="medium").withColumn("cost_delta", F.coalesce("cost_delta", F.lit(-1.0)))


_ISS = """i as (select p_partkey as issue_id, case p_size % 3 when 0 then 'closed' when 1 then 'open' else 'in_progress' end as status from part),
dp as (select distinct l_partkey as issue_id, l_suppkey as depends_on from lineitem where l_linenumber = 1)"""


def _issues(spark, d):
    s = F.col("p_size") % 3
    i = table(spark, d, "part").select(F.col("p_partkey").alias("issue_id"), F.when(s == 0, "closed").when(s == 1, "open").otherwise("in_progress").alias("status"), F.lit(False).alias("ephemeral"), F.lit(None).cast("timestamp").alias("defer_until"))
    deps = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("issue_id"), F.col("l_suppkey").alias("depends_on"), F.lit("blocks").alias("type")).distinct()
    return i, deps


@query(f"with {_ISS} select issue_id from i where status = 'open' and not exists (select 1 from dp where dp.issue_id = i.issue_id and dp.depends_on not in (select issue_id from i where status = 'closed'))")
def ready_issues(spark, d):
    return M.ready(*_issues(spark, d), NOW).select("issue_id")


_DEPS = """n as (select doc_id as node from documents), e as (select distinct node, needs from (select doc_id as node, doc_id // 3 as needs from documents where doc_id % 2 = 0 and doc_id > 0
union all select doc_id, doc_id + 1 from documents where doc_id % 100 in (50, 51) union all select doc_id, doc_id - 2 from documents where doc_id % 100 = 52 and doc_id > 52 union all select doc_id, -7 from documents where doc_id % 25 = 9)),
r as (select node, needs as at, [node] as seen, 1 as d from e union all select r.node, e.needs, list_append(r.seen, r.at), r.d + 1 from r join e on e.node = r.at where not list_contains(r.seen, r.at))"""


def _needs(docs):
    """A tree, knots of three nodes on a cycle, and needs that are no node."""
    i = F.col("node")
    edges = [docs.where("node % 2 = 0 and node > 0").withColumn("needs", F.floor(i / 3)), docs.where("node % 100 in (50, 51)").withColumn("needs", i + 1)]
    edges += [docs.where("node % 100 = 52 and node > 52").withColumn("needs", i - 2), docs.where("node % 25 = 9").withColumn("needs", F.lit(-7).cast("long"))]
    out = edges[0]
    for x in edges[1:]:
        out = out.unionByName(x)
    return out


@query(f"with recursive {_DEPS} select n.node, coalesce(max(d), 0)::int as depth from n left join r on r.node = n.node group by 1")
def dependency_depth(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("node"))
    return G.depth(_needs(docs), docs)


# conversations, segments, rules

_TURNS = f"t as (select conv_id, turn, role, {sql_tokens('text')} as tokens from conversations)"


def _turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"""with {_TURNS}, x as (select *, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as n from t)
select conv_id, turn, case when role = 'system' then 100.0::double when i >= n - 2 then 90.0::double else greatest(10.0::double, floor(50 - i::double / greatest(n - 2, 1) * 40 + 0.5)) end as priority,
{r6('case when n > 1 then i::double / (n - 1) else 1.0::double end')} as recency from x""")
def message_priorities(spark, d):
    return C.message_priority(_turns(spark, d)).select("conv_id", "turn", "priority", q6(F.col("recency")).alias("recency"))


@query(f"""with recursive {_TURNS}, x as (select *, row_number() over (partition by conv_id order by turn desc) <= 2 as preserved from t),
b as (select conv_id, 120 - coalesce(sum(tokens) filter (preserved), 0) as left_ from x group by 1),
o as (select x.conv_id, x.turn, x.turn as ord, x.tokens, b.left_::bigint as budget, 0 as score, 0 as recency from x join b on x.conv_id = b.conv_id where not preserved), {sql_greedy('o', 'conv_id')}
select x.conv_id, x.turn, x.preserved, x.preserved or coalesce(g.chosen, false) as kept from x left join g on g.conv_id = x.conv_id and g.turn = x.turn""")
def compact_conversations(spark, d):
    return C.compact(_turns(spark, d), 120).select("conv_id", "turn", "preserved", "kept")


@query(f"with {_TURNS} select conv_id, sum(tokens)::bigint as total_tokens, " + ", ".join(f"coalesce(sum(tokens) filter (role = '{r}'), 0)::bigint as {r}_tokens" for r in ("system", "user", "assistant", "tool")) + " from t group by 1")
def conversation_usage(spark, d):
    return Q.conversation_usage(_turns(spark, d))


@query()
def structural_segments(spark, d):
    return C.segments(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "segment", "tokens")


@query("""with s as (select c_custkey as signal_id, c_custkey as n, 'CASE-' || c_custkey as case_id, 'ACC-' || c_nationkey as account_id,
case when c_custkey % 5 <> 0 then (abs(c_acctbal) / 10000)::double else 0.35::double end as a, case when c_custkey % 3 <> 0 then (c_custkey % 100) / 100.0::double else 0.02::double end as m from customer)
select signal_id, case_id, account_id, case when m >= 0.9::double or n % 17 = 0 then 'freeze_and_sar' when a >= 0.75::double then 'sar_only' when a >= 0.45::double or n % 11 = 0 then 'enhanced_due_diligence' else 'monitor' end as route from s""")
def aml_cases(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    s = c.select(k.alias("signal_id"), F.concat(F.lit("case-"), k.cast("string"), F.lit(" acc-"), F.col("c_nationkey").cast("string")).alias("text"))
    # every third has no screening result, every fifth no graph result
    facts = c.select(
        k.alias("signal_id"), F.when(k % 3 != 0, (k % 100) / 100.0).alias("sanctions"), (k % 17 == 0).alias("watchlist_hit"),
        F.when(k % 5 != 0, (F.abs("c_acctbal") / 10000).cast("double")).alias("anomaly"), (k % 11 == 0).alias("high_risk_jurisdiction"),
    )
    return C.decide_cases(C.extract_cases(s).join(facts, "signal_id")).select("signal_id", "case_id", "account_id", "route")
