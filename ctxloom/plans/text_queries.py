"""Queries of the text scalars and query-aware scores, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval as R
from ..operators import vector_index as V
from .model import ITEMS, items, sql_tokens, table
from .queries import _STOP, _TOK, q6, r6
from .registry import query

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_KEY = f"list_filter(list_distinct({_TOK}), lambda x: not list_contains({_STOP}, x))"
_ASKED = "a as (select d.doc_id, d.text, b.text as q from documents d join benchmark b on b.item_id = d.doc_id % 40)"


def _keys(words):
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in T.STOPWORDS]))


@query(f"""with {_ASKED}, k as (select doc_id, {_KEY.format('q')} as qk, {_KEY.format('text')} as dk, {_TOK.format('q')} as qt, {_TOK.format('text')} as dt,
list_distinct(regexp_extract_all(lower(q), '[a-z0-9_]+')) as qa, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) as da, len(list_intersect(qa, da)) as n_both from a),
f as (select doc_id, w, count(*) as times from (select doc_id, unnest(qt) as w from k) group by 1, 2), e as (select doc_id, w, count(*) as tf from (select doc_id, unnest(dt) as w from k) group by 1, 2),
b as (select f.doc_id, sum(times * ln(0.5::double / 1.5::double + 1) * tf * 2.2::double / (tf + 1.2::double)) as s from f join e on f.doc_id = e.doc_id and f.w = e.w group by 1)
select k.doc_id, {r6("case when len(qk) > 0 then len(list_intersect(qk, dk)) / len(qk)::double else 0::double end")} as keyword_relevance, {r6("coalesce(s, 0) / (coalesce(s, 0) + 1)")} as relevance,
{r6("case when len(qa) + len(da) - n_both = 0 then 0 else n_both / (len(qa) + len(da) - n_both)::double end")} as overlap from k left join b on b.doc_id = k.doc_id""")
def query_relevance(spark, d):
    q, t, none = F.col("q"), F.col("text"), F.lit(None).cast("array<double>")
    # what a query or a text is parted into is a column of its own, so each is read once
    asked = table(spark, d, "benchmark").select("item_id", F.col("text").alias("q")).select("item_id", T.tokens(q).alias("qt"), T.ascii_words(q).alias("qa")).select("*", _keys("qt").alias("qk"))
    docs = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 40).alias("item_id"), T.tokens(t).alias("dt"), T.ascii_words(t).alias("da"))
    both = docs.join(asked, "item_id")
    return both.select(
        "doc_id", q6(T.keyword_relevance(F.col("qk"), F.col("dt"))).alias("keyword_relevance"), q6(T.relevance(none, none, F.col("qt"), F.col("dt"))).alias("relevance"),
        q6(T.jaccard(F.col("qa"), F.col("da"))).alias("overlap"),
    )


@query(f"""with {ITEMS}, t as (select doc_id, {_TOK.format('text')} as t from documents), sz as (select doc_id, len(t) as n from t), st as (select count(*) as nd, avg(n) as av from sz),
q as (select unnest({_TOK.format('text')}) as term from benchmark where item_id = 0), qt as (select term, count(*) as times from q group by 1),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from t) group by 1, 2), df as (select term, count(*) as df from tf group by 1),
bm as (select tf.doc_id, sum(times * ln((nd - df + 0.5::double) / (df + 0.5::double) + 1) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * n / av))) as s
from tf join qt on qt.term = tf.term join df on tf.term = df.term join sz on tf.doc_id = sz.doc_id cross join st group by 1)
select id, pack_id, {r6("score + 0.8::double * coalesce(s / (s + 1), 0)")} as score from items left join bm on bm.doc_id = items.id""")
def score_query_aware(spark, d):
    asked = table(spark, d, "benchmark").where("item_id = 0").select(F.col("item_id").alias("query_id"), "text")
    return R.query_aware(items(spark, d, content=True), asked).select("id", "pack_id", q6(F.col("score")).alias("score"))


_TOPIC = rf"regexp_replace(left(string_split_regex(regexp_replace(regexp_replace(text, '^#+\s*', ''), '^\s+|\s+$', '', 'g'), '[.!?\n]')[1], 60), '^\s+|\s+$', '', 'g')"
_SCRIPTS = " + ".join(f"regexp_matches(text, '[{r}]')::int" for r in T.SCRIPTS)
_ROOM = "left(t, room)"


@query(rf"""with x as (select doc_id, text, {_TOPIC} as topic, {_TRIM.format('text')} as t, doc_id % 40 + 5 as b, ((doc_id % 40 + 5) * 4 - 3)::int as room from documents)
select doc_id, topic, case when contains(lower(topic), 'use ') then regexp_replace(topic, 'use ', 'avoid ', 'i') when contains(lower(topic), 'always ') then regexp_replace(topic, 'always ', 'never ', 'i')
when contains(lower(topic), 'enable ') then regexp_replace(topic, 'enable ', 'disable ', 'i') else 'not ' || lower(topic) end as opposite, ({_SCRIPTS})::int as scripts, ceil(length(text) / 4.0::double)::bigint as tokens_print,
case when ceil(length(t) / 4.0::double) <= b then text else regexp_replace({_ROOM}, '\s+$', '') || '...' end as truncated from x""")
def topics(spark, d):
    docs, t = table(spark, d, "documents"), F.col("text")
    return docs.select(
        "doc_id", T.topic(t).alias("topic"), T.opposite(t).alias("opposite"), T.scripts(t).cast("int").alias("scripts"), T.fingerprint_tokens(t).alias("tokens_print"), T.truncated(t, F.col("doc_id") % 40 + 5).alias("truncated")
    )


@query(f"""with x as (select o_orderkey as k, o_totalprice as p, o_custkey as c from orders),
g as (select k, p, c, (((k % 97) + (k % 50 + 1) * 1831565813::hugeint) % 4294967296)::hugeint as s from x),
h as (select *, (xor(s::bigint, s::bigint >> 15)::hugeint * (s::bigint | 1)::hugeint % 4294967296)::bigint as t from g),
i as (select *, xor(((t::hugeint + xor(t, t >> 7)::hugeint * (t | 61)::hugeint) % 4294967296)::bigint, t) as u from h)
select k as o_orderkey, {r6('xor(u, u >> 14) / 4294967296.0::double')} as draw, greatest(0, least(4, 4 - floor((k % 11) / 10.0::double * 4)))::int as bucket, greatest(1, floor((4 - k % 5) / 4.0::double * 10 + 0.5))::int as priority,
floor((k % 3000) / 2000.0::double * 10000 + 0.5) / 100.0::double as utilization, floor((k * 1000)::double * 0.7::double)::bigint as budget, floor((k * 1000)::double * 0.65::double)::bigint as budget_gpt4 from i""")
def scalars(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", q6(T.random32(k % 97, k % 50 + 1)).alias("draw"), T.priority_bucket((k % 11).cast("double")).alias("bucket"), T.bucket_priority(k % 5).alias("priority"),
        T.utilization(k % 3000, F.lit(2000.0)).alias("utilization"), T.effective_budget((k * 1000).cast("double"), "claude").alias("budget"), T.effective_budget((k * 1000).cast("double"), "gpt4").alias("budget_gpt4"),
    )


@query(f"""select conv_id, turn, least(512 + case when {sql_tokens('text')} > 500 then 1024 else 0 end + case when contains(lower(text), 'analyze') or contains(lower(text), 'debug') or contains(lower(text), 'compare')
or contains(lower(text), 'refactor') or contains(lower(text), 'summarize everything') then 2048 else 0 end, case when turn % 9 = 8 then 0 else 8192 end) + case when turn % 9 = 8 then 8192 else 0 end as budget from conversations""")
def adaptive_budgets(spark, d):
    depth = F.when(F.col("turn") % 9 == 8, "exhaustive")
    return table(spark, d, "conversations").select("conv_id", "turn", T.adaptive_budget(F.col("text"), depth).alias("budget"))


_CODES = "list_transform(string_split(url, ''), lambda x: unicode(x)::bigint)"


@query(f"""select page_id, lower(to_base(list_reduce(list_prepend(0::bigint, {_CODES}), lambda h, c: (h * 31 + c) % 4294967296), 36)
|| to_base(list_reduce(list_prepend(2166136261::bigint, {_CODES}), lambda h, c: (xor(h, c) * 16777619) % 4294967296), 36)) as hash from pages""")
def url_hashes(spark, d):
    return table(spark, d, "pages").select("page_id", T.hash64(F.col("url")).alias("hash"))


_CAND = ["Contain the host", "monitor-only and wait", "targeted rollback", "safe isolate with priority", "Delay"]
_SCEN = ["critical incident: isolate and contain", "a calm day to monitor"]


def _sql_candidates():
    c, x = "lower(c)", "lower(x)"
    urgent = " or ".join(f"contains({x}, '{w}')" for w in T.URGENT)
    plus = " + ".join(f"case when contains({c}, '{w}') then case when contains({x}, '{w}') then {k * 1.5}::double else {k}::double end else 0::double end" for w, k in T.FOR.items())
    minus = " - ".join(f"case when contains({c}, '{w}') and ({urgent}) then {k}::double else 0::double end" for w, k in T.AGAINST.items())
    return f"with r as (select o_orderkey, {_CAND}[o_orderkey % 5 + 1] as c, {_SCEN}[o_orderkey % 2 + 1] as x from orders) select o_orderkey, {r6(f'greatest(0, 0.5::double + {plus} - {minus})')} as score from r"


@query(_sql_candidates())
def candidate_scores(spark, d):
    k = F.col("o_orderkey")
    pick = [F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int")) for values in (_CAND, _SCEN)]
    return table(spark, d, "orders").select("o_orderkey", q6(T.candidate_score(*pick)).alias("score"))


@query()
def indexed_top10(spark, d):
    """The ten nearest of each 20th vector among all, by an index; its recall against cosine_top10 is tested."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return V.nearest(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10)
