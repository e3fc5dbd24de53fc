"""Queries of the segmenters over whole documents, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segmentation as G
from .model import WORDS, sql_tokens, table
from .registry import query

#: Buckets of words that make the vector of a sentence.
BUCKETS = 8


def embed(sentences: list[str]) -> list[list[float]]:
    """A deterministic model: how many words of a sentence fall into each bucket."""
    out = []
    for s in sentences:
        counts = [0.0] * BUCKETS
        for w in s.split():
            counts[(ord(w[0]) + 3 * len(w)) % BUCKETS] += 1.0
        out.append(counts)
    return out


def surprise(sentences: list[str]) -> list[float]:
    """A deterministic model: the mean square of the lengths of a sentence's words."""
    return [sum(len(w) ** 2 for w in s.split()) / max(1, len(s.split())) for s in sentences]


_SENT = rf"""p as (select row_number() over () as r, doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)) as p from documents),
q as (select r, doc_id, list_filter(list_transform(p, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as q from p),
s0 as (select r, doc_id, len(q) as n, unnest(range(len(q))) as k, unnest(q) as sent from q),
s as (select *, {WORDS.format('sent')} as words, {sql_tokens('sent')} as tokens from s0)"""

# the gap behind sentence k, 0 to n - 2, has the vectors up to k before it
_SCORES = f"""v as (select r, k, n, list_transform(range({BUCKETS}), lambda b: len(list_filter(words, lambda w: (unicode(w) + 3 * length(w)) % {BUCKETS} = b))::double) as v from s),
near as (select a.r, a.k, a.n, list_cosine_similarity(a.v, b.v) as near from v a join v b on a.r = b.r and b.k = a.k + 1),
w as (select r, k, n, ceil(5 - least(1, round(coalesce(var_samp(near) over (partition by r order by k rows between 4 preceding and 4 following), 0), 9) * 10) * 4)::bigint as w from near),
c as (select r, k, dim, sum(x) over (partition by r, dim order by k) as c from (select r, k, unnest(range({BUCKETS})) as dim, unnest(v) as x from v)),
e as (select w.r, w.k, w.n, m.dim, m.c - coalesce(a.c, 0) as x, b.c - m.c as y from w join c m on m.r = w.r and m.k = w.k
left join c a on a.r = w.r and a.dim = m.dim and a.k = w.k - w.w join c b on b.r = w.r and b.dim = m.dim and b.k = least(w.n - 1, w.k + w.w)),
g as (select r, k, n, round(sum(x * y) / sqrt(sum(x * x)) / sqrt(sum(y * y)), 9) as score from e group by 1, 2, 3),
f as (select r, k, n, score < 0.7::double or coalesce(score < lag(score) over o and score < lead(score) over o, false) as forced from g window o as (partition by r order by k))"""

# the fold: the tokens that are open before each sentence, and how many segments were closed
_FOLD = """t as (select s.r, s.doc_id, s.k, s.n, s.sent, s.tokens, coalesce(f.forced, false) as forced from s left join f on f.r = s.r and f.k = s.k),
z as (select r, k, n, 0::bigint as seg, tokens as size, k < n - 1 and (forced or tokens > 1000) as cut from t where k = 0
union all select t.r, t.k, t.n, z.seg + z.cut::int, t.tokens + case when z.cut then 0 else z.size end, t.k < t.n - 1 and (t.forced or t.tokens + case when z.cut then 0 else z.size end > 1000) from z join t on t.r = z.r and t.k = z.k + 1),
y as (select t.doc_id, t.r, t.k, t.sent, case when t.k = t.n - 1 and t.n > 1 and z.size = t.tokens then z.seg - 1 else z.seg end as seg from t join z on z.r = t.r and z.k = t.k)
select doc_id, seg::int as segment, string_agg(sent, ' ' order by k) as body from y group by r, doc_id, seg"""

_MEANING = f"with recursive {_SENT}, {_SCORES}, {_FOLD}"


@query(_MEANING)
def segments_by_meaning(spark, d):
    """All documents, cut where the mean word counts of neighbouring sentences part."""
    return G.semantic(table(spark, d, "documents"), embed)


_SURPRISE = f"""with recursive {_SENT},
x as (select *, list_sum(list_transform(words, lambda w: length(w) * length(w)))::double / len(words) as x from s),
t as (select r, doc_id, k, n, sent, tokens, coalesce(round((x - avg(x) over (partition by r)) / nullif(stddev_samp(x) over (partition by r), 0), 9) > 2.0::double, false) as odd from x),
z as (select r, k, 0::bigint as seg, tokens as size, tokens > 800 as cut from t where k = 0
union all select t.r, t.k, z.seg + (z.cut or t.odd)::int, t.tokens + case when z.cut or t.odd then 0 else z.size end, case when t.odd and not z.cut then false else t.tokens + case when z.cut then 0 else z.size end > 800 end from z join t on t.r = z.r and t.k = z.k + 1)
select t.doc_id, z.seg::int as segment, string_agg(t.sent, ' ' order by t.k) as body from t join z on z.r = t.r and z.k = t.k group by t.r, t.doc_id, z.seg"""


@query(_SURPRISE)
def segments_by_surprise(spark, d):
    """All documents, cut before sentences of unusually long words."""
    return G.surprise(table(spark, d, "documents"), surprise)


@query(_MEANING)
def segments_as_tables(spark, d):
    """The segments by meaning from SQL, through the table function."""
    G.register_segmenters(spark, embed, surprise)
    docs = table(spark, d, "documents")
    return spark.sql("select doc_id, segment, body from meaning_segments(table(select doc_id, text from {docs}) partition by doc_id)", docs=docs)
