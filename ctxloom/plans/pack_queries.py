"""Queries of the packs whose order depends on what is in, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import conversations as C
from ..operators import extended_pack as X
from ..operators import packing as P
from ..operators import summary_pack as S
from .flow_queries import _T, _turns
from .model import BUDGET, ITEMS, items, sql_greedy, table
from .registry import query

NEAR = 0.25


def linked_items(spark, d) -> DataFrame:
    """The items of each source, related to the ones before them, with the vectors of the same number."""
    w = W.partitionBy("pack_id").orderBy("ord")
    before = {n: F.lag("id", n).over(w) for n in (1, 2, 3)}
    rows = items(spark, d).withColumns({f"_{n}": c for n, c in before.items()})
    i = F.col("id")
    related = rows.withColumns({
        "links": F.when(i % 3 == 0, F.array_compact(F.array("_1", "_2")).cast("array<string>")), "parent_id": F.when(i % 7 == 0, F.col("_3")), "supersedes": F.when(i % 11 == 0, F.col("_1")),
    }).drop("_1", "_2", "_3")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return related.join(vectors, "id", "left")


_SQL = f"""with recursive {ITEMS}, x as (select *, lag(id, 1) over w as p1, lag(id, 2) over w as p2, lag(id, 3) over w as p3 from items window w as (partition by pack_id order by ord)),
e as (select x.pack_id, x.id, ord, tokens, score, recency, budget, case when x.id % 3 = 0 then list_filter([p1, p2], lambda l: l is not null) else [] end as links, case when x.id % 7 = 0 then p3 end as parent_id,
case when x.id % 11 = 0 then p1 end as supersedes, v.embedding::double[] as v from x left join embeddings v on v.vec_id = x.id),
a as (select * from e where not exists (select 1 from e s where s.pack_id is not distinct from e.pack_id and s.supersedes = e.id)),
r as (select pack_id, 0 as nth, max(budget) as room, []::bigint[] as ids, []::double[][] as vs, null::bigint as id, null::double as pts, null::double as recency, null::bigint as ord, null::double[] as v from a group by 1
union all select pack_id, nth + 1, room - tokens, list_append(ids, aid), case when av is null then vs else list_append(vs, av) end, aid, now, ar, ao, av from (select r.pack_id, r.nth, r.room, r.ids, r.vs, a.tokens, a.id as aid, a.recency as ar, a.ord as ao, a.v as av,
a.score + 2.0::double * len(list_intersect(a.links, r.ids)) as now, row_number() over (partition by r.pack_id order by a.score + 2.0::double * len(list_intersect(a.links, r.ids)) desc, a.recency desc, a.ord) as k
from r join a on a.pack_id = r.pack_id where a.tokens <= r.room and not list_contains(r.ids, a.id) and not coalesce(list_contains(r.ids, a.parent_id), false)
and len(list_filter(r.vs, lambda s: list_cosine_similarity(s, a.v) > {NEAR}::double)) = 0) where k = 1),
t as (select * from r where nth > 0),
u as (select a.pack_id, a.id, a.parent_id, a.score, a.recency, a.ord, t.nth, t.id as tid, t.pts, t.recency as tr, t.ord as tord, list_cosine_similarity(a.v, t.v) as near,
coalesce(sum(list_contains(a.links, t.id)::int) over (partition by a.pack_id, a.id order by t.nth rows between unbounded preceding and 1 preceding), 0) as n from a join t on t.pack_id = a.pack_id),
f as (select pack_id, id, min(nth) filter (where score + 2.0::double * n > pts or (score + 2.0::double * n = pts and (recency > tr or (recency = tr and ord < tord)))) as stop from u group by 1, 2),
s as (select u.pack_id, u.id, bool_or(tid = parent_id) as parent, bool_or(near > {NEAR}::double) as near from u join f on f.pack_id = u.pack_id and f.id = u.id where stop is null or nth < stop group by 1, 2)
select e.pack_id, e.id, case when a.id is null then 'negated_by_newer_info' when t.id is not null then 'include' when coalesce(s.parent, false) then 'parent_already_included' when coalesce(s.near, false) then 'semantic_redundancy' else 'over_budget' end as decision
from e left join a on a.pack_id = e.pack_id and a.id = e.id left join t on t.pack_id = e.pack_id and t.id = e.id left join s on s.pack_id = e.pack_id and s.id = e.id"""


@query(_SQL)
def extended_packs(spark, d):
    """All sources under their budgets, with links, parents, superseded items and near vectors."""
    return X.extended(linked_items(spark, d), redundancy=NEAR).select("pack_id", "id", "decision")


def shorten(asked: list[tuple[str, int]]) -> list[tuple[str, int | None] | None]:
    """A deterministic summarizer: as many of the first words as half the tokens that are left."""
    out = []
    for text, room in asked:
        words = text.split()[: room // 2]
        out.append((" ".join(words), None) if words else None)
    return out


# what an item would take in a summary, with `room` tokens left
_SHORT = r"list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')"
_SUM = f"len({_SHORT}[1:(room // 2)::int])"
_EATEN = f"case when tokens <= room then tokens when id % 3 = 0 and tokens // 4 <= room then tokens // 4 when room > 0 and {_SUM} > 0 and greatest(1, ceil({_SUM} * 1.3::double)) <= room then greatest(1, ceil({_SUM} * 1.3::double))::bigint end"


@query(f"""with recursive {ITEMS}, o as (select *, row_number() over (partition by pack_id order by score desc, recency desc, ord) as rn from items),
f as (select pack_id, 0::bigint as rn, max(budget)::bigint as room, null::bigint as id, null::bigint as eaten, null::varchar as summary, null::bigint as tokens from items group by 1
union all select pack_id, rn, (room - coalesce(eaten, 0))::bigint, id, eaten, summary, tokens from (select o.pack_id, o.rn, f.room, o.id, o.tokens, {_EATEN.replace('tokens', 'o.tokens').replace('id %', 'o.id %').replace('room', 'f.room')} as eaten,
array_to_string({_SHORT}[1:(f.room // 2)::int], ' ') as summary from f join o on o.pack_id = f.pack_id and o.rn = f.rn + 1))
select pack_id, id, case when eaten is null then 'exclude' when eaten = tokens then 'include' when id % 3 = 0 and eaten = tokens // 4 then 'compress' else 'summarize' end as decision, eaten as taken_tokens,
case when eaten is not null and eaten <> tokens and not (id % 3 = 0 and eaten = tokens // 4) then summary end as summary from f where rn > 0""")
def summary_packs(spark, d):
    """All sources under their budgets; every third item has a variant of a quarter, the others are summarized where they do not fit."""
    rows = items(spark, d, content=True).withColumn("sizes", F.when(F.col("id") % 3 == 0, F.array(F.floor(F.col("tokens") / 4))))
    return S.summary_pack(rows, shorten).select("pack_id", "id", "decision", "taken_tokens", "summary")


@query(rf"""with {_T}, x as (select *, row_number() over (partition by conv_id order by turn desc) <= 2 as preserved from t), o as (select *, (row_number() over (partition by conv_id order by turn) - 1) // 2 as batch from x where not preserved),
b as (select conv_id, batch, count(*) as turns, string_agg('[' || role || ']: ' || coalesce(text, ''), chr(10) order by turn) as text from o group by 1, 2)
select conv_id, batch, turns, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:20], ' ') as summary from b""")
def model_summaries(spark, d):
    """The older turns of each conversation, two at a time, by the summarizer."""
    return C.summarized_at_once(C.batches(_turns(spark, d), size=2), shorten, 40).select("conv_id", "batch", "turns", "summary")


_LAYERS = f"""c as (select *, row_number() over (partition by pack_id order by l, case when l = 0 then id end, case when l > 0 then -score end, case when l > 0 then -recency end, ord) - 1 as position,
count(*) filter (l = 0) over (partition by pack_id) as ns, count(*) filter (l <= 1) over (partition by pack_id) as nt, count(*) over (partition by pack_id) as n from (select *, case volatility when 'static' then 0 when 'session' then 1 else 2 end as l from z))"""


def _layers() -> str:
    """CTEs ending in z: what each layer takes of what the ones before it left."""
    out, rest = [f"""with recursive {ITEMS}, i as (select *, case when kind in ({', '.join(f"'{k}'" for k in P.STATIC)}) then 'static' when kind in ({', '.join(f"'{k}'" for k in P.SESSION)}) then 'session' else 'request' end as volatility from items)"""], f"{BUDGET}::bigint"
    for n, layer in enumerate(("static", "session", "request")):
        left = f"({BUDGET} - coalesce((select sum(tokens) from g{n - 1}_all y where y.pack_id = i.pack_id), 0))::bigint" if n else rest
        out.append(f"i{n} as (select * replace ({left} as budget) from i where volatility = '{layer}')")
        out.append(sql_greedy(f"i{n}", "pack_id", f"g{n}", "id" if not n else "score desc, recency desc, ord"))
        out.append(f"g{n}_all as (select * exclude (chosen, rn) from g{n} where chosen" + (f" union all select * from g{n - 1}_all" if n else "") + ")")
    return ", ".join(out) + ", z as (select * from g2_all)"


_KEY = """list_transform(list_filter(string_split(coalesce(string_agg(case when l = 0 then id || ':' || coalesce(content, '') end, '|' order by id), ''), ''), lambda x: x <> ''), lambda x: unicode(x)::bigint)"""


@query(f"""{_layers()}, {_LAYERS} select pack_id, id, position, case when position = ns - 1 and ns < n then 'static-end' when position = nt - 1 and nt > ns and nt < n then 'session-end' end as breakpoint from c""")
def cache_layouts(spark, d):
    return P.cache_layout(_cached(spark, d))


@query(f"""{_layers()}, {_LAYERS}, k as (select pack_id, max(ns) as static_count, max(nt) - max(ns) as session_count, max(n) - max(nt) as request_count, coalesce(sum(tokens) filter (l = 0), 0)::bigint as cacheable_tokens,
coalesce(sum(tokens) filter (l > 0), 0)::bigint as volatile_tokens, {_KEY} as codes from c group by 1)
select pack_id, static_count, session_count, request_count, cacheable_tokens, volatile_tokens, case when cacheable_tokens + volatile_tokens > 0 then floor(cacheable_tokens / (cacheable_tokens + volatile_tokens)::double * 1000 + 0.5) / 1000.0::double else 0 end as efficiency,
lower(to_base(list_reduce(list_prepend(0::bigint, codes), lambda h, c: (h * 31 + c) % 4294967296), 36) || to_base(list_reduce(list_prepend(2166136261::bigint, codes), lambda h, c: (xor(h, c) * 16777619) % 4294967296), 36)) as cache_key from k""")
def cache_summaries(spark, d):
    return P.cache_summary(_cached(spark, d))


def _cached(spark, d):
    rows = items(spark, d, content=True)
    return P.by_volatility(rows.withColumn("volatility", P.volatility(F.col("kind"), P.STATIC, P.SESSION)))
