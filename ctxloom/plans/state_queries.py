"""Queries of memories, drift, sharing, immunity, routing and versions, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import immune as I
from ..operators import memory as Y
from ..operators import monitoring as M
from ..operators import packing as P
from ..operators import quality as Q
from ..operators import sets as S
from .model import ITEMS, NOW, items, sql_greedy, table
from .queries import _DEPS, _needs, q6, r6
from .registry import oracle_sql, query

# memories

_AGE = "((epoch_ms(timestamp '2024-02-01') - epoch_ms(ts)) / 1000.0::double)"


def _memories(spark, d):
    """Events as memories: every third lives for 15 days, every fourth has no salience, every fifth a vector."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    rows = e.select(
        i.alias("id"), F.concat("event_type", F.lit(" by "), F.col("user_id").cast("string")).alias("content"), F.col("ts").cast("timestamp").alias("created_at"),
        F.when(i % 3 == 0, 1296000).alias("ttl_seconds"), F.when(i % 4 != 0, F.col("value") / 100).alias("salience"), (i % 7 == 0).alias("is_summary"),
    )
    return Y.normalize(rows, NOW)


_MEM = f"""m as (select event_id as id, event_type || ' by ' || user_id as content, ts, case when event_id % 3 = 0 then 1296000 end as ttl, coalesce(case when event_id % 4 <> 0 then value / 100 end, 1)::double as salience,
event_id % 7 = 0 as is_summary from events)"""


@query(f"""with {_MEM} select id, case when salience < 0.3::double and not is_summary then '[Flashcard] ' || left(content, 5) else content end as content, floor(case when salience < 0.3::double and not is_summary then 0.4::double else salience end * 10000 + 0.5) / 10000.0::double as salience,
is_summary or salience < 0.3::double as is_summary from m where id % 50 <> 0""")
def memory_consolidate(spark, d):
    """Consolidated memories, less those that were forgotten (every fiftieth)."""
    m = _memories(spark, d)
    left = Y.forget(m, m.where("id % 50 = 0").select("id"))
    return Y.consolidate(left, lambda c: F.substring(c, 1, 5), NOW).select("id", "content", T.half_up(F.col("salience"), 4).alias("salience"), "is_summary")


@query(f"""with {_MEM}, q as (select * from (values (0, null), (1, 'click'), (2, 'by 7')) q(query_id, w)), x as (select query_id, id, 0.5::double + 0.5::double * salience * pow(0.5::double, ((epoch_ms(timestamp '2024-02-01') - epoch_ms(ts)) / 1000.0::double) / 604800.0::double) as s from m join q on w is null or contains(lower(content), w)
where not (ttl is not null and epoch_ms(ts) + ttl * 1000 <= epoch_ms(timestamp '2024-02-01')))
select query_id, id, {r6('s')} as score, row_number() over (partition by query_id order by s desc, id)::int as rank from x where s >= 0.505::double qualify rank <= 25""")
def memory_hybrid(spark, d):
    none = F.lit(None).cast("array<double>")
    asked = spark.createDataFrame([(0, None), (1, "click"), (2, "by 7")], "query_id int, text string").withColumn("vector", none)
    found = Y.hybrid(_memories(spark, d).withColumn("embedding", none), asked, NOW, 604800.0, least=0.505, limit=25)
    return found.select("query_id", "id", q6(F.col("score")).alias("score"), "rank")


_VH = """v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), n as (select vec_id, e, sqrt(list_dot_product(e, e)) as m from v),
q as (select vec_id as query_id, e as qe, m as qm from n where vec_id < 5),
x as (select query_id, vec_id as id, 0.5::double * (list_dot_product(e, qe) / (m * qm)) + 0.5::double * ((vec_id % 10) / 10.0::double) as s from n, q)"""


@query(f"with {_VH} select query_id, id, {r6('s')} as score, row_number() over (partition by query_id order by s desc, id)::int as rank from x where s >= 0.2::double qualify rank <= 10")
def memory_vectors(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), ((F.col("vec_id") % 10) / 10.0).alias("salience"))
    m = v.withColumns({"created_at": F.lit(NOW).cast("timestamp"), "ttl_seconds": F.lit(None).cast("int"), "content": F.lit("")})
    asked = v.where("id < 5").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"), F.lit(None).cast("string").alias("text"))
    return Y.hybrid(m, asked, NOW, 1.0, least=0.2, limit=10).select("query_id", "id", q6(F.col("score")).alias("score"), "rank")


@query("""with s as (select distinct event_type || user_id as key from events where ts > timestamp '2024-01-20' and event_id % 2 = 0),
t as (select event_type || (user_id + 1) as key, event_id from events where event_id % 2 = 1 qualify row_number() over (partition by event_type || (user_id + 1) order by event_id) = 1)
select key, event_id from t where key not in (select key from s)""")
def unseen_tasks(spark, d):
    e = table(spark, d, "events")
    seen = e.where("event_id % 2 = 0").select(F.concat("event_type", F.col("user_id").cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("at"))
    tasks = e.where("event_id % 2 = 1").select(F.concat("event_type", (F.col("user_id") + 1).cast("string")).alias("key"), F.col("event_id").alias("ord"))
    return Y.unseen(tasks, seen, NOW, 12 * 86400).select("key", F.col("ord").alias("event_id"))


# drift

_DIMS = [("overall", "value / 10", 0.2, -1), ("redundancy", "value / 20", 0.4, 1), ("diversity", "1 - value / 15", 0.3, -1), ("stale_ratio", "(event_id % 10) / 10.0::double", 0.5, 1), ("utilization", "(event_id % 7) / 7.0::double", 0.5, -1), ("density", "value / 12", 0.25, -1)]
_LONG = " union all ".join(f"select user_id as stream, ts, event_id, '{n}' as dimension, ({e})::double as x, {t}::double as limit_, {s} as bad from events" for n, e, t, s in _DIMS)
_DRIFT = f"""l as ({_LONG}), o as (select stream, ts, event_id, dimension, limit_, bad, list(x) over w as v from l window w as (partition by stream, dimension order by ts, event_id rows between 9 preceding and current row)),
y as (select *, v[-1] - list_avg(v[1:greatest(len(v) // 3, 1)]) as delta, list_avg(v[len(v) // 2 + 1:]) - list_avg(v[1:len(v) // 2]) as trend from o where len(v) >= 3),
z as (select *, case when delta * bad <= 0 then 0 when abs(delta) >= limit_ then 2 when abs(delta) >= limit_ / 2 then 1 else 0 end as lv from y)"""


def _observations(spark, d):
    e = table(spark, d, "events")
    i, v = F.col("event_id"), F.col("value")
    return e.select(
        F.col("user_id").alias("stream"), "ts", i.alias("obs_id"), (v / 10).alias("overall"), (v / 20).alias("redundancy"), (1 - v / 15).alias("diversity"),
        ((i % 10) / 10.0).alias("stale_ratio"), ((i % 7) / 7.0).alias("utilization"), (v / 12).alias("density"),
    )


@query(f"""with {_DRIFT} select stream, event_id, dimension, case lv when 2 then 'critical' else 'warning' end as severity,
case when abs(trend) < 0.02::double then 'stable' when (case when dimension in ('redundancy', 'stale_ratio') then trend < 0 else trend > 0 end) then 'improving' else 'degrading' end as trend,
case dimension when 'overall' then 'overall relevance' when 'redundancy' then 'content redundancy' when 'diversity' then 'topic diversity' when 'stale_ratio' then 'stale item ratio' when 'utilization' then 'budget utilization' else 'information density' end
|| case when delta > 0 then ' has increased' else ' has decreased' end as message from z where lv > 0""")
def drift_alerts(spark, d):
    a = M.alerts(M.drift(_observations(spark, d), [n for n, *_ in _DIMS]))
    message = F.regexp_extract("message", r"^\w+: (.* has \w+) by [0-9.]+$", 1)
    return a.select("stream", F.col("obs_id").alias("event_id"), "dimension", "severity", M.trend_class(F.col("dimension"), F.col("trend")).alias("trend"), message.alias("message"))


@query(f"""with {_DRIFT}, w as (select stream, ts, event_id, max(lv) as lv from z group by all), g as (select *, sum((lv = 0)::int) over (partition by stream order by ts, event_id) as run from w)
select stream, event_id, case lv when 2 then 'critical' when 1 then 'warning' else 'healthy' end as status, coalesce(epoch_us(case when lv > 0 then min(case when lv > 0 then ts end) over (partition by stream, run) end), 0) as since from g""")
def drift_reports(spark, d):
    s = M.drift_status(M.drift(_observations(spark, d), [n for n, *_ in _DIMS]))
    return s.select("stream", F.col("obs_id").alias("event_id"), "status", F.coalesce(F.unix_micros(F.col("since").cast("timestamp")), F.lit(0)).alias("since"))


# sharing

def _shared(spark, d):
    e = table(spark, d, "events")
    i = F.col("event_id")
    near = F.array(F.col("user_id") + 1, F.col("user_id") + 2)
    policy = F.when(i % 3 == 0, "immediate").when(i % 3 == 1, "next-pack").otherwise("on-demand")
    return e.select(i.alias("item_id"), F.col("user_id").alias("source_agent"), F.col("event_type").alias("kind"), F.when(i % 4 != 0, near).alias("scope"), policy.alias("propagation"), F.col("ts").cast("timestamp").alias("expires_at"))


_SHARED = "s as (select event_id as item_id, user_id as src, event_type as kind, case when event_id % 4 <> 0 then [user_id + 1, user_id + 2] end as scope, case event_id % 3 when 0 then 'immediate' when 1 then 'next-pack' else 'on-demand' end as p, ts from events)"


@query(f"""with {_SHARED}, a as (select distinct user_id as agent from events)
select agent, item_id from s join a on list_contains(scope, agent) where ts > timestamp '2024-01-02' and agent <> src and (agent % 2 = 0 or kind in ('click', 'view')) and p <> 'on-demand' and not (p = 'immediate' and item_id % 10 = 0)""")
def injected_items(spark, d):
    e = table(spark, d, "events")
    kinds = F.when(F.col("user_id") % 2 == 1, F.array(F.lit("click"), F.lit("view")))
    agents = e.select(F.col("user_id").alias("agent"), kinds.alias("kinds")).distinct()
    acks = e.where("event_id % 10 = 0").select(F.explode(F.array(F.col("user_id") + 1, F.col("user_id") + 2)).alias("agent"), F.col("event_id").alias("item_id"))
    return M.for_agents(_shared(spark, d), agents, acks, "2024-01-02 00:00:00")


@query(f"""with {_SHARED} select 'source' as side, src::varchar as agent, count(*) as items from s group by 2 union all select 'target', x::varchar, count(*) from (select unnest(coalesce(list_transform(scope, lambda y: y::varchar), ['*'])) as x from s) group by 2""")
def mesh_stats(spark, d):
    return M.mesh_stats(_shared(spark, d))


# immunity

_IMM = f"""w as (select pack_id, ord, kind, priority, recency, tokens, budget, list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> '')) as s, row_number() over (partition by pack_id order by ord) as k from items),
c as (select * from w where k <= 50), pr as (select a.pack_id, a.k as a, b.k as b from c a join c b on a.pack_id = b.pack_id and a.k < b.k and case when len(a.s) + len(b.s) = 0 then true else len(list_intersect(a.s, b.s)) * 5 > (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) * 4 end),
h as (select pack_id, count(distinct x) as h from (select pack_id, unnest([a, b]) as x from pr) group by 1),
rd as (select c.pack_id, coalesce(max(h), 0) / count(*)::double as redundancy from c left join h on h.pack_id = c.pack_id group by 1),
fp as (select pack_id, count(*) as n, min(priority) as p1, max(priority) as p2, avg(priority) as p3, stddev_pop(priority) as p4, min(recency) as r1, max(recency) as r2, avg(recency) as r3, stddev_pop(recency) as r4,
least(sum(tokens) / max(budget)::double, 1) as tu, avg(case when recency < 0.2::double then 1.0::double else 0.0::double end) as st from items group by 1),
kc as (select pack_id, coalesce(kind, 'unknown') as kind, count(*) as n from items group by 1, 2), kr as (select pack_id, kind, n / (sum(n) over (partition by pack_id))::double as r from kc),
kn as (select pack_id, sqrt(sum(r * r)) as m from kr group by 1), kd as (select a.pack_id as x, b.pack_id as y, sum(a.r * b.r) as dt from kr a join kr b on a.kind = b.kind group by 1, 2),
al as (select a.pack_id as x, b.pack_id as y, 0.2::double * (coalesce(dt, 0) / (na.m * nb.m)) + 0.15::double * greatest(0, 1 - sqrt((a.p1 - b.p1) ** 2 + (a.p2 - b.p2) ** 2 + (a.p3 - b.p3) ** 2 + (a.p4 - b.p4) ** 2) / 2)
+ 0.15::double * greatest(0, 1 - sqrt((a.r1 - b.r1) ** 2 + (a.r2 - b.r2) ** 2 + (a.r3 - b.r3) ** 2 + (a.r4 - b.r4) ** 2) / 2) + 0.15::double * (1 - abs(a.tu - b.tu)) + 0.1::double * (1 - abs(a.n - b.n) / greatest(a.n, b.n)::double)
+ 0.1::double * (1 - abs(a.st - b.st)) + 0.15::double * (1 - abs(ra.redundancy - rb.redundancy)) as sim
from fp a join fp b on true join kn na on na.pack_id = a.pack_id join kn nb on nb.pack_id = b.pack_id left join kd on kd.x = a.pack_id and kd.y = b.pack_id join rd ra on ra.pack_id = a.pack_id join rd rb on rb.pack_id = b.pack_id where b.pack_id in ('src1', 'src2', 'src3'))"""


def _screened(spark, d):
    p = I.pattern(items(spark, d, content=True))
    body = F.struct(*[x for x in p.columns if x != "pack_id"])
    new = p.where(F.col("pack_id").isin("src1", "src2", "src3")).select(
        F.col("pack_id").alias("id"), body.alias("pattern"), F.lit("wrong answer").alias("symptom"), F.lit(None).cast("string").alias("diagnosis"),
        F.when(F.col("pack_id") == "src1", "block").alias("severity"), F.substring("pack_id", 4, 1).cast("long").alias("created"),
    )
    return p, I.screen(p, I.remember(new.limit(0), new))


@query(f"with {ITEMS}, {_IMM} select x as pack_id, y as antibody, {r6('sim')} as similarity, case y when 'src1' then 'block' else 'warning' end as severity from al where sim >= 0.7::double")
def immune_screen(spark, d):
    return _screened(spark, d)[1].select("pack_id", "antibody", q6(F.col("similarity")).alias("similarity"), "severity")


@query(f"with {ITEMS}, {_IMM}, f as (select x, y from al where sim >= 0.7::double) select fp.pack_id, count(case when y = 'src1' then 1 end) = 0 as safe, count(case when y <> 'src1' then 1 end) as warnings, count(case when y = 'src1' then 1 end) as blocked from fp left join f on f.x = fp.pack_id group by 1")
def immune_verdicts(spark, d):
    return I.safe(*_screened(spark, d))


@query(f"with {ITEMS}, {_IMM} select pack_id, {r6('redundancy')} as redundancy from rd")
def redundancy_estimates(spark, d):
    return I.redundancy_estimate(items(spark, d, content=True)).select("pack_id", q6(F.col("redundancy")).alias("redundancy"))


# routing

_OUT = "o as (select o_orderkey, case o_orderkey % 3 when 0 then 'small' when 1 then 'medium' else 'large' end as model, (o_custkey % 1000) / 1000.0::double as complexity, (o_orderkey % 101) / 100.0::double as quality from orders)"


def _outcomes(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.when(k % 3 == 0, "small").when(k % 3 == 1, "medium").otherwise("large").alias("model"), ((F.col("o_custkey") % 1000) / 1000.0).alias("complexity"), ((k % 101) / 100.0).alias("quality"))


@query(f"with {_OUT} select model, count(*) as uses, floor(avg(quality) * 1000 + 0.5) / 1000.0::double as avg_quality, floor(avg(complexity) * 1000 + 0.5) / 1000.0::double as avg_complexity from o group by 1")
def router_stats(spark, d):
    return M.router_stats(_outcomes(spark, d))


@query(f"""with {_OUT}, t as (select * from (values ('small', 0.1::double), ('medium', 0.5::double), ('large', 2.0::double)) t(model, cost)), g as (select o.model, complexity, cost, sum(quality) as s, count(*) as n from o join t on t.model = o.model group by all),
x as (select a.model, a.complexity, a.n, a.cost, b.model as m, b.cost as k, sum(b.s) / sum(b.n) as q from g a join g b on b.cost < a.cost and abs(b.complexity - a.complexity) <= 0.15::double group by all having q >= 0.5::double),
y as (select model, complexity, n, cost, min(k) as k from x group by all) select floor(coalesce(sum(n * (cost - k)), 0) * 1000 + 0.5) / 1000.0::double as savings from y""")
def potential_savings(spark, d):
    s = M.potential_savings([("small", 0.1), ("medium", 0.5), ("large", 2.0)], _outcomes(spark, d))
    return s.select((F.floor(F.col("savings") * 1000 + 0.5) / 1000.0).alias("savings"))


_SCR = " + ".join(f"max(regexp_matches(coalesce(content, ''), '[{r}]')::int)" for r in T.SCRIPTS)


@query(f"""with recursive q as ({oracle_sql()['quality_metrics']}), {ITEMS}, {_DEPS}, dd as (select node, max(d) as d from r group by 1),
p as (select i.pack_id, least(max(coalesce(d, 0)) / 10.0::double, 1) as dp, avg(case when contains(lower(kind), 'tool') then 1.0::double else 0.0::double end) as tc, greatest(least(({_SCR} - 1) / 4.0::double, 1), 0) as ml, least(avg(tokens) / 2000.0::double, 1) as al
from items i left join dd on dd.node = i.id group by 1)
select p.pack_id, diversity, density, floor(dp * 1000 + 0.5) / 1000.0::double as dependency_depth, floor(tc * 1000 + 0.5) / 1000.0::double as tool_calls, floor(ml * 1000 + 0.5) / 1000.0::double as multilinguality, floor(al * 1000 + 0.5) / 1000.0::double as average_length,
floor((diversity * 0.25::double + density * 0.2::double + dp * 0.2::double + tc * 0.15::double + ml * 0.1::double + al * 0.1::double) * 1000 + 0.5) / 1000.0::double as overall from p join q on q.pack_id = p.pack_id""")
def pack_complexity(spark, d):
    parted = Q.parted(items(spark, d, content=True).withColumn("scripts", T.script_bits(F.col("content"))), "id", "kind", "scripts", estimated=True)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("node"))
    return M.complexity(Q.analyze_parted(parted), parted, G.depth(_needs(docs), docs, enough=M.DEPTH))


@query("select event_id as id, 'memory' as kind, 5.0::double as priority, floor(pow(0.5::double, (epoch_ms(timestamp '2024-02-01') - epoch_ms(ts)) / 1000.0::double / 604800.0::double) * 1000 + 0.5) / 100.0::double as recency, floor(coalesce(case when event_id % 4 <> 0 then value / 100 end, 1) * 10000 + 0.5) / 10000.0::double as salience from events")
def memory_items(spark, d):
    return Y.bridged(_memories(spark, d), NOW, 604800.0).select("id", "kind", "priority", "recency", T.half_up(F.col("salience"), 4).alias("salience"))


@query("""with r as (select o_orderkey, o_orderkey % 100 / 100.0::double as q, case when o_orderkey % 6 <> 0 then 'large' end as alt, [o_custkey % 100 / 100.0::double, (o_custkey + 37) % 100 / 100.0::double] as t from orders)
select o_orderkey, case when q >= 0.6::double or alt is null then 'small' else alt end as final_model, case when q >= 0.6::double or alt is null then 1 when t[1] >= 0.6::double then 2 else 3 end::bigint as attempts, not (q >= 0.6::double or alt is null) as fell_back from r""")
def fallback_routes(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, d, "orders").select("o_orderkey", F.lit("small").alias("model"), F.when(k % 6 != 0, "large").alias("alternative"), (k % 100 / 100.0).alias("quality"), F.array(c % 100 / 100.0, (c + 37) % 100 / 100.0).alias("retry_qualities"))
    return M.fall_back(rows, 0.6, retries=2).select("o_orderkey", "final_model", "attempts", "fell_back")


# replay and comparison

_REPLAY = f"""{sql_greedy('items', 'pack_id', 'a')}, v as (select i.* exclude (budget), 3000::bigint as budget from items i), {sql_greedy('v', 'pack_id', 'b')}"""


def _two_packs(spark, d):
    s = items(spark, d)
    return P.greedy(s, ["pack_id"]).where("chosen"), P.greedy(s.withColumn("budget", F.lit(3000).cast("long")), ["pack_id"]).where("chosen")


@query(f"""with recursive {ITEMS}, {_REPLAY}, j as (select coalesce(a.pack_id, b.pack_id) as pack_id, a.id as x, b.id as y from (select * from a where chosen) a full outer join (select * from b where chosen) b on a.id = b.id)
select pack_id, count(case when y is null then 1 end) as only_in_a, count(case when x is null then 1 end) as only_in_b, count(case when x is not null and y is not null then 1 end) as shared from j group by 1""")
def replay_sets(spark, d):
    return S.item_diff(*_two_packs(spark, d), "pack_id", "id")


@query(f"""with recursive {ITEMS}, {_REPLAY}, x as (select pack_id, sum(tokens) as t from a where chosen group by 1), y as (select pack_id, sum(tokens) as t from b where chosen group by 1),
c as (select coalesce(p.pack_id, q.pack_id) as pack_id from (select * from a where chosen) p full outer join (select * from b where chosen) q on p.id = q.id where p.id is null or q.id is null group by 1)
select 'larger' as variant, floor(avg(coalesce(y.t, 0) - coalesce(x.t, 0)) * 100 + 0.5) / 100.0::double as avg_token_delta, floor(avg(coalesce(y.t, 0) / 3000.0::double * 100) * 100 + 0.5) / 100.0::double as avg_utilization, (select count(*) from c) as recordings_affected from x full outer join y on x.pack_id = y.pack_id""")
def replay_summary(spark, d):
    s = items(spark, d)
    return S.replay(s, s, {"larger": 3000})


@query(f"""with {ITEMS}, o as (select pack_id, avg(recency) as q from items where id % 3 <> 0 group by 1), t as (select pack_id, avg(recency) as q from items where id % 3 <> 1 group by 1),
w as (select coalesce(o.pack_id, t.pack_id) as pack_id, o.q is null or coalesce(t.q, 0) > o.q as theirs from o full outer join t on o.pack_id = t.pack_id)
select id, i.pack_id from items i join w on w.pack_id = i.pack_id where case when theirs then id % 3 <> 1 else id % 3 <> 0 end""")
def merge_best_side(spark, d):
    s = items(spark, d).select("id", "pack_id", "recency")
    a, b = s.where("id % 3 <> 0"), s.where("id % 3 <> 1")
    qa, qb = (x.groupBy("pack_id").agg(F.avg("recency").alias("overall")) for x in (a, b))
    return S.merge_best(a, b, qa, qb, "pack_id").select("id", "pack_id")


@query("select doc_id as id, 'ours' as side from documents where doc_id % 3 <> 0 and doc_id % 4 = 0 union all select doc_id, 'theirs' from documents where doc_id % 4 <> 0 and doc_id % 3 = 0")
def merge_intersection_removed(spark, d):
    i = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return S.merge_removed(i.where("id % 3 <> 0"), i.where("id % 4 <> 0"), "id")
