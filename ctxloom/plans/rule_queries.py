"""Queries of slots and constraints, variants, versions, rounds, learning and rule engines, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compiler as K
from ..operators import monitoring as M
from ..operators import packing as P
from ..operators import retrieval as R
from ..operators import rules as U
from ..operators import sets as S
from ..operators import templates as E
from .model import ITEMS, chosen_texts, decided, items, sql_greedy, table
from .queries import _DIFF, _SET, _TOK, _versions, q6, r6
from .registry import query

# packing

@query(f"""with recursive {ITEMS}, o as (select *, row_number() over (partition by pack_id order by score desc, recency desc, ord) as rn, case when tokens > 20 then tokens // 2 end as v1, case when tokens > 20 then tokens // 4 end as v2 from items),
e as (select pack_id, rn, ord, budget as left_, case when tokens <= budget then tokens when v1 <= budget then v1 when v2 <= budget then v2 end as eaten from o where rn = 1
union all select o.pack_id, o.rn, o.ord, l.left_, case when o.tokens <= l.left_ then o.tokens when o.v1 <= l.left_ then o.v1 when o.v2 <= l.left_ then o.v2 end
from (select pack_id, rn, left_ - coalesce(eaten, 0) as left_ from e) l join o on o.pack_id = l.pack_id and o.rn = l.rn + 1)
select o.pack_id, o.id, e.eaten as taken_tokens, case when e.eaten is null then 'exclude' when e.eaten < o.tokens then 'compress' else 'include' end as decision from o join e on o.pack_id = e.pack_id and o.rn = e.rn""")
def pack_variants(spark, d):
    half, quarter = F.floor(F.col("tokens") / 2), F.floor(F.col("tokens") / 4)
    s = items(spark, d).withColumn("sizes", F.when(F.col("tokens") > 20, F.array(half, quarter)))
    return P.greedy_variants(s, ["pack_id"]).select("pack_id", "id", "taken_tokens", "decision")


@query(f"""with recursive {ITEMS}, k as (select *, case kind when 'system' then 'rules' when 'memory' then 'notes' else 'rest' end as slot from items),
s0 as (select * exclude (budget), least(budget, 500)::bigint as budget from k where slot = 'rules'), {sql_greedy('s0', 'pack_id', 'a')},
l1 as (select pack_id, max(budget) - coalesce((select sum(tokens) from a where a.chosen and a.pack_id = k.pack_id), 0) as b from k group by 1),
s1 as (select k.* exclude (budget), least(b, 700)::bigint as budget from k join l1 using (pack_id) where slot = 'notes'), {sql_greedy('s1', 'pack_id', 'm')},
l2 as (select pack_id, b - coalesce((select sum(tokens) from m where m.chosen and m.pack_id = l1.pack_id), 0) as b from l1),
s2 as (select k.* exclude (budget), least(b, 1000)::bigint as budget from k join l2 using (pack_id) where slot = 'rest'), {sql_greedy('s2', 'pack_id', 'z')}
select pack_id, id, slot, chosen from a union all select pack_id, id, slot, chosen from m union all select pack_id, id, slot, chosen from z""")
def pack_slots(spark, d):
    slots = [("rules", "system", 500), ("notes", "memory", 700), ("rest", None, 1000)]
    return K.fill_slots(items(spark, d), slots).select("pack_id", "id", "slot", "chosen")


_G = f"{ITEMS}, {sql_greedy('items', 'pack_id')}, c as (select * from g where chosen)"


def _decided(spark, d, content=False):
    return P.greedy(items(spark, d, content=content), ["pack_id"])


@query(rf"""with recursive {_G} select pack_id, coalesce(kind, 'unknown') as kind, count(*) as dropped, count(*) filter (priority > 7) as high_priority_dropped,
count(*) filter (len(list_intersect(['thon', 'erer', 'zzz'], list_distinct(regexp_extract_all(lower(content), '([\p{{L}}\p{{N}}]+)', 1)))) >= 1) as relevant_dropped from g where not chosen group by 1, 2""")
def dropped_items(spark, d):
    return K.dropped_analysis(_decided(spark, d, content=True), query=["thon", "erer", "zzz"])


@query(f"""with recursive {_G} select pack_id, count(*) filter (id % 50 = 1 and not chosen) as missing_required, count(*) filter (id % 50 = 2 and chosen) as included_disallowed,
floor(coalesce(sum(tokens) filter (chosen), 0) / max(budget) * 100 + 0.5) / 100.0::double as budget_usage, count(*) filter ((id % 50 = 1 and not chosen) or (id % 50 = 2 and chosen)) = 0 as passed from g group by 1""")
def backtest_packs(spark, d):
    s = _decided(spark, d).withColumns({"required": F.col("id") % 50 == 1, "disallowed": F.col("id") % 50 == 2})
    return K.backtest(s)


@query(f"""with recursive {_G}, p as (select pack_id, max(budget) as b from items group by 1), u as (select p.pack_id, b, coalesce((select sum(tokens) from c where c.pack_id = p.pack_id), 0) / b::double as x from p)
select pack_id, 'warning' as level, null::varchar as slot, 'freshness' as "constraint", id::varchar as item_id from c where coalesce(recency, 0) < 5
union all select pack_id, 'warning', null, 'budget-utilization', null from u where x < 0.7 union all select pack_id, 'info', null, 'budget-utilization', null from u where x > 0.95
union all select pack_id, 'error', s.slot, 'coverage', null from p, (values ('rules', 'system'), ('ask', 'query'), ('tools', 'tool')) s(slot, kind) where not exists (select 1 from c where c.pack_id = p.pack_id and c.kind = s.kind)""")
def constraint_diagnostics(spark, d):
    s = _decided(spark, d)
    packs = s.groupBy("pack_id").agg(F.max("budget").alias("budget"))
    return K.diagnostics(s.where("chosen"), packs, [("rules", "system"), ("ask", "query"), ("tools", "tool")])


_NEG = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in K.NEGATIONS) + "]"


@query(rf"""with recursive {_G}, w as (select pack_id, id, list_distinct(list_filter(regexp_split_to_array(lower(content || case when id % 3 = 0 then ' not' else '' end), '\s+'), lambda x: x <> '')) as w from c),
j as (select x.pack_id, x.id as a, y.id as b, len(list_intersect(x.w, y.w)) as i, len(x.w) as n, len(y.w) as m, list_has_any(x.w, {_NEG}) as p, list_has_any(y.w, {_NEG}) as q from w x join w y on x.pack_id = y.pack_id and x.id < y.id)
select pack_id, a, b from j where i * 5 > (n + m - i) * 3 and p <> q""")
def contradictions(spark, d):
    s = chosen_texts(spark, d, decided(spark, d))
    return K.contradictions(s.withColumn("content", F.concat("content", F.when(F.col("id") % 3 == 0, " not").otherwise(""))))


_MSG = f"""{_G}, s as (select pack_id, ord, tokens, kind, content, case kind when 'system' then 'system' when 'memory' then 'system' when 'retrieval' then 'system' else 'user' end as role,
case kind when 'system' then 0 when 'memory' then 20 when 'retrieval' then 30 when 'query' then 100 else 999 end as section, case kind when 'memory' then '[Memory]' || chr(10) when 'retrieval' then '[Retrieved]' || chr(10) else '' end as prefix from c)"""


@query(f"""with recursive {_MSG} select pack_id, section, role, min(ord) as "first", md5(string_agg(prefix || content, chr(10) || chr(10) order by ord)) as content_md5, sum(tokens)::bigint as tokens
from s group by pack_id, section, role, case when section = 0 then null else ord end""")
def pack_messages(spark, d):
    m = E.to_messages(chosen_texts(spark, d, decided(spark, d)))
    return m.select("pack_id", "section", "role", "first", F.md5("content").alias("content_md5"), "tokens")


# retrieval

@query(f"""with a as (select doc_id as id, unnest(list_distinct(t)) as w, len(list_distinct(t)) as n from (select doc_id, {_TOK.format('text')} as t from documents)),
b as (select item_id as ctx, unnest(list_distinct(t)) as w, len(list_distinct(t)) as m from (select item_id, {_TOK.format('text')} as t from benchmark)),
j as (select id, ctx, count(*) / (any_value(n) + any_value(m) - count(*))::double as j from a join b on a.w = b.w group by 1, 2), x as (select id, max(j) as j from j group by 1)
select doc_id as id, {r6('1 - coalesce(j, 0)')} as novelty, {r6('(1 - coalesce(j, 0)) * 0.6::double')} as gain from documents left join x on doc_id = id""")
def information_gain(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array_distinct(T.tokens(F.col("text"))).alias("words"))
    known = table(spark, d, "benchmark").select(F.col("item_id").alias("ctx"), F.array_distinct(T.tokens(F.col("text"))).alias("words"))
    return R.information_gain(docs, known).select("id", q6(F.col("novelty")).alias("novelty"), q6(F.col("gain")).alias("gain"))


@query(rf"""with w as (select conv_id, turn // 4 as round, turn, {_SET.format('text')} as s from conversations),
j as (select a.conv_id, a.round, len(list_intersect(a.s, b.s)) as i, len(a.s) + len(b.s) as m from w a join w b on a.conv_id = b.conv_id and a.round = b.round and a.turn < b.turn),
v as (select conv_id, round, avg(case when m - i = 0 then 1.0::double else i / (m - i)::double end) as c from j group by 1, 2)
select g.conv_id, g.round, {r6('coalesce(c, 1)')} as convergence from (select distinct conv_id, round from w) g left join v on v.conv_id = g.conv_id and v.round = g.round""")
def council_convergence(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", F.floor(F.col("turn") / 4).cast("long").alias("round"), T.word_set(F.col("text")).alias("words"))
    return R.convergence(turns, ["conv_id", "round"]).select("conv_id", "round", q6(F.col("convergence")).alias("convergence"))


# versions

@query(f"with {_DIFF} select count(*) filter (b.id is null) as only_in_1, count(*) filter (a.id is null) as only_in_2, count(*) filter (a.tokens = b.tokens and a.content = b.content) as common, count(*) filter (a.tokens <> b.tokens or a.content <> b.content) as modified from a full outer join b on a.id = b.id")
def compare_versions(spark, d):
    return S.compare(*_versions(spark, d), "id", ["content", "tokens"], "ord")


@query("""with s as (select o_custkey as timeline, o_orderkey as id, o_orderdate as created, o_orderkey = max(o_orderkey) over (partition by o_custkey) or o_orderkey % 8 = 0 as p from orders),
x as (select *, count(*) filter (p) over (partition by timeline) as n, row_number() over (partition by timeline, p order by created desc, id desc) as k from s)
select timeline, id from x where p or k <= 5 - n""")
def prune_snapshots(spark, d):
    s = table(spark, d, "orders").select(F.col("o_custkey").alias("timeline"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created"))
    heads = s.groupBy("timeline").agg(F.max("id").alias("id")).unionByName(s.where("id % 8 = 0").select("timeline", "id"))
    return S.prune(s, heads, 5).select("timeline", "id")


@query("select user_id, min_by(case when event_id % 2 = 0 then upper(event_type) else event_type end, event_id) as name, min(event_id) as first_id from events group by user_id, lower(event_type)")
def unique_event_types(spark, d):
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("name"), F.col("event_id").alias("first_id"))
    return S.unique_ignoring_case(e, "user_id", "name", "first_id").select("user_id", "name", "first_id")


# learning and routing

@query(f"""with f as (select user_id as record_id, event_type as kind, bool_or(event_id % 3 = 0) as sel, user_id % 10 / 10.0::double as q from events group by 1, 2, 4),
r as (select count(distinct record_id) as n from f), t as (select sum(q) as s from (select distinct record_id, q from f)),
k as (select kind, count(*) filter (sel) as c, coalesce(sum(q) filter (sel), 0) as t from f group by 1),
z as (select kind, n, case when c > 0 then k.t / c else 0.0::double end as i, case when n > c then (s - k.t) / (n - c) else 0.0::double end as e from k, r, t)
select kind, n as "count", {r6('i')} as included, {r6('e')} as excluded, {r6('i - e')} as lift from z""")
def kind_insights(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("record_id"), F.col("event_type").alias("kind"), (F.col("event_id") % 3 == 0).alias("selected"), (F.col("user_id") % 10 / 10.0).alias("quality"))
    return M.kind_insights(e).select("kind", "count", *[q6(F.col(c)).alias(c) for c in ("included", "excluded", "lift")])


@query("""with o as (select case o_orderkey % 3 when 0 then 'small' when 1 then 'middle' else 'large' end as model, (o_custkey % 1000) / 1000.0::double as complexity, (o_orderkey * 7 % 90) / 100.0::double as quality from orders),
n as (select model, count(*) as n from o group by 1), q as (select distinct model, complexity from o),
v as (select q.model, q.complexity, avg(o.quality) as a from q join o on o.model = q.model and abs(o.complexity - q.complexity) <= 0.15::double group by 1, 2)
select p.o_orderkey as request_id, v.model, case when n >= 20 and floor(a * 1000000 + 0.5) / 1000000 < 0.5 then case v.model when 'small' then 'middle' else 'large' end else v.model end as routed
from orders p join v on v.model = case p.o_orderkey % 3 when 0 then 'small' when 1 then 'middle' else 'large' end and v.complexity = (p.o_custkey % 1000) / 1000.0::double join n on n.model = v.model""")
def promote_models(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(
        k.alias("request_id"), F.when(k % 3 == 0, "small").when(k % 3 == 1, "middle").otherwise("large").alias("model"), (F.col("o_custkey") % 1000 / 1000.0).alias("complexity"), (k * 7 % 90 / 100.0).alias("quality")
    )
    tiers = spark.createDataFrame([("small", 1.0), ("middle", 2.0), ("large", 3.0)], "model string, cost double")
    return M.promote(tiers, o, o.drop("quality"))


# rule engines

_SEV = " + ".join(f"case when contains(t, '{w}') then {x}::double else 0.0::double end" for w, x in U.SEVERITY.items())


@query(f"""with c as (select doc_id, lower(text) || case when doc_id % 5 = 0 then ' fatal flood injury' else '' end as t, case doc_id % 3 when 0 then 'Active' when 1 then 'lapsed' end as ps, (doc_id * 37 % 100) / 100.0::double as fraud, doc_id % 50 * 100000 as lim from documents),
s as (select *, least(1.0::double, 0.25::double + {_SEV} + case when contains(t, 'claim-' || doc_id) then 0.05::double else 0.0::double end) as sev, coalesce(ps = 'Active', false) as cov from c)
select 'CLAIM-' || doc_id as claim_id, case when not cov then 'manual_review' when fraud >= 0.85::double then 'hold' when fraud >= 0.55::double then 'manual_review' when sev >= 0.65::double then 'advance' else 'manual_review' end as action,
least(floor(150000 * (1.0::double + sev))::bigint, greatest(150000, lim // 5))::bigint as advance_cents, {r6('sev * case when cov then 1.0::double else 0.35::double end * (1.0::double - fraud)')} as priority from s""")
def claim_decisions(spark, d):
    i = F.col("doc_id")
    c = table(spark, d, "documents").select(
        F.concat(F.lit("CLAIM-"), i.cast("string")).alias("claim_id"), F.concat("text", F.when(i % 5 == 0, " fatal flood injury").otherwise("")).alias("text"),
        F.when(i % 3 == 0, "Active").when(i % 3 == 1, "lapsed").alias("policy_status"), (i * 37 % 100 / 100.0).alias("fraud"), (i % 50 * 100000).alias("limit_cents"),
    )
    return U.assess_claims(c).select("claim_id", "action", "advance_cents", q6(F.col("priority")).alias("priority"))


_CC = U.CONTACT_CENTRE


@query(f"""with t as (select o_orderkey as k, (o_orderkey * 13 % 100) / 100.0::double as churn, (o_orderkey * 29 % 100) / 100.0::double as compliance, (o_custkey % 100) / 100.0::double as fraud, o_custkey % 7 / 7.0::double as low_value,
o_orderkey % 60 as w, o_orderkey % 4 as r, o_orderkey % 9 = 0 as severe, o_custkey % 11 = 0 as vip, o_custkey % 13 = 0 as na, o_custkey % 97 = 0 as sup from orders),
x as (select *, floor(least(1.0::double, churn * 0.22::double + compliance * 0.21::double + fraud * 0.12::double + low_value * 0.08::double + w / 60.0::double * 0.12::double + r / 4.0::double * 0.08::double + case when severe then 0.1::double else 0.0::double end
+ case when vip then 0.06::double else 0.0::double end + case when na then 0.1::double else 0.0::double end + case when sup then 0.08::double else 0.0::double end) * 1000000 + 0.5) / 1000000.0::double as risk from t)
select k as ticket_id, risk, case when risk >= 0.82 or sup or (severe and compliance >= 0.6) then 'immediate_supervisor_intervention' when risk >= 0.56 or na or w >= 45 or r >= 3 then 'supervised_autopilot_resolution' when risk >= 0.32 then 'autopilot_resolution' else 'monitor' end as route from x""")
def contact_decisions(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = table(spark, d, "orders").select(
        k.alias("ticket_id"), (k * 13 % 100 / 100.0).alias("churn"), (k * 29 % 100 / 100.0).alias("compliance"), (c % 100 / 100.0).alias("fraud"), (c % 7 / 7.0).alias("low_value"),
        (k % 60 / 60.0).alias("wait"), (k % 4 / 4.0).alias("recontact"), F.lit(None).cast("double").alias("csat"), F.lit(None).cast("double").alias("hint"), (k % 60).alias("wait_minutes"), (k % 4).alias("recontacts"),
        (k % 9 == 0).alias("severe"), (c % 11 == 0).alias("vip"), (c % 13 == 0).alias("no_autopilot"), (c % 97 == 0).alias("supervisor"),
    )
    return _CC.decide(t).select("ticket_id", q6(F.col("risk")).alias("risk"), "route")


@query("""with u as (select c_custkey as incident_id, 'user-' || c_custkey as target, c_custkey % 4 = 0 as hot from customer), v as (select incident_id, 'uid_' || c_nationkey || 'x' as target, hot from u join customer on c_custkey = incident_id)
select incident_id, 'iam_suspend_user' as tool, target, incident_id || ':iam_suspend_user:' || target as "key" from (select * from u union all select * from v) where hot and not (target like 'user-%' and incident_id % 8 = 0)""")
def incident_containment(spark, d):
    k = F.col("c_custkey")
    s = table(spark, d, "customer").select(
        k.alias("incident_id"), F.concat(F.lit("from 10.0.0.7 by user-"), k.cast("string"), F.lit(" and UID_"), F.col("c_nationkey").cast("string"), F.lit("x"), F.when(k % 4 == 0, " ransomware found").otherwise(" quiet")).alias("text")
    )
    done = s.where("incident_id % 8 = 0").select(F.concat(F.col("incident_id").cast("string"), F.lit(":iam_suspend_user:user-"), F.col("incident_id").cast("string")).alias("key"))
    return U.containment(U.indicators(s), done)
