"""Queries of conversations, retrieval flows, compiler passes, task records and measures, each beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compiler as K
from ..operators import conversations as C
from ..operators import issues as B
from ..operators import packing as P
from ..operators import quality as Q
from ..operators import retrieval as R
from ..operators import templates as E
from ..operators.scratch import only, stored
from .model import ITEMS, NOW, chosen_texts, decided, items, sql_greedy, sql_tokens, table
from .queries import _TOK, _VEC, q6, r6
from .registry import query

_G = f"{ITEMS}, {sql_greedy('items', 'pack_id')}"
_T = f"t as (select conv_id, turn, role, text, {sql_tokens('text')} as tokens from conversations)"


def _turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text", T.estimate_tokens(F.col("text")).alias("tokens"))


# conversations

@query(f"""with recursive {_T}, x as (select *, turn * 60 as ts, case turn % 3 when 0 then 'open' when 1 then 'closed' end as st, turn % 5 = 1 as outc, row_number() over (partition by conv_id order by turn desc) <= 2 as preserved from t),
u as (select conv_id, 400 - coalesce(sum(tokens) filter (preserved), 0) as left_ from x group by 1), o0 as (select *, min(ts) over w as lo, max(ts) over w - min(ts) over w as sp from x where not preserved window w as (partition by conv_id)),
o as (select o0.conv_id, turn, turn as ord, tokens, left_::bigint as budget, (5.0::double + case when sp > 0 then (ts - lo) / sp::double * 10 else 5.0::double end * 0.7::double)
* case when turn % 6 = 0 then 2.0::double when outc then 1.5::double when st = 'open' then 1.2::double when st = 'closed' then 0.1::double else 1.0::double end as score, 0 as recency from o0 join u on u.conv_id = o0.conv_id), {sql_greedy('o', 'conv_id')}
select x.conv_id, x.turn, x.preserved, x.preserved or coalesce(g.chosen, false) as kept from x left join g on g.conv_id = x.conv_id and g.turn = x.turn""")
def compact_causal(spark, d):
    n = F.col("turn")
    t = _turns(spark, d).withColumns({"ts": n * 60, "issue_status": F.when(n % 3 == 0, "open").when(n % 3 == 1, "closed"), "issue_active": n % 6 == 0, "is_outcome": n % 5 == 1})
    return C.causal_compact(t, 400).select("conv_id", "turn", "preserved", "kept")


@query(rf"""with {_T}, x as (select *, row_number() over (partition by conv_id order by turn desc) <= 2 as preserved from t),
u as (select conv_id, coalesce(sum(tokens) filter (preserved), 0) as used, count(*) filter (not preserved) as n, string_agg('[' || role || ']: ' || coalesce(text, ''), chr(10) order by turn) filter (not preserved) as a from x group by 1 having count(*) filter (not preserved) >= 3),
h as (select *, '[Summary of ' || n || ' earlier turns]' || chr(10) as head, greatest(floor((400 - used) * 0.3::double)::bigint - {sql_tokens("'[Summary of ' || n || ' earlier turns]'")}, 0) as room, regexp_split_to_array(a, '\s+') as w from u),
k as (select *, (select max(i) from range(0, len(w) + 1) r(i) where ceil(i * 1.3::double) <= room) as m from h)
select conv_id, n as turns, head || case when {sql_tokens('a')} <= room then a else array_to_string(w[1:m], ' ') end as content from k""")
def truncation_summaries(spark, d):
    return C.truncation_summaries(_turns(spark, d), 400, after=3).select("conv_id", "turns", "content")


@query(f"""with {_T}, x as (select *, row_number() over (partition by conv_id order by turn desc) <= 2 as preserved from t), o as (select *, (row_number() over (partition by conv_id order by turn) - 1) // 2 as batch from x where not preserved)
select conv_id, batch, count(*) as turns, left(string_agg('[' || role || ']: ' || coalesce(text, ''), chr(10) order by turn), 40) as summary from o group by 1, 2""")
def batch_summaries(spark, d):
    made = C.summarized(C.batches(_turns(spark, d), size=2), lambda t: F.substring(t, 1, 40))
    return made.select("conv_id", "batch", "turns", "summary")


@query(rf"""with {_T}, x as (select *, count(*) over (partition by conv_id) as n, row_number() over (partition by conv_id order by turn desc) as b from t), o as (select *, regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') as c from x where n > 4 and b > 2),
l as (select conv_id, turn, n, '- ' || case when role in ('user', 'assistant') then role else 'note' end || ': ' || case when length(c) > 140 then regexp_replace(left(c, 137), '\s+$', '') || '...' else c end as line from o),
s as (select conv_id, max(n) - 2 as folded, 'Conversation highlights:' || chr(10) || string_agg(line, chr(10) order by turn) as a from l group by 1), u as (select *, regexp_replace(a, '^\s+|\s+$', '', 'g') as b from s)
select conv_id, folded, case when ceil(length(b) / 4.0::double) <= 60 then a else regexp_replace(left(b, 237), '\s+$', '') || '...' end as summary from u""")
def rolling_summaries(spark, d):
    return C.rolling_summaries(_turns(spark, d), trigger=4, keep=2, tokens=60)


def _intercepted(spark, d):
    return C.intercept(_turns(spark, d), 300)


_INT = f"""{_T}, m as (select *, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as n, sum(tokens) over (partition by conv_id) as total from t),
p as (select conv_id, turn, role, text, total, turn as ord, tokens, 300::bigint as budget, case when n > 1 then i::double / (n - 1) else 1.0::double end as recency,
case when role = 'system' then 100.0::double when i >= n - 2 then 90.0::double else greatest(10.0::double, floor(50 - i::double / greatest(n - 2, 1) * 40 + 0.5)) end as pr from m), s as (select *, pr + recency * 0.7::double as score from p), {sql_greedy('s', 'conv_id')},
k as (select conv_id, turn, role, text, chosen or total <= 300 as kept from g)"""


@query(f"with recursive {_INT} select conv_id, turn, kept from k")
def intercepted_messages(spark, d):
    return _intercepted(spark, d).select("conv_id", "turn", "kept")


@query(f"""with recursive {_INT}, z as (select conv_id, count(*) as dropped, 'Earlier conversation (' || count(*) || ' messages, summarized):' || chr(10)
|| string_agg('- [' || role || ']: ' || case when length(coalesce(text, '')) > 120 then left(text, 120) || '...' else coalesce(text, '') end, chr(10) order by turn) as summary from k where not kept group by 1),
f as (select k.conv_id, min(turn) as turn from k where kept and role <> 'system' group by 1), r as (select f.conv_id, f.turn, 0 as o, 'system' as role, '[Context summary of ' || dropped || ' earlier messages]: ' || summary as text from f join z on z.conv_id = f.conv_id
union all select conv_id, turn, 1, role, text from k where kept) select conv_id, row_number() over (partition by conv_id order by turn, o)::int - 1 as position, role, text from r""")
def reassembled_messages(spark, d):
    t = _intercepted(spark, d)
    return C.reassembled(t, C.digests(t))


@query(f"with recursive {ITEMS}, sm as (select * exclude (budget), 90::bigint as budget from items), {sql_greedy('sm', 'pack_id')} select pack_id, coalesce(max(priority) filter (chosen), 0)::double as best, 'I abstain: insufficient evidence to answer.' as message from g group by 1 having coalesce(max(priority) filter (chosen), 0) < 9")
def abstentions(spark, d):
    p = P.greedy(items(spark, d).withColumn("budget", F.lit(90).cast("long")), ["pack_id"])
    return C.abstentions(p.where("chosen"), p.select("pack_id").distinct(), least=9.0)


@query(f"with recursive {_G} select 'a1' as source_agent, pack_id, budget, ord, id, tokens from g where chosen")
def handoff_items(spark, d):
    made = C.handoffs(P.greedy(items(spark, d), ["pack_id"]), "a1", "a2")
    return C.import_handoffs(made).withColumn("source_agent", F.lit("a1")).select("source_agent", "pack_id", "budget", "ord", "id", "tokens")


_MSG = f"""s(kind, role, o, m, prefix) as (values {', '.join(f"('{k}', '{r}', {o}, {m}, '{p.strip()}' || case when '{p.strip()}' <> '' then chr(10) else '' end)" for k, r, o, m, p in E.SECTIONS)}),
z as (select g.pack_id, coalesce(o, 999) as section, coalesce(role, 'user') as role, case when not coalesce(m, false) then ord end as own, ord, tokens, coalesce(prefix, '') || coalesce(content, '') as content from g left join s on s.kind = g.kind where chosen),
y as (select pack_id, section, role, min(ord) as first, string_agg(content, chr(10) || chr(10) order by ord) as content, sum(tokens)::bigint as tokens from z group by pack_id, section, role, own)"""


def _messages(spark, d):
    return E.to_messages(chosen_texts(spark, d, decided(spark, d)))


@query(f"with recursive {_G}, {_MSG} select pack_id, coalesce(string_agg(content, chr(10) || chr(10) order by section, first) filter (role = 'system'), '') as system, count(*) filter (role <> 'system')::int as turns, coalesce(string_agg(role || ': ' || content, chr(10) order by section, first) filter (role <> 'system'), '') as said from y group by 1")
def system_messages(spark, d):
    m = E.system_and_turns(_messages(spark, d))
    return m.select("pack_id", "system", F.size("messages").alias("turns"), F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n").alias("said"))


@query(f"with recursive {_G}, {_MSG} select pack_id, sum(tokens)::bigint as total_tokens, coalesce(sum(tokens) filter (role = 'system'), 0)::bigint as system_tokens, coalesce(sum(tokens) filter (role = 'user'), 0)::bigint as user_tokens, coalesce(sum(tokens) filter (role = 'assistant'), 0)::bigint as assistant_tokens from y group by 1")
def message_tokens(spark, d):
    return E.role_tokens(_messages(spark, d))


@query(f"""with recursive {_G}, {_MSG}, c as (select 'src' || (conv_id % 20) as pack_id, turn + 1000 * conv_id as t, case when role = 'tool' then 'user' else role end as role, coalesce(text, '') as content from conversations),
u as (select pack_id, 0 as p, 0 as s, t as f, role, content from c union all select pack_id, 1, section, first, role, content from y) select pack_id, row_number() over (partition by pack_id order by p, s, f)::int - 1 as position, role, content from u""")
def compiled_messages(spark, d):
    t = table(spark, d, "conversations")
    said = t.select(F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("pack_id"), (F.col("turn") + 1000 * F.col("conv_id")).alias("turn"), "role", "text")
    return E.with_turns(said, _messages(spark, d))


@query(f"with {_T} select conv_id, sum(tokens)::bigint as total_tokens, greatest(300 - sum(tokens), 0)::bigint as remaining from t group by 1")
def budget_usage(spark, d):
    return Q.conversation_usage(_turns(spark, d), 300).select("conv_id", "total_tokens", F.col("remaining").cast("long").alias("remaining"))


_SPACED = r"list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: x <> '')"


@query(f"""with t as (select doc_id, {_SPACED.format('text')} as t from documents), sz as (select doc_id, len(t) as n from t), st as (select count(*) as nd, avg(n) as av from sz), q as (select item_id as query_id, unnest({_SPACED.format('text')}) as term from benchmark),
qt as (select query_id, term, count(*) as times from q group by 1, 2), tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from t) where term in (select term from qt) group by 1, 2), df as (select term, count(*) as df from tf group by 1),
bm as (select qt.query_id, tf.doc_id, sum(times * ln((nd - df + 0.5::double) / (df + 0.5::double) + 1) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * n / av))) as score from tf join df on tf.term = df.term join sz on tf.doc_id = sz.doc_id cross join st join qt on qt.term = tf.term group by 1, 2)
select query_id, doc_id, {r6('score')} as score from bm qualify row_number() over (partition by query_id order by floor(score * 1000000 + 0.5) desc, doc_id) <= 5""")
def bm25_spaced(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25_top(table(spark, d, "documents"), asked, 5, k1=1.5, tokenize=R.spaced).select("query_id", "doc_id", "score")


# retrieval

_CTX = f"""cx as (select doc_id, list_distinct({_TOK.format('text')}) as w from documents where doc_id % 50 = 0), dw as (select doc_id as id, list_distinct({_TOK.format('text')}) as w, {sql_tokens('text')} as tokens from documents),
nv as (select dw.id, greatest(0, 1 - max(len(list_intersect(dw.w, cx.w)) / nullif(len(dw.w) + len(cx.w) - len(list_intersect(dw.w, cx.w)), 0)::double)) as novelty from dw, cx group by 1)"""


def _candidates(spark, d, k):
    """The k documents next to each vector of the query set, with their tokens; the words of these documents; the context.

    Texts are read for words and tokens once, and only those of a candidate or of the context.
    """
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = stored(R.vector_top(v, asked, k).select("query_id", F.col("vec_id").alias("id"), "rank"))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    wanted = stored(near.select("id").union(texts.where("id % 50 = 0").select("id")).distinct())
    found = only(texts, wanted, ["id"], "left_semi")
    docs = stored(found.select("id", F.array_distinct(T.tokens(F.col("text"))).alias("words"), T.estimate_tokens(F.col("text")).alias("tokens")))
    sets = docs.select("id", "words").join(near.select("id").distinct(), "id", "left_semi")
    return near.join(docs.select("id", "tokens"), "id"), stored(sets.distinct()), docs.where("id % 50 = 0").select(F.col("id").alias("ctx"), "words")


@query(f"""with recursive {_VEC.replace('rank <= 10', 'rank <= 10')}, {_CTX}, o as (select top.query_id, dw.id, rank, tokens, rank as ord, 1500::bigint as budget, 0 as recency, novelty * 0.6::double + 0.5::double * 0.4::double as score from top join dw on dw.id = top.vec_id join nv on nv.id = dw.id
where novelty * 0.6::double + 0.5::double * 0.4::double >= 0.65::double), {sql_greedy('o', 'query_id')} select query_id, id, {r6('score')} as gain from g where chosen""")
def retrieve_by_gain(spark, d):
    candidates, sets, context = _candidates(spark, d, 10)
    return R.retrieve(candidates, context, 1500, least=0.65, sets=sets).select("query_id", "id", q6(F.col("gain")).alias("gain"))


# compiler

@query(rf"""with recursive {_G}, x as (select pack_id, id, list_distinct(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda y: length(y) > 2)) as w from g where chosen),
p as (select a.pack_id, a.id as a, b.id as b, len(list_intersect(a.w, b.w)) as i, len(a.w) as m, len(b.w) as n from x a join x b on a.pack_id = b.pack_id and a.id < b.id) select pack_id, a, b from p where i > 0 and i * 12 > (m + n - i)""")
def redundant_pairs(spark, d):
    return K.redundant_pairs(chosen_texts(spark, d, decided(spark, d)), 1, 12)


@query(f"with {ITEMS} select pack_id, id from items where case kind when 'memory' then recency >= 3 when 'system' then recency >= 7 else true end")
def stale_pruned(spark, d):
    return K.prune_stale(items(spark, d), {"memory": 3.0, "system": 7.0}).select("pack_id", "id")


@query(f"""with {ITEMS}, z as (select *, case kind when 'system' then 0 when 'query' then 2 else 1 end as z from items), k as (select *, row_number() over (partition by pack_id, z order by priority desc, ord) as k, count(*) over (partition by pack_id, z) as n from z),
m as (select *, case z when 1 then case when k <= ceil(n / 2.0::double) then k else ceil(n / 2.0::double) + 1 + n - k end when 0 then id else 0 end as m from k) select pack_id, id, row_number() over (partition by pack_id order by z, m, ord) - 1 as position from m""")
def place_positioned(spark, d):
    return K.positioned(items(spark, d), {"system": "first", "query": "last"}, "claude", prefix=True).select("pack_id", "id", "position")


# task records

_ISSUE = f"""i as (select 'item-' || id as id, id::varchar as title, case when chosen then 'open' else 'deferred' end as status, greatest(0, least(4, 4 - floor(priority / 10 * 4)))::int as priority, 'context' as issue_type from g)"""


@query(f"with recursive {_G}, {_ISSUE} select * from i union all select 'handoff-h1', 'Handoff', 'pinned', 0, 'message'")
def handoff_issues(spark, d):
    made = B.create_handoff(P.greedy(items(spark, d, content=True), ["pack_id"]), NOW, "h1")
    return made.select("id", "title", "status", "priority", "issue_type")


@query(f"""with recursive {_G}, r as (select id::varchar as id, coalesce(kind, '') as kind, priority, tokens, case when chosen then 'item' else 'deferred' end as part from g) select * from r""")
def picked_up_items(spark, d):
    rows = B.pickup(B.create_handoff(P.greedy(items(spark, d, content=True), ["pack_id"]), NOW, "h1"))
    back = [B.to_items(rows.where(F.col("part") == p)).withColumn("part", F.lit(p)) for p in ("item", "deferred")]
    return back[0].unionByName(back[1]).select("id", F.coalesce("kind", F.lit("")).alias("kind"), "priority", "tokens", "part")


@query("""with a as (select p_partkey as id, p_partkey as ord, p_size as size from part where p_partkey % 3 <> 0), b as (select p_partkey as id, -p_partkey as ord, p_size + 1 as size from part where p_partkey % 2 = 0)
select coalesce(b.id, a.id) as id, coalesce(b.size, a.size) as size, coalesce(a.ord, b.ord) as ord, a.id is null as added from a full outer join b on a.id = b.id""")
def merged_issues(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), F.col("p_size").alias("size"))
    updates = p.where("id % 2 = 0").select("id", (-F.col("ord")).alias("ord"), (F.col("size") + 1).alias("size"))
    return B.merge_issues(p.where("id % 3 <> 0"), updates).select("id", "size", "ord", "added")


# measures

_ALLOC = "select pack_id, coalesce(sum(tokens) filter (chosen), 0)::double as t, coalesce(sum(tokens) filter (chosen and kind = 'system'), 0)::double as a, coalesce(sum(tokens) filter (chosen and kind = 'memory'), 0)::double as b, coalesce(sum(tokens) filter (chosen and kind = 'query'), 0)::double as c from g group by 1"


@query(f"""with recursive {_G}, u as ({_ALLOC}) select pack_id, floor(case when t > 0 then (1 - least(abs(a / t - 0.2::double) / 0.2::double, 1) + 1 - least(abs(b / t - 0.3::double) / 0.3::double, 1) + case when c = 0 then 1 else 0 end) / 3.0::double else 0 end * 1000 + 0.5) / 1000.0::double as efficiency from u""")
def allocation_efficiency(spark, d):
    return Q.allocation_efficiency(P.greedy(items(spark, d), ["pack_id"]), [("system", 0.2), ("memory", 0.3), ("query", 0.0)])


@query("select count(*) as total, count(*) filter (o_orderkey % 4 < 2) as executed, count(*) filter (o_orderkey % 4 = 2) as skipped, count(*) filter (o_orderkey % 4 = 3) as failed from orders")
def run_stats(spark, d):
    k = F.col("o_orderkey") % 4
    return Q.run_stats(table(spark, d, "orders").select(F.when(k < 2, "executed").when(k == 2, "skipped").otherwise("failed").alias("status")))


@query(f"with {_T} select conv_id as council, coalesce(role, 'all') as member, sum(tokens)::bigint as tokens from t group by grouping sets ((conv_id, role), (conv_id))")
def council_tokens(spark, d):
    c = Q.council_tokens(_turns(spark, d).select(F.col("conv_id").alias("council"), F.col("role").alias("member"), "tokens"))
    return c.select("council", F.coalesce("member", F.lit("all")).alias("member"), "tokens")


@query(f"""with recursive {_G}, q as (select pack_id, floor(avg(case when recency > 5 then 1.0::double else 0.0::double end) * 1000 + 0.5) / 1000.0::double as freshness, least(sum(tokens) / max(budget)::double, 1) as u from g where chosen group by 1),
h as (select pack_id, count(*) filter (priority > 7) as h from g where not chosen group by 1), r as (select q.pack_id, unnest(list_filter([case when freshness < 0.2::double then 'stale-context' end, case when u < 0.5::double then 'budget-waste' end, case when u > 0.95::double then 'budget-waste' end,
case when coalesce(h, 0) > 0 then 'wrong-priorities' end], lambda x: x is not null)) as issue, coalesce(h, 0) as h, freshness from q left join h on h.pack_id = q.pack_id)
select pack_id, issue, case issue when 'wrong-priorities' then 'critical' when 'budget-waste' then 'info' else 'warning' end as severity, case when h > 0 then 'critical' when freshness < 0.2::double then 'warning' else 'good' end as health from r""")
def diagnoses(spark, d):
    """Of the issues those that do not rest on word sets; quality_metrics covers these."""
    g = decided(spark, d)
    o = Q.observe(chosen_texts(spark, d, g), NOW).withColumns({"redundancy": F.lit(0.0), "diversity": F.lit(1.0)})
    h = K.dropped_analysis(g).groupBy("pack_id").agg(F.sum("high_priority_dropped").alias("high_priority_dropped"), F.sum("relevant_dropped").alias("relevant_dropped"))
    return Q.diagnose(o.join(h, "pack_id", "left"))


@query()
def quality_gate(spark, d):
    """The chosen items that are left once each pack's overall quality reaches 0.7."""
    return Q.gate(chosen_texts(spark, d, decided(spark, d)), 0.7).where("kept").select("pack_id", "id")
