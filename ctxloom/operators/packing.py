"""Budgeted selection: greedy with skip, per kind, by cache volatility, and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def score(priority=1.0, recency=0.7, salience=0.5) -> Column:
    """Weighted sum of the item's priority, recency and salience; nulls count 0; a given score stays."""
    zero = F.lit(0.0)
    return (
        F.coalesce(F.col("priority"), zero) * float(priority)
        + F.coalesce(F.col("recency"), zero) * float(recency)
        + F.coalesce(F.col("salience"), zero) * float(salience)
    )


def weighted_score() -> Column:
    """The score with cost and latency penalties and a bonus for items that supersede another."""
    return score() + F.coalesce("cost", F.lit(0.0)) * -0.3 + F.coalesce("latency", F.lit(0.0)) * -0.2 + F.when(F.col("supersedes").isNotNull(), 5.0).otherwise(0.0)


def causal_score(base: Column) -> Column:
    """Base times a factor: the active task's 2, another task's outcome 1.5, open tasks 1.2, closed ones 0.1, else pinned 2, else 1."""
    return base * (
        F.when(F.col("issue_active"), 2.0)
        .when(F.col("is_outcome"), 1.5)
        .when(F.col("issue_status").isin("open", "in_progress"), 1.2)
        .when(F.col("issue_status") == "closed", 0.1)
        .when(F.col("pinned"), 2.0)
        .otherwise(1.0)
    )


def greedy(items: DataFrame, group: list[str]) -> DataFrame:
    """items(*group, budget, ord, tokens, score, recency) with `chosen`.

    Items are offered by score, recency (both descending) and ord; one is taken if it fits what
    is left. Of items of one size only the first floor(budget / size) can be taken, and once
    one does not fit no later one does; so per group at most budget * ln(budget) candidates
    reach the fold, however many rows the group has. Texts never move: the fold sees keys only.
    """
    order = (F.col("score").desc(), F.col("recency").desc(), F.col("ord"))
    sized = items.where(F.col("tokens").between(1, F.col("budget"))).select(*group, "budget", "ord", "tokens", "score", "recency")
    nth = F.row_number().over(W.partitionBy(*group, "tokens").orderBy(*order))
    few = sized.withColumn("_n", nth).where(F.col("_n") <= F.floor(F.col("budget") / F.col("tokens")))
    rows = few.groupBy(*group).agg(
        F.max("budget").cast("long").alias("_b"),
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), (-F.col("recency")).alias("r"), F.col("ord").alias("o"), F.col("tokens").cast("long").alias("t")))).alias("_r"),
    )
    start = F.struct(F.col("_b").alias("left"), F.slice(F.transform("_r", lambda x: x["o"]), 1, 0).alias("taken"))
    folded = F.aggregate(
        "_r",
        start,
        lambda acc, x: F.when(
            x["t"] <= acc["left"], F.struct((acc["left"] - x["t"]).alias("left"), F.concat(acc["taken"], F.array(x["o"])).alias("taken"))
        ).otherwise(acc),
    )
    taken = rows.select(*group, F.explode(folded["taken"]).alias("ord")).withColumn("_taken", F.lit(True))
    joined = items.join(taken, [*group, "ord"], "left")
    fits_always = (F.col("tokens") <= 0) & (F.col("budget") >= 0)
    return joined.withColumn("chosen", F.coalesce("_taken", F.lit(False)) | fits_always).drop("_taken")


def greedy_variants(items: DataFrame, group: list[str]) -> DataFrame:
    """items(*group, budget, ord, tokens, sizes, score, recency) with `decision` and `taken_tokens`.

    Offered as in greedy(); an item that is too large is taken in its largest variant that fits
    (`sizes`, token counts; null or empty: none; variants without tokens are ignored). An item
    is taken in some form if its smallest form fits, so the bound of greedy() holds on that.
    """
    order = (F.col("score").desc(), F.col("recency").desc(), F.col("ord"))
    sizes = F.filter(F.coalesce(F.col("sizes").cast("array<long>"), F.array().cast("array<long>")), lambda x: x > 0)
    sized = items.where("tokens > 0").select(*group, "budget", "ord", "tokens", "score", "recency", sizes.alias("_v"))
    sized = sized.withColumn("_m", F.least(F.col("tokens"), F.array_min("_v"))).where(F.col("_m") <= F.col("budget"))
    nth = F.row_number().over(W.partitionBy(*group, "_m").orderBy(*order))
    few = sized.withColumn("_n", nth).where(F.col("_n") <= F.floor(F.col("budget") / F.col("_m")))
    one = F.struct((-F.col("score")).alias("s"), (-F.col("recency")).alias("r"), F.col("ord").alias("o"), F.col("tokens").cast("long").alias("t"), F.col("_v").alias("v"))
    rows = few.groupBy(*group).agg(F.max("budget").cast("long").alias("_b"), F.array_sort(F.collect_list(one)).alias("_r"))
    start = F.struct(F.col("_b").alias("left"), F.slice(F.transform("_r", lambda x: F.struct(x["o"].alias("o"), x["t"].alias("e"))), 1, 0).alias("taken"))

    def step(acc, x):
        eaten = F.when(x["t"] <= acc["left"], x["t"]).otherwise(F.array_max(F.filter(x["v"], lambda v: v <= acc["left"])))
        grown = F.struct((acc["left"] - eaten).alias("left"), F.concat(acc["taken"], F.array(F.struct(x["o"].alias("o"), eaten.alias("e")))).alias("taken"))
        return F.when(eaten.isNotNull(), grown).otherwise(acc)

    taken = rows.select(*group, F.explode(F.aggregate("_r", start, step)["taken"]).alias("_t")).select(*group, F.col("_t.o").alias("ord"), F.col("_t.e").alias("_e"))
    joined = items.join(taken, [*group, "ord"], "left")
    eaten = F.when((F.col("tokens") <= 0) & (F.col("budget") >= 0), F.lit(0).cast("long")).otherwise(F.col("_e"))
    decision = F.when(F.col("taken_tokens").isNull(), "exclude").when(F.col("taken_tokens") < F.col("tokens"), "compress").otherwise("include")
    return joined.withColumn("taken_tokens", eaten).withColumn("decision", decision).drop("_e")


def summary(decided: DataFrame, group: list[str]) -> DataFrame:
    used = F.coalesce(F.sum(F.when(F.col("chosen"), F.col("tokens"))), F.lit(0))
    return decided.groupBy(*group).agg(
        used.cast("long").alias("total_tokens"),
        (F.max("budget") - used).cast("long").alias("remaining"),
        F.count_if("chosen").alias("selected_count"),
        F.count_if(~F.col("chosen")).alias("dropped_count"),
    )


def trace(decided: DataFrame, group: list[str]) -> DataFrame:
    step = F.row_number().over(W.partitionBy(*group).orderBy(F.col("score").desc(), F.col("recency").desc(), "ord"))
    return decided.withColumns(
        {
            "step": step.cast("long"),
            "decision": F.when(F.col("chosen"), "include").otherwise("exclude"),
            "reason": F.when(F.col("chosen"), "fits_budget").otherwise("over_budget"),
        }
    )


def variant_trace(decided: DataFrame, group: list[str]) -> DataFrame:
    """greedy_variants() with step and reason: fits_budget, compressed_to_fit or over_budget."""
    step = F.row_number().over(W.partitionBy(*group).orderBy(F.col("score").desc(), F.col("recency").desc(), "ord"))
    reason = F.when(F.col("decision") == "include", "fits_budget").when(F.col("decision") == "compress", "compressed_to_fit").otherwise("over_budget")
    return decided.withColumn("step", step.cast("long")).withColumn("reason", reason)


def without_superseded(items: DataFrame) -> DataFrame:
    """Items that no item of the pack supersedes."""
    gone = items.where("supersedes is not null").select("pack_id", F.col("supersedes").alias("id")).distinct()
    return items.join(gone, ["pack_id", "id"], "left_anti")


def kind_budgets(packs: DataFrame, kinds: list[tuple[str, float, int, int | None, int]]) -> DataFrame:
    """(pack_id, kind, kind_budget) from packs(pack_id, budget) and (kind, ratio, least, most, priority).

    A kind gets floor(ratio * budget), at least `least` and at most `most`. If together they
    exceed the budget, the kinds of least priority give way first: down to `least`, and then
    below it.
    """
    columns = {}
    over = None
    for kind, ratio, least, most, _ in kinds:
        b = F.greatest(F.floor(F.col("budget") * F.lit(float(ratio))), F.lit(least))
        columns[kind] = (F.least(b, F.lit(most)) if most is not None else b).cast("long")
    wide = packs.select("pack_id", "budget", *[b.alias(f"_{k}") for k, b in columns.items()])
    over = sum((F.col(f"_{k}") for k in columns), F.lit(0)) - F.col("budget")
    wide = wide.withColumn("_over", F.greatest(over, F.lit(0)).cast("long"))
    by_priority = [x for _, x in sorted(enumerate(kinds), key=lambda p: (p[1][4], p[0]))]
    for floor_of in (lambda x: x[2], lambda x: 0):
        for x in by_priority:
            give = F.greatest(F.least(F.col("_over"), F.col(f"_{x[0]}") - F.lit(floor_of(x))), F.lit(0))
            wide = wide.withColumn("_give", give.cast("long")).withColumn(f"_{x[0]}", F.col(f"_{x[0]}") - F.col("_give")).withColumn("_over", F.col("_over") - F.col("_give"))
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_{k}").alias("kind_budget")) for k in columns])
    return wide.select("pack_id", F.explode(pairs).alias("p")).select("pack_id", "p.kind", "p.kind_budget")


def allocate(items: DataFrame, packs: DataFrame, kinds: list[tuple[str, float, int, int | None, int]]) -> DataFrame:
    """items with `chosen`: packed per kind; what a kind leaves goes to the next kind by priority, the rest to other kinds."""
    from .scratch import cut

    caps = kind_budgets(packs, kinds)
    listed = [k[0] for k in kinds]
    own = items.withColumn("kind", F.coalesce("kind", F.lit("_uncategorized")))
    first = cut(greedy(own.drop("budget").join(caps, ["pack_id", "kind"]).withColumnRenamed("kind_budget", "budget"), ["pack_id", "kind"]))
    spent = first.groupBy("pack_id").agg(F.coalesce(F.sum(F.when(F.col("chosen"), F.col("tokens"))), F.lit(0)).alias("_spent"))
    done = first.where("chosen").drop("budget")
    left = packs.join(caps.groupBy("pack_id").agg(F.sum("kind_budget").alias("_caps")), "pack_id").join(spent, "pack_id", "left")
    # surplus of the kinds: what they were given and did not use
    pool = left.select("pack_id", (F.col("_caps") - F.coalesce("_spent", F.lit(0))).cast("long").alias("_pool"))
    open_ = first.where("not chosen").drop("chosen", "budget")
    for kind, *_ in sorted(kinds, key=lambda x: -x[4]):
        mine = open_.where(F.col("kind") == kind).join(pool.select("pack_id", F.col("_pool").alias("budget")), "pack_id")
        # each result is used twice, by the next kind's pool too: kept, it is not computed twice at every level
        got = cut(greedy(mine, ["pack_id"]).where("chosen"))
        done = done.unionByName(got.select(*done.columns))
        used = got.groupBy("pack_id").agg(F.sum("tokens").alias("_u"))
        pool = pool.join(used, "pack_id", "left").select("pack_id", (F.col("_pool") - F.coalesce("_u", F.lit(0))).cast("long").alias("_pool"))
    used = done.groupBy("pack_id").agg(F.sum("tokens").alias("_u"))
    rest = packs.join(used, "pack_id", "left").select("pack_id", (F.col("budget") - F.coalesce("_u", F.lit(0))).cast("long").alias("budget"))
    others = own.drop("budget").where(~F.col("kind").isin(listed)).join(rest, "pack_id")
    done = done.unionByName(greedy(others, ["pack_id"]).where("chosen").select(*done.columns))
    marks = done.select("pack_id", "ord").withColumn("_c", F.lit(True))
    return own.join(marks, ["pack_id", "ord"], "left").withColumn("chosen", F.coalesce("_c", F.lit(False))).drop("_c")


def volatility(kind: Column, static: list[str], session: list[str], given: Column | None = None) -> Column:
    """static, session or request by kind; what an item says itself (`given`, if it is one of the three) goes first."""
    by_kind = F.when(F.lower(kind).isin(static), "static").when(F.lower(kind).isin(session), "session").otherwise("request")
    return by_kind if given is None else F.when(given.isin("static", "session", "request"), given).otherwise(by_kind)


# The kinds of each class; all others are of requests.
STATIC = ["system", "tool", "schema", "example", "instruction", "few-shot"]
SESSION = ["memory", "conversation", "history", "session"]


def by_volatility(items: DataFrame) -> DataFrame:
    """items(volatility) with `chosen`: static items by id, then session, then request, each from what is left."""
    left = items.groupBy("pack_id").agg(F.max("budget").cast("long").alias("budget"))
    done = None
    for layer in ("static", "session", "request"):
        own = items.where(F.col("volatility") == layer).drop("budget").join(left, "pack_id")
        if layer == "static":
            own = own.withColumn("_s", F.col("score")).withColumn("_r", F.col("recency")).withColumn("score", -F.col("id").cast("double")).withColumn("recency", F.lit(0.0))
            got = greedy(own, ["pack_id"]).withColumn("score", F.col("_s")).withColumn("recency", F.col("_r")).drop("_s", "_r")
        else:
            got = greedy(own, ["pack_id"])
        used = got.where("chosen").groupBy("pack_id").agg(F.sum("tokens").alias("_u"))
        left = left.join(used, "pack_id", "left").select("pack_id", (F.col("budget") - F.coalesce("_u", F.lit(0))).cast("long").alias("budget"))
        done = got if done is None else done.unionByName(got)
    return done


def cache_layout(decided: DataFrame) -> DataFrame:
    """(pack_id, id, position, breakpoint) of what by_volatility() chose: static items by id, session and request items by score; `breakpoint` marks the last static and the last session item, if something follows."""
    layer = F.when(F.col("volatility") == "static", 0).when(F.col("volatility") == "session", 1).otherwise(2)
    rows = decided.where("chosen").withColumn("_l", layer)
    w = W.partitionBy("pack_id")
    by_id = F.when(F.col("_l") == 0, F.col("id"))
    at = F.row_number().over(w.orderBy("_l", by_id, F.when(F.col("_l") > 0, -F.col("score")), F.when(F.col("_l") > 0, -F.col("recency")), "ord")) - 1
    ends = [F.count_if(F.col("_l") <= k).over(w) for k in (0, 1, 2)]
    placed = rows.withColumns({"position": at.cast("long"), "_static": ends[0], "_session": ends[1], "_all": ends[2]})
    static = (F.col("position") == F.col("_static") - 1) & (F.col("_static") < F.col("_all"))
    session = (F.col("position") == F.col("_session") - 1) & (F.col("_session") > F.col("_static")) & (F.col("_session") < F.col("_all"))
    return placed.select("pack_id", "id", "position", F.when(static, "static-end").when(session, "session-end").alias("breakpoint"))


def cache_summary(decided: DataFrame) -> DataFrame:
    """(pack_id, static_count, session_count, request_count, cacheable_tokens, volatile_tokens, efficiency, cache_key) of what by_volatility() chose.

    The key is hash64() of the static items, by id; the budget bounds their text. Packs of which
    nothing was chosen have no row.
    """
    from ..functions.text import half_up, hash64

    chosen = decided.where("chosen")
    static = F.col("volatility") == "static"
    kept = F.sort_array(F.collect_list(F.when(static, F.struct("id", F.coalesce("content", F.lit("")).alias("content")))))
    text = F.array_join(F.transform(kept, lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["content"])), "|")
    tokens = F.coalesce(F.sum(F.when(static, F.col("tokens"))), F.lit(0)).cast("long")
    out = chosen.groupBy("pack_id").agg(
        *[F.count_if(F.col("volatility") == v).alias(f"{v}_count") for v in ("static", "session", "request")], tokens.alias("cacheable_tokens"), (F.sum("tokens").cast("long") - tokens).alias("volatile_tokens"), text.alias("_text"),
    )
    total = F.col("cacheable_tokens") + F.col("volatile_tokens")
    share = F.when(total > 0, half_up(F.col("cacheable_tokens") / total, 3)).otherwise(0.0)
    return out.withColumn("efficiency", share).withColumn("cache_key", hash64(F.col("_text"))).drop("_text")


# Attention by tenth of the window.
ATTENTION = {
    "claude": [1.0, 0.85, 0.65, 0.55, 0.5, 0.5, 0.55, 0.65, 0.8, 0.95],
    "gpt4": [0.9, 0.75, 0.6, 0.5, 0.45, 0.45, 0.5, 0.6, 0.8, 1.0],
    "default": [0.95, 0.8, 0.65, 0.55, 0.5, 0.5, 0.55, 0.65, 0.8, 0.95],
}


def place_by_score(items: DataFrame) -> DataFrame:
    """items(pack_id, ord, score) with `position`: best first."""
    w = W.partitionBy("pack_id").orderBy(F.col("score").desc(), "ord")
    return items.withColumn("position", (F.row_number().over(w) - 1).cast("long"))


def place(items: DataFrame, profile: str = "default") -> DataFrame:
    """items(pack_id, ord, score) with `position`: the k-th best item at the position of k-th most attention.

    The positions are those of the pack's own rows, so no second table is made or joined wide.
    """
    w = W.partitionBy("pack_id")
    n = F.count("*").over(w)
    ranked = items.withColumn("_n", n).withColumn("_k", F.row_number().over(w.orderBy(F.col("score").desc(), "ord")))
    weights = F.array(*[F.lit(x) for x in ATTENTION[profile]])
    spots = ranked.select("pack_id", "_n", (F.col("_k") - 1).alias("position"))
    attention = F.get(weights, F.least(F.floor(F.col("position") / F.col("_n") * 10), F.lit(9)).cast("int"))
    spots = spots.withColumn("_k", F.row_number().over(w.orderBy(attention.desc(), "position"))).drop("_n")
    joined = ranked.join(spots, ["pack_id", "_k"])
    return joined.withColumn("position", F.when(F.col("_n") <= 2, F.col("_k") - 1).otherwise(F.col("position")).cast("long")).drop("_k", "_n")


def pack_distinct(items: DataFrame, by: str = "recent") -> DataFrame:
    """items(pack_id, ord, content, ...) with `chosen`: one item of each cluster of near-equal texts is offered, the others are left out."""
    from ..functions.text import tokens
    from .retrieval import survivors

    sets = items.select(F.col("pack_id").alias("group"), "ord", F.array_distinct(tokens(F.col("content"))).alias("words"), "priority", "recency")
    left = survivors(sets, by=by).select(F.col("group").alias("pack_id"), "ord")
    packed = greedy(items.join(left, ["pack_id", "ord"], "left_semi"), ["pack_id"])
    return items.join(packed.select("pack_id", "ord", "chosen"), ["pack_id", "ord"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def mesh_pack(own: DataFrame, shared: DataFrame) -> DataFrame:
    """own(pack_id, id, ord, tokens, score, recency, budget) and the pending shared rows of the same columns, packed together; `entangled` says which are shared. Own items come first among equals."""
    both = own.withColumn("entangled", F.lit(False)).unionByName(shared.withColumn("entangled", F.lit(True)))
    rank = F.struct("entangled", "ord")
    rows = both.withColumn("_ord", F.row_number().over(W.partitionBy("pack_id").orderBy(rank)))
    packed = greedy(rows.withColumnRenamed("ord", "_own").withColumnRenamed("_ord", "ord"), ["pack_id"])
    return packed.drop("ord").withColumnRenamed("_own", "ord")


def learned_pack(items: DataFrame, weights: DataFrame) -> DataFrame:
    """items packed with learned weights(dimension, weight), one row each: priority, recency and salience; those missing keep their default."""
    base = {"priority": 1.0, "recency": 0.7, "salience": 0.5}
    wide = weights.agg(*[F.coalesce(F.max(F.when(F.col("dimension") == d, F.col("weight"))), F.lit(w)).alias(f"_w_{d}") for d, w in base.items()])
    total = sum((F.coalesce(d, F.lit(0.0)) * F.col(f"_w_{d}") for d in base), F.lit(0.0))
    scored = items.join(F.broadcast(wide)).withColumn("score", total).drop(*[f"_w_{d}" for d in base])
    return greedy(scored, ["pack_id"])


def manager_score(relevance: Column, importance: Column, recency: Column, weights=(0.55, 0.25, 0.20)) -> Column:
    """Weighted by shares of their sum."""
    t = sum(weights) or 1.0
    return relevance * (weights[0] / t) + importance * (weights[1] / t) + recency * (weights[2] / t)


def linear_recency(at: str, group: list[str]) -> Column:
    """0 for the oldest of a group to 1 for the newest; 1 where they are of one time."""
    w = W.partitionBy(*group)
    low, high = F.min(at).over(w), F.max(at).over(w)
    return F.when(high > low, (F.col(at) - low) / (high - low)).otherwise(1.0)


def build_context(items: DataFrame, recent: int = 12) -> DataFrame:
    """items(pack_id, ord, kind, pinned, text, at, importance, relevance, budget) with phase, taken_tokens and the text taken.

    In turn: system items by ord and pinned ones by importance and time, each cut to what is left
    if it does not fit; the `recent` newest messages; all others by relevance, importance and
    recency. A phase starts with what the ones before it left; in the first two everything is
    taken up to the first item that is cut, and nothing after it. Tokens are quarters of a character.
    """
    from ..functions.text import estimate_chars, truncated

    w = W.partitionBy("pack_id")
    message = F.col("kind") == "message"
    back = F.row_number().over(W.partitionBy("pack_id", message).orderBy(F.col("at").desc(), "ord"))
    phase = F.when(F.col("kind") == "system", 0).when(F.coalesce("pinned", F.lit(False)), 1).when(message & (back <= recent), 2).otherwise(3)
    rows = items.withColumn("tokens", estimate_chars(F.col("text"))).withColumn("phase", phase)
    left = rows.groupBy("pack_id").agg(F.max("budget").cast("long").alias("_left"))
    done = None
    for p in range(4):
        own = rows.where(F.col("phase") == p).drop("budget").join(left, "pack_id")
        if p < 2:
            order = ["ord"] if p == 0 else [F.coalesce("importance", F.lit(0.0)).desc(), F.col("at").desc(), "ord"]
            before = F.coalesce(F.sum("tokens").over(w.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            room = F.greatest(F.col("_left") - before, F.lit(0))
            got = own.withColumn("_room", room).withColumn("_text", F.when(F.col("_room") > 0, truncated(F.col("text"), F.col("_room"))))
            got = got.withColumn("taken_tokens", F.when(F.col("_text").isNotNull(), F.least("tokens", "_room"))).drop("_room", "_left")
        else:
            low, high = F.min("at").over(w), F.max("at").over(w)
            age = F.when(high > low, (F.col("at") - low) / (high - low)).otherwise(1.0)
            score_ = F.col("at").cast("double") if p == 2 else manager_score(F.coalesce("relevance", F.lit(0.0)), F.coalesce("importance", F.lit(0.0)), age)
            packed = greedy(own.withColumn("score", score_).withColumn("recency", F.col("at").cast("double")).withColumnRenamed("_left", "budget"), ["pack_id"])
            got = packed.withColumn("_text", F.when(F.col("chosen"), F.col("text"))).withColumn("taken_tokens", F.when(F.col("chosen"), F.col("tokens"))).drop("chosen", "score", "recency", "budget")
        used = got.groupBy("pack_id").agg(F.coalesce(F.sum("taken_tokens"), F.lit(0)).alias("_u"))
        left = left.join(used, "pack_id", "left").select("pack_id", (F.col("_left") - F.coalesce("_u", F.lit(0))).cast("long").alias("_left"))
        done = got if done is None else done.unionByName(got)
    return done.withColumn("text", F.col("_text")).drop("_text")
