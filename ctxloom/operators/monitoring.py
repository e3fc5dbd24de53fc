"""Drift over sliding windows, memories with decay, shared items with scope, learning and routing, task graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Per dimension its threshold and the direction that is bad.
DIMENSIONS = {"overall": (0.2, -1), "redundancy": (0.4, 1), "diversity": (0.3, -1), "stale_ratio": (0.5, 1), "utilization": (0.5, -1), "density": (0.25, -1)}


def drift(observations: DataFrame, dimensions: list[str], size: int = 10, least: int = 3) -> DataFrame:
    """Long rows (stream, ts, dimension, current, baseline, delta, trend, severity) over each last `size` observations."""
    w = W.partitionBy("stream").orderBy("ts", "obs_id").rowsBetween(-(size - 1), 0)
    wide = observations.select("stream", "ts", "obs_id", *[F.collect_list(d).over(w).alias(d) for d in dimensions])
    long = wide.select("stream", "ts", "obs_id", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("v")) for d in dimensions])).alias("x")).select("stream", "ts", "obs_id", "x.*")
    v, n = F.col("v"), F.size("v")

    def mean(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)

    half = F.floor(n / 2).cast("int")
    rows = long.where(n >= least).withColumns(
        {"current": F.element_at(v, -1), "baseline": mean(F.slice(v, F.lit(1), F.greatest(F.floor(n / 3), F.lit(1)).cast("int"))), "trend": mean(F.slice(v, half + 1, n - half)) - mean(F.slice(v, F.lit(1), half))}
    )
    rows = rows.withColumn("delta", F.col("current") - F.col("baseline"))
    limit, bad = F.lit(None).cast("double"), F.lit(0)
    for d, (t, s) in DIMENSIONS.items():
        limit, bad = F.when(F.col("dimension") == d, t).otherwise(limit), F.when(F.col("dimension") == d, s).otherwise(bad)
    size_ = F.abs("delta")
    severity = F.when(F.col("delta") * bad <= 0, "healthy").when(size_ >= limit, "critical").when(size_ >= limit / 2, "warning").otherwise("healthy")
    return rows.withColumn("severity", severity).drop("v")


# Per dimension what an alert calls it and what it recommends.
ALERTS = {
    "overall": ("overall relevance", "re-score and re-rank context items to restore relevance"),
    "redundancy": ("content redundancy", "deduplicate overlapping context items to reduce redundancy"),
    "diversity": ("topic diversity", "broaden retrieval sources to restore topic diversity"),
    "stale_ratio": ("stale item ratio", "prune stale retrieval items and refresh context sources"),
    "utilization": ("budget utilization", "increase budget or add more context to improve utilization"),
    "density": ("information density", "compress or summarize low-density items to improve information density"),
}


def trend_class(dimension: Column, trend: Column) -> Column:
    """improving, degrading, or stable below 0.02."""
    good_down = F.lit(False)
    for d, (_, bad) in DIMENSIONS.items():
        if bad > 0:
            good_down = good_down | (dimension == d)
    better = F.when(good_down, trend < 0).otherwise(trend > 0)
    return F.when(F.abs(trend) < 0.02, "stable").when(better, "improving").otherwise("degrading")


def alerts(drifted: DataFrame) -> DataFrame:
    """The rows of drift() that are not healthy, with message and recommendation."""
    name, advice = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d, (n, r) in ALERTS.items():
        name, advice = F.when(F.col("dimension") == d, n).otherwise(name), F.when(F.col("dimension") == d, r).otherwise(advice)
    critical = F.col("severity") == "critical"
    moved = F.when(F.col("delta") > 0, "increased").otherwise("decreased")
    message = F.concat(F.when(critical, "Critical").otherwise("Warning"), F.lit(": "), name, F.lit(" has "), moved, F.lit(" by "), F.format_string("%.3f", F.abs("delta")))
    return drifted.where("severity <> 'healthy'").withColumns({"message": message, "recommendation": F.concat(F.when(critical, "Immediately ").otherwise("Consider "), advice)})


def drift_status(drifted: DataFrame) -> DataFrame:
    """(stream, ts, obs_id, status, since): the worst severity over the dimensions, and when the present run of drifting observations began."""
    level = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    rows = drifted.groupBy("stream", "ts", "obs_id").agg(F.max(level).alias("_l"))
    w = W.partitionBy("stream").orderBy("ts", "obs_id")
    calm = F.last(F.when(F.col("_l") == 0, F.struct("ts", "obs_id")), ignorenulls=True).over(w)
    rows = rows.withColumn("_calm", calm)
    began = F.min(F.when(F.col("_l") > 0, F.col("ts"))).over(W.partitionBy("stream", "_calm"))
    status = F.when(F.col("_l") == 2, "critical").when(F.col("_l") == 1, "warning").otherwise("healthy")
    return rows.select("stream", "ts", "obs_id", status.alias("status"), F.when(F.col("_l") > 0, began).alias("since"))


def publish(shared: DataFrame, new: DataFrame, now: str, ttl: float | None = None, default: str = "next-pack", most: int = 1000) -> DataFrame:
    """shared(item_id, source_agent, kind, priority, scope, propagation, entangled_at, expires_at) with new rows added; the newest `most` of all stay.

    new(item_id, source_agent, kind, priority, scope, propagation, expires_in, new_priority):
    a null scope is for all, a null propagation the default one, expires_in (seconds) null the
    ttl, and that null never; new_priority replaces the priority where it is given.
    """
    at = F.lit(now).cast("timestamp")
    life = F.coalesce(F.col("expires_in").cast("double"), F.lit(ttl).cast("double"))
    rows = new.select(
        "item_id", "source_agent", "kind", F.coalesce("new_priority", "priority").alias("priority"), "scope", F.coalesce("propagation", F.lit(default)).alias("propagation"),
        at.alias("entangled_at"), F.timestamp_millis((F.unix_millis(at) + life * 1000).cast("long")).alias("expires_at"),
    )
    return shared.unionByName(rows).orderBy(F.desc("entangled_at"), F.desc("item_id")).limit(most)


def for_agents(items: DataFrame, agents: DataFrame, acks: DataFrame, now: str, packing: bool = True) -> DataFrame:
    """(agent, item_id): what agents(agent, kinds: null or empty for any) are given of the scoped items(item_id, source_agent, kind, scope, propagation, expires_at).

    Not their own, not expired, of their kinds; when packing, nothing on demand; immediate items
    not once they are acknowledged. Items for all (null scope) are left to visible(), which does
    not pair them with every agent.
    """
    live = items.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp"))).where("scope is not null")
    if packing:
        live = live.where(F.coalesce("propagation", F.lit("")) != "on-demand")
    rows = live.select("item_id", "source_agent", "kind", "propagation", F.explode(F.array_distinct("scope")).alias("agent")).where(~F.col("agent").eqNullSafe(F.col("source_agent")))
    rows = rows.join(agents, "agent").where((F.size(F.coalesce("kinds", F.array().cast("array<string>"))) == 0) | F.coalesce(F.array_contains("kinds", F.col("kind")), F.lit(False)))
    done = acks.select("agent", "item_id").distinct().withColumn("_done", F.lit(True))
    rows = rows.join(done, ["agent", "item_id"], "left")
    return rows.where(~((F.col("propagation") == "immediate") & F.coalesce("_done", F.lit(False)))).select("agent", "item_id")


def mesh_stats(shared: DataFrame) -> DataFrame:
    """(side, agent, items): by source, and by target, where '*' stands for all."""
    by_source = shared.groupBy(F.col("source_agent").cast("string").alias("agent")).agg(F.count("*").alias("items")).select(F.lit("source").alias("side"), "agent", "items")
    targets = F.coalesce(F.transform("scope", lambda x: x.cast("string")), F.array(F.lit("*")))
    by_target = shared.select(F.explode(targets).alias("agent")).groupBy("agent").agg(F.count("*").alias("items")).select(F.lit("target").alias("side"), "agent", "items")
    return by_source.unionByName(by_target)


def decayed(salience: Column, age_seconds: Column, half_life: float) -> Column:
    return salience * F.exp(F.lit(-0.6931471805599453) * age_seconds / F.lit(float(half_life)))


def recall(memories: DataFrame, now: str, half_life: float, least: float, text: str | None = None) -> DataFrame:
    """Unexpired memories with a decayed salience of at least `least`, ranked by it."""
    at = F.lit(now).cast("timestamp")
    age = (F.unix_millis(at) - F.unix_millis("created_at")) / 1000.0
    expired = F.coalesce(F.col("ttl_seconds") > 0, F.lit(False)) & (F.unix_millis("created_at") + F.col("ttl_seconds") * 1000 <= F.unix_millis(at))
    rows = memories.where(~expired).withColumn("decayed", decayed(F.coalesce("salience", F.lit(1.0)), age, half_life)).where(F.col("decayed") >= least)
    return rows.where(F.contains(F.lower("content"), F.lit(text.lower()))) if text else rows


def bridge_recency(age_seconds: Column, half_life: float = 3600.0) -> Column:
    return F.floor(F.pow(F.lit(0.5), age_seconds / half_life) * 1000 + 0.5) / 100.0


def visible(items: DataFrame, agents: DataFrame, acks: DataFrame, now: str) -> DataFrame:
    """(item_id, agent, rule): which agents see which shared items: not their own, in scope (null scope: all), not expired, not acknowledged.

    An item with a scope has a row 'agent' for each agent that sees it. An item for all has one row
    'all' without agent, and a row 'except' for each agent that does not see it (its source, and who
    acknowledged it), so items and agents are never all paired.
    """
    live = items.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp")))
    scoped = live.where("scope is not null").select("item_id", "source_agent", F.explode(F.array_distinct("scope")).alias("agent")).join(agents, "agent", "left_semi")
    seen = scoped.where(~F.col("agent").eqNullSafe(F.col("source_agent"))).join(acks, ["agent", "item_id"], "left_anti")
    open_ = live.where("scope is null")
    own = open_.select("item_id", F.col("source_agent").alias("agent"))
    acked = acks.join(open_.select("item_id"), "item_id", "left_semi").select("item_id", "agent")
    without = own.unionByName(acked).distinct().join(agents, "agent", "left_semi")
    all_ = open_.select("item_id", F.lit(None).cast(agents.schema["agent"].dataType).alias("agent"))
    out = seen.select("item_id", "agent", F.lit("agent").alias("rule"))
    return out.unionByName(all_.withColumn("rule", F.lit("all"))).unionByName(without.select("item_id", "agent", F.lit("except").alias("rule")))


def correlations(features: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, samples, correlation) of each record's mean over selected items with the record's quality."""
    per = features.where("selected").groupBy("record_id").agg(F.max("quality").alias("quality"), *[F.avg(d).alias(d) for d in dimensions])
    long = per.select("quality", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("x")) for d in dimensions])).alias("s")).select("quality", "s.*")
    return long.where("x is not null and quality is not null").groupBy("dimension").agg(F.count("*").alias("samples"), F.coalesce(F.nanvl(F.corr("x", "quality"), F.lit(0.0)), F.lit(0.0)).alias("correlation"))


def learned_weight(base: Column, correlation: Column, samples: Column, rate: float = 0.1, pull: float = 0.01, least: int = 20) -> Column:
    moved = base * (1 - rate) + (base + correlation) * rate
    moved = moved - (moved - base) * pull
    return F.when(samples < least, base).otherwise(F.least(F.greatest(moved, F.lit(0.01)), F.lit(10.0)))


def confidence(samples: Column, variance: Column) -> Column:
    """0 to 1 from the number of outcomes and the population variance of their quality: too little variance teaches little, too much is noise."""
    v = F.coalesce(variance, F.lit(0.0))
    factor = F.when(v < 0.01, v / 0.01).when(v > 0.25, F.greatest(F.lit(0.0), 1 - (v - 0.25) / 0.25)).otherwise(1.0)
    return F.when(samples > 0, F.least(F.greatest((1 - F.exp(-samples / 50.0)) * factor, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def route(requests: DataFrame, tiers: list[tuple], default: str | None = None) -> DataFrame:
    """requests(request_id, complexity, tokens, needs) with model, alternative and cost_delta.

    tiers: (model, max_tokens, cost, max_complexity, capabilities) of the configuration. The
    cheapest tier that is enough and has all that `needs` names (null: nothing) is chosen, else
    the default one, else the dearest; the alternative is the next dearer tier. An expression
    over the tiers, so nothing is joined.
    """
    ranked = sorted(tiers, key=lambda t: t[2])
    needs = F.coalesce("needs", F.array().cast("array<string>"))
    fallback = next((i for i, t in enumerate(ranked) if t[0] == default), len(ranked) - 1)
    at = F.lit(fallback)
    for i in range(len(ranked) - 1, -1, -1):
        _, most, _, hardest, has = ranked[i]
        able = F.size(F.array_except(needs, F.array(*[F.lit(x) for x in has]).cast("array<string>"))) == 0
        at = F.when((F.col("complexity") <= hardest) & (F.col("tokens") <= most) & able, F.lit(i)).otherwise(at)

    def pick(values, kind):
        return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("_at"))

    models, costs = [t[0] for t in ranked], [t[2] for t in ranked]
    gaps = [round((b - a) * 10000) / 10000 for a, b in zip(costs, costs[1:], strict=False)]
    out = requests.withColumn("_at", at)
    return out.select("request_id", pick(models, "string").alias("model"), pick([*models[1:], None], "string").alias("alternative"), pick([*gaps, None], "double").alias("cost_delta"))


def ready(issues: DataFrame, deps: DataFrame, now: str) -> DataFrame:
    """Open, undeferred issues without a blocking dependency on an issue that is not closed (or missing)."""
    closed = issues.where("status = 'closed'").select(F.col("issue_id").alias("depends_on"))
    blocked = deps.where("type in ('blocks', 'parent-child')").join(closed, "depends_on", "left_anti").select("issue_id").distinct()
    live = issues.where("status = 'open' and not ephemeral").where(F.col("defer_until").isNull() | (F.col("defer_until") <= F.lit(now).cast("timestamp")))
    return live.join(blocked, "issue_id", "left_anti")


def kind_insights(features: DataFrame) -> DataFrame:
    """Per kind of features(record_id, kind, selected, quality): mean quality of the records with and without a selected item of it, and the lift.

    Records without come from the totals less those with, so no kind meets every record.
    """
    records = features.groupBy("record_id").agg(F.max("quality").alias("q")).agg(F.count("*").alias("n"), F.sum("q").alias("s"))
    seen = features.groupBy("kind", "record_id").agg(F.max("quality").alias("q"), F.bool_or("selected").alias("on"))
    kinds = seen.groupBy("kind").agg(F.count_if("on").alias("k"), F.coalesce(F.sum(F.when(F.col("on"), F.col("q"))), F.lit(0.0)).alias("t"))
    both = kinds.join(F.broadcast(records))
    inside = F.when(F.col("k") > 0, F.col("t") / F.col("k")).otherwise(0.0)
    outside = F.when(F.col("n") > F.col("k"), (F.col("s") - F.col("t")) / (F.col("n") - F.col("k"))).otherwise(0.0)
    return both.select("kind", F.col("n").alias("count"), inside.alias("included"), outside.alias("excluded"), (inside - outside).alias("lift"))


def router_stats(outcomes: DataFrame) -> DataFrame:
    """(model, uses, avg_quality, avg_complexity) to three digits."""
    def three(x):
        return F.floor(x * 1000 + 0.5) / 1000.0

    return outcomes.groupBy("model").agg(F.count("*").alias("uses"), three(F.avg("quality")).alias("avg_quality"), three(F.avg("complexity")).alias("avg_complexity"))


def potential_savings(tiers: list[tuple[str, float]], outcomes: DataFrame, band: float = 0.15, good: float = 0.5) -> DataFrame:
    """One row: over all outcomes(model, complexity, quality), the cost saved by the cheapest tier(model, cost) that did well near the outcome's complexity.

    Outcomes are first gathered by (model, complexity); with complexities rounded to three
    digits these are few, so the band join does not grow with the outcomes.
    """
    cost = F.lit(None).cast("double")
    for m, c in tiers:
        cost = F.when(F.col("model") == m, float(c)).otherwise(cost)
    cells = outcomes.groupBy("model", "complexity").agg(F.sum("quality").alias("s"), F.count("*").alias("n")).withColumn("cost", cost).where("cost is not null")
    cheap = cells.select(F.col("model").alias("m"), F.col("complexity").alias("c"), F.col("cost").alias("k"), F.col("s").alias("t"), F.col("n").alias("u"))
    near = cells.join(cheap, (F.col("k") < F.col("cost")) & (F.abs(F.col("c") - F.col("complexity")) <= band))
    tried = near.groupBy("model", "complexity", "n", "cost", "m", "k").agg((F.sum("t") / F.sum("u")).alias("q")).where(F.col("q") >= good)
    best = tried.groupBy("model", "complexity", "n", "cost").agg(F.min("k").alias("k"))
    return best.agg((F.floor(F.coalesce(F.sum(F.col("n") * (F.col("cost") - F.col("k"))), F.lit(0.0)) * 10000 + 0.5) / 10000.0).alias("savings"))


#: Depth from which a pack's dependencies weigh in full.
DEPTH = 10


def complexity(quality: DataFrame, items: DataFrame, depths: DataFrame) -> DataFrame:
    """(pack_id, six dimensions, overall) of items(pack_id, id, kind, tokens, scripts), scripts as script_bits() of their texts, with their quality and depths(node, depth)."""
    # What each dimension weighs.
    weights = {"diversity": 0.25, "density": 0.2, "dependency_depth": 0.2, "tool_calls": 0.15, "multilinguality": 0.1, "average_length": 0.1}
    rows = items.select("pack_id", "id", "kind", "tokens", "scripts").join(depths.withColumnRenamed("node", "id"), "id", "left")
    per = rows.groupBy("pack_id").agg(
        F.max(F.coalesce("depth", F.lit(0))).alias("_d"), F.avg(F.coalesce(F.contains(F.lower("kind"), F.lit("tool")), F.lit(False)).cast("double")).alias("_t"), F.avg("tokens").alias("_l"),
        F.bit_count(F.bit_or("scripts")).alias("_s"),
    )
    out = per.join(quality.select("pack_id", "diversity", "density"), "pack_id").select(
        "pack_id", "diversity", "density", F.least(F.col("_d") / DEPTH, F.lit(1.0)).alias("dependency_depth"), F.col("_t").alias("tool_calls"),
        F.greatest(F.least((F.col("_s") - 1) / 4, F.lit(1.0)), F.lit(0.0)).alias("multilinguality"), F.least(F.col("_l") / 2000, F.lit(1.0)).alias("average_length"),
    )
    total = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    three = {c: F.floor(F.col(c) * 1000 + 0.5) / 1000.0 for c in weights}
    return out.withColumn("overall", F.floor(total / sum(weights.values()) * 1000 + 0.5) / 1000.0).withColumns(three)


def promote(tiers: DataFrame, outcomes: DataFrame, requests: DataFrame, least: int = 20, band: float = 0.15, good: float = 0.5) -> DataFrame:
    """requests(request_id, model, complexity) with `routed`: the next dearer tier where the model's outcomes near that complexity were poor.

    Both sides are first gathered by (model, complexity); with complexities rounded to three
    digits these are few, so the band join does not grow with the outcomes.
    """
    ranked = tiers.select("model", F.lead("model").over(W.orderBy("cost")).alias("dearer"))
    cells = outcomes.groupBy("model", F.col("complexity").alias("c")).agg(F.sum("quality").alias("s"), F.count("*").alias("n"))
    asked = requests.select("model", "complexity").distinct()
    close = asked.join(cells, (asked["model"] == cells["model"]) & (F.abs(F.col("c") - F.col("complexity")) <= band)).drop(cells["model"])
    seen = close.groupBy("model", "complexity").agg((F.sum("s") / F.sum("n")).alias("q"))
    total = cells.groupBy("model").agg(F.sum("n").alias("n"))
    out = requests.join(seen, ["model", "complexity"], "left").join(total, "model", "left").join(F.broadcast(ranked), "model", "left")
    poor = (F.coalesce("n", F.lit(0)) >= least) & (F.col("q") < good)
    return out.select("request_id", "model", F.when(poor, F.coalesce("dearer", "model")).otherwise(F.col("model")).alias("routed"))


def fall_back(routed: DataFrame, least: float, retries: int = 1) -> DataFrame:
    """routed(request_id, model, alternative, quality, retry_qualities) with final_model, attempts and fell_back.

    `quality` is that of the model's own answer, retry_qualities those of the alternative's
    answers in turn, as the caller has measured them. A model without alternative stays.
    """
    stays = (F.col("quality") >= least) | F.col("alternative").isNull()
    tried = F.slice(F.coalesce("retry_qualities", F.array().cast("array<double>")), 1, retries)
    good = F.array_position(F.transform(tried, lambda q: q >= least), F.lit(True))
    attempts = F.when(stays, 1).otherwise(1 + F.when(good > 0, good).otherwise(retries))
    return routed.withColumns({"final_model": F.when(stays, F.col("model")).otherwise(F.col("alternative")), "attempts": attempts.cast("long"), "fell_back": ~stays})
