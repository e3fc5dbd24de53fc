"""Declared slots, constraints on packed items, and what packs left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packing import greedy
from .retrieval import set_pairs

# Words that negate.
NEGATIONS = ["not", "never", "don't", "dont", "avoid", "shouldn't", "shouldnt", "won't", "wont", "cannot", "can't", "cant", "no"]


def words(content: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(content, F.lit(""))), r"\s+"), lambda w: w != "")


def fill_slots(items: DataFrame, slots: list[tuple[str, str | None, int]]) -> DataFrame:
    """items with `slot` and `chosen`: slots (name, kind, max_tokens) are filled in their order.

    An item belongs to the first slot of its kind; items of no slot's kind belong to the first
    slot with kind None, if any, and else to none. A slot takes greedily what fits both its own
    limit and what the slots before it left of the budget.
    """
    rest = [name for name, kind, _ in slots if kind is None][:1]
    named = F.coalesce(*[F.when(F.col("kind") == kind, name) for name, kind, _ in slots if kind is not None], F.lit(rest[0] if rest else None).cast("string"))
    dealt = items.withColumn("slot", named)
    left = items.groupBy("pack_id").agg(F.max("budget").cast("long").alias("_left"))
    done = dealt.where("slot is null").drop("budget").withColumn("chosen", F.lit(False))
    for name, _, most in slots:
        own = dealt.where(F.col("slot") == name).drop("budget").join(left, "pack_id").withColumn("budget", F.least(F.col("_left"), F.lit(most).cast("long"))).drop("_left")
        got = greedy(own, ["pack_id"]).drop("budget")
        used = got.where("chosen").groupBy("pack_id").agg(F.sum("tokens").alias("_u"))
        left = left.join(used, "pack_id", "left").select("pack_id", (F.col("_left") - F.coalesce("_u", F.lit(0))).cast("long").alias("_left"))
        done = done.unionByName(got)
    return done


def contradictions(packed: DataFrame, num: int = 3, den: int = 5) -> DataFrame:
    """(pack_id, a, b): packed items whose word sets overlap by more than num / den, one of which negates."""
    w = words(F.col("content"))
    sets = packed.select(F.col("pack_id").alias("group"), F.col("id").alias("ord"), F.array_distinct(w).alias("words")).where(F.size("words") > 0)
    negates = sets.select("group", "ord", F.arrays_overlap("words", F.array(*[F.lit(x) for x in NEGATIONS])).alias("neg"))
    x, y = (negates.withColumnsRenamed({"ord": c, "neg": f"neg_{c}"}) for c in "ab")
    both = set_pairs(sets, num, den, strict=True).join(x, ["group", "a"]).join(y, ["group", "b"])
    return both.where(F.col("neg_a") != F.col("neg_b")).select(F.col("group").alias("pack_id"), "a", "b")


def check(packed: DataFrame, packs: DataFrame, required: list[tuple[str, str]], fresh: float = 5.0, least: float = 0.7, most: float = 0.95, redundancy: tuple[int, int] = (4, 5)) -> DataFrame:
    """(pack_id, level, slot, constraint, item_id, other_id) of all five constraints: diagnostics(), contradictions() and redundant pairs.

    packed(pack_id, id, kind, content, recency, tokens) and packs(pack_id, budget).
    """
    none = F.lit(None).cast("string")
    pairs = [(contradictions(packed), "error", "no-contradiction"), (redundant_pairs(packed, *redundancy), "warning", "max-redundancy")]
    out = diagnostics(packed, packs, required, fresh, least, most).withColumn("other_id", none)
    for found, level, name in pairs:
        out = out.unionByName(found.select("pack_id", F.lit(level).alias("level"), none.alias("slot"), F.lit(name).alias("constraint"), F.col("a").cast("string").alias("item_id"), F.col("b").cast("string").alias("other_id")))
    return out


def diagnostics(packed: DataFrame, packs: DataFrame, required: list[tuple[str, str]], fresh: float = 5.0, least: float = 0.7, most: float = 0.95) -> DataFrame:
    """(pack_id, level, slot, constraint, item_id): freshness, coverage and budget use of packed items.

    packs(pack_id, budget) names every pack, also those without items; required holds the
    (slot, kind) pairs that must have an item.
    """
    none = F.lit(None).cast("string")
    stale = packed.where(F.coalesce("recency", F.lit(0.0)) < fresh).select(
        "pack_id", F.lit("warning").alias("level"), none.alias("slot"), F.lit("freshness").alias("constraint"), F.col("id").cast("string").alias("item_id")
    )
    per = packs.join(packed.groupBy("pack_id").agg(F.sum("tokens").alias("_t"), F.collect_set("kind").alias("_k")), "pack_id", "left")
    use = F.when(F.col("budget") > 0, F.coalesce("_t", F.lit(0)) / F.col("budget")).otherwise(0.0)
    found = [F.when(use < least, F.struct(F.lit("warning").alias("level"), none.alias("slot"), F.lit("budget-utilization").alias("constraint")))]
    found.append(F.when(use > most, F.struct(F.lit("info").alias("level"), none.alias("slot"), F.lit("budget-utilization").alias("constraint"))))
    for slot, kind in required:
        there = F.coalesce(F.array_contains("_k", kind), F.lit(False))
        found.append(F.when(~there, F.struct(F.lit("error").alias("level"), F.lit(slot).alias("slot"), F.lit("coverage").alias("constraint"))))
    rows = per.select("pack_id", F.explode(F.array_compact(F.array(*found))).alias("r")).select("pack_id", "r.*", none.alias("item_id"))
    return stale.unionByName(rows)


def dropped_analysis(decided: DataFrame, high: float = 7.0, query: list[str] | None = None, least: float = 0.3) -> DataFrame:
    """(pack_id, kind, dropped, high_priority_dropped, relevant_dropped) of items that a pack left out: priorities above `high`, and items that have more than `least` of the query's keywords."""
    from ..functions.text import keyword_relevance, keywords

    out = decided.where(~F.col("chosen")).groupBy("pack_id", F.coalesce("kind", F.lit("unknown")).alias("kind"))
    asked = F.array(*[F.lit(w) for w in query or []]).cast("array<string>")
    relevant = F.count_if(keyword_relevance(asked, keywords(F.col("content"))) > least) if query else F.lit(0).cast("long")
    return out.agg(F.count("*").alias("dropped"), F.count_if(F.coalesce("priority", F.lit(0.0)) > high).alias("high_priority_dropped"), relevant.alias("relevant_dropped"))


def backtest(decided: DataFrame) -> DataFrame:
    """Per pack of decided(required, disallowed): missing and forbidden items, use of the budget, passed."""
    used = F.coalesce(F.sum(F.when(F.col("chosen"), F.col("tokens"))), F.lit(0))
    out = decided.groupBy("pack_id").agg(
        F.count_if(F.col("required") & ~F.col("chosen")).alias("missing_required"),
        F.count_if(F.col("disallowed") & F.col("chosen")).alias("included_disallowed"),
        F.when(F.max("budget") > 0, F.floor(used / F.max("budget") * 100 + 0.5) / 100.0).otherwise(0.0).alias("budget_usage"),
    )
    return out.withColumn("passed", (F.col("missing_required") == 0) & (F.col("included_disallowed") == 0))


def redundant_pairs(packed: DataFrame, num: int = 1, den: int = 2) -> DataFrame:
    """(pack_id, a, b): packed items whose word sets (words above two characters) overlap by more than num / den."""
    w = F.array_distinct(F.filter(words(F.col("content")), lambda x: F.length(x) > 2))
    sets = packed.select(F.col("pack_id").alias("group"), F.col("id").alias("ord"), w.alias("words")).where(F.size("words") > 0)
    return set_pairs(sets, num, den, strict=True).select(F.col("group").alias("pack_id"), "a", "b")


def prune_stale(items: DataFrame, oldest: dict[str, float]) -> DataFrame:
    """items without those whose recency is below their kind's limit; kinds without a limit stay."""
    limit = F.lit(None).cast("double")
    for kind, least in oldest.items():
        limit = F.when(F.col("kind") == kind, float(least)).otherwise(limit)
    return items.where(limit.isNull() | (F.coalesce("recency", F.lit(0.0)) >= limit))


def drop_duplicates(items: DataFrame, kinds: list[str]) -> DataFrame:
    """items(pack_id, id, kind, content) without those of the kinds that overlap by more than 4/5 with an earlier kept one of any of them, in id order."""
    from .retrieval import leaders

    own = items.where(F.col("kind").isin(kinds))
    w = F.array_distinct(F.filter(words(F.col("content")), lambda x: F.length(x) > 2))
    sets = own.select(F.col("pack_id").alias("group"), F.col("id").alias("ord"), w.alias("words"))
    # an item is kept if no kept one before it is linked to it: that is what leads
    led = leaders(sets.drop("words"), set_pairs(sets.where(F.size("words") > 0), 4, 5, strict=True))
    gone = led.where("leader <> ord").select(F.col("group").alias("pack_id"), F.col("ord").alias("id"))
    return items.join(gone, ["pack_id", "id"], "left_anti")


def positioned(items: DataFrame, positions: dict[str, str], target: str, prefix: bool = False) -> DataFrame:
    """items(pack_id, ord, id, kind, priority) with `position`: kinds that go first, then the others as the target reads best, then kinds that go last.

    claude: the better half by priority, then the worse half from the worst up to the middle,
    reversed; gpt4: by priority; gemini: by kind; else as they come. With `prefix`, those that
    go first are ordered by id, so that they make the same prefix each time.
    """
    from pyspark.sql import Window as W

    zone = F.lit(1)
    for kind, p in positions.items():
        zone = F.when(F.col("kind") == kind, {"first": 0, "last": 2}.get(p, 1)).otherwise(zone)
    rows = items.withColumn("_z", zone)
    w = W.partitionBy("pack_id", "_z")
    k = F.row_number().over(w.orderBy(F.coalesce("priority", F.lit(0.0)).desc(), "ord"))
    n = F.count("*").over(w)
    rows = rows.withColumn("_k", k).withColumn("_n", n)
    half = F.ceil(F.col("_n") / 2)
    middle = {
        "claude": F.when(F.col("_k") <= half, F.col("_k")).otherwise(half + 1 + F.col("_n") - F.col("_k")),
        "gpt4": F.col("_k"),
        "gemini": F.dense_rank().over(w.orderBy(F.coalesce("kind", F.lit("")))),
    }.get(target, F.lit(0))
    first = F.dense_rank().over(w.orderBy("id")) if prefix else F.lit(0)
    at = F.when(F.col("_z") == 1, middle).when(F.col("_z") == 0, first).otherwise(0)
    rows = rows.withColumn("_m", at)
    spot = F.row_number().over(W.partitionBy("pack_id").orderBy("_z", "_m", "ord")) - 1
    return rows.withColumn("position", spot.cast("long")).drop("_z", "_k", "_n", "_m")


class Program:
    """Declared slots and constraints, compiled over packs: stale ones out, duplicates out, slots filled, diagnosed, placed."""

    def __init__(self, target: str = "generic"):
        self.target, self.slots, self.positions, self.oldest, self.unique, self.required = target, [], {}, {}, [], []

    def slot(self, name: str, kind: str | None, most: int, *, position: str = "any", max_staleness: float | None = None, deduplicate: bool = False, required: bool = False) -> Program:
        self.slots.append((name, kind, most))
        if kind is not None:
            self.positions[kind] = position
            if max_staleness is not None:
                self.oldest[kind] = max_staleness
            if deduplicate:
                self.unique.append(kind)
            if required:
                self.required.append((name, kind))
        return self

    def compile(self, items: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(the chosen items with slot and position, the diagnostics)."""
        left = prune_stale(items, self.oldest)
        if self.unique:
            left = drop_duplicates(left, self.unique)
        chosen = fill_slots(left, self.slots).where("chosen")
        found = diagnostics(chosen, items.groupBy("pack_id").agg(F.max("budget").alias("budget")), self.required)
        return positioned(chosen, self.positions, self.target, prefix=True), found
