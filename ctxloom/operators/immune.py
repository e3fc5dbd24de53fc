"""Fingerprints of packs that failed, and screening of other packs against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# What each part of a fingerprint weighs.
WEIGHTS = {"kinds": 0.2, "priority": 0.15, "recency": 0.15, "tokens": 0.15, "count": 0.1, "stale": 0.1, "redundancy": 0.15}


def kind_ratios(items: DataFrame) -> DataFrame:
    """(pack_id, kinds): a map of each kind's share of the pack's items, as sorted pairs."""
    n = items.groupBy("pack_id", F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"))
    gathered = n.groupBy("pack_id").agg(F.sum("n").alias("t"), F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("k"))
    return gathered.select("pack_id", F.transform("k", lambda x: F.struct(x["kind"].alias("kind"), (x["n"] / F.col("t")).alias("ratio"))).alias("kinds"))


def redundancy_estimate(items: DataFrame, first: int = 50) -> DataFrame:
    """(pack_id, redundancy): of a pack's first items by ord, the share that has a Jaccard above 0.8 with another of them.

    Each pack sends at most `first` word sets on; their pairs are compared through the words they share.
    """
    w = W.partitionBy("pack_id").orderBy("ord")
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("content", F.lit(""))), r"\s+"), lambda x: x != ""))
    few = items.withColumn("k", F.row_number().over(w)).where(F.col("k") <= first).select("pack_id", "k", words.alias("s"))
    sizes = few.groupBy("pack_id").agg(F.count("*").alias("n"), F.count_if(F.size("s") == 0).alias("empty"))
    each = few.select("pack_id", "k", F.size("s").alias("n"), F.explode("s").alias("x"))
    a, b = each.withColumnsRenamed({"k": "a", "n": "na"}), each.withColumnsRenamed({"k": "b", "n": "nb"})
    close = (F.col("a") < F.col("b")) & (F.least("na", "nb") * 5 > F.greatest("na", "nb") * 4)
    shared = a.join(b, ["pack_id", "x"]).where(close).groupBy("pack_id", "a", "b").agg(F.count("*").alias("i"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    alike = shared.where(F.col("i") * 5 > (F.col("na") + F.col("nb") - F.col("i")) * 4)
    hit = alike.select("pack_id", F.explode(F.array("a", "b")).alias("k")).groupBy("pack_id").agg(F.count_distinct("k").alias("h"))
    # empty sets are alike, but share no word
    both = sizes.join(hit, "pack_id", "left")
    return both.select("pack_id", ((F.coalesce("h", F.lit(0)) + F.when(F.col("empty") > 1, F.col("empty")).otherwise(0)) / F.col("n")).alias("redundancy"))


def pattern(items: DataFrame) -> DataFrame:
    """The whole fingerprint of each pack of items(pack_id, ord, kind, content, priority, recency, tokens, budget)."""
    from .quality import fingerprint

    return fingerprint(items).join(kind_ratios(items), "pack_id").join(redundancy_estimate(items), "pack_id")


def similarity(a: str, b: str) -> Column:
    """Likeness of two fingerprint structs, 0 to 1."""
    def c(side, name):
        return F.col(f"{side}.{name}")

    def norm(x):
        return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, k: s + k["ratio"] * k["ratio"]))

    def ratio(x, kind):
        return F.aggregate(F.filter(x, lambda k: k["kind"] == kind), F.lit(0.0), lambda s, k: s + k["ratio"])

    x, y = c(a, "kinds"), c(b, "kinds")
    dot = F.aggregate(x, F.lit(0.0), lambda s, k: s + k["ratio"] * ratio(y, k["kind"]))
    kinds = F.when(norm(x) * norm(y) == 0, 1.0).otherwise(dot / (norm(x) * norm(y)))

    def stats(name):
        total = sum((F.pow(c(a, f"{name}_{k}") - c(b, f"{name}_{k}"), F.lit(2.0)) for k in ("min", "max", "mean", "std")), F.lit(0.0))
        return F.greatest(F.lit(0.0), 1 - F.sqrt(total) / 2)

    def near(name):
        return 1 - F.abs(c(a, name) - c(b, name))

    most = F.greatest(c(a, "item_count"), c(b, "item_count"))
    count = F.when(most > 0, 1 - F.abs(c(a, "item_count") - c(b, "item_count")) / most).otherwise(1.0)
    parts = {"kinds": kinds, "priority": stats("priority"), "recency": stats("recency"), "tokens": near("token_utilization"), "count": count, "stale": near("staleness_ratio"), "redundancy": near("redundancy")}
    return sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))


def remember(antibodies: DataFrame, failures: DataFrame, most: int = 100) -> DataFrame:
    """antibodies(id, pattern, symptom, diagnosis, severity, created) with new failures added; the newest `most` stay."""
    new = failures.withColumns({"diagnosis": F.coalesce("diagnosis", F.lit("Unknown cause")), "severity": F.coalesce("severity", F.lit("warning"))})
    rows = antibodies.unionByName(new.select(*antibodies.columns))
    return rows.orderBy(F.desc("created"), F.desc("id")).limit(most)


def screen(patterns: DataFrame, antibodies: DataFrame, threshold: float = 0.7, most: int = 100) -> DataFrame:
    """(pack_id, antibody, similarity, severity) of all antibodies that a pack is like. At most `most` antibodies exist, so they are broadcast."""
    packs = patterns.select("pack_id", F.struct(*[x for x in patterns.columns if x != "pack_id"]).alias("p"))
    known = F.broadcast(antibodies.select(F.col("id").alias("antibody"), F.col("pattern").alias("q"), "severity").limit(most))
    return packs.join(known).select("pack_id", "antibody", similarity("p", "q").alias("similarity"), "severity").where(F.col("similarity") >= threshold)


def safe(packs: DataFrame, alerts: DataFrame) -> DataFrame:
    """(pack_id, safe, warnings, blocked) of every pack."""
    n = alerts.groupBy("pack_id").agg(F.count_if(F.col("severity") != "block").alias("warnings"), F.count_if(F.col("severity") == "block").alias("blocked"))
    out = packs.select("pack_id").join(n, "pack_id", "left").na.fill(0, ["warnings", "blocked"])
    return out.select("pack_id", (F.col("blocked") == 0).alias("safe"), "warnings", "blocked")
