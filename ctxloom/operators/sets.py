"""Differences, merges and versions of item sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def diff(before: DataFrame, after: DataFrame, key: str, values: list[str], order: str) -> DataFrame:
    """(key, nth, change): multiset difference; equal keys are paired by their position among each other."""
    nth = F.row_number().over(W.partitionBy(key).orderBy(order)).cast("long")

    def side(d, name):
        return d.withColumn("nth", nth).select(key, "nth", F.struct(*values).alias(name))

    both = side(before, "old").join(side(after, "new"), [key, "nth"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "kept").otherwise("changed")
    return both.withColumn("change", change)


def merge(ours: DataFrame, theirs: DataFrame, key: str, how: str) -> DataFrame:
    """One row per key. union: the more recent of a conflict; priority: the higher priority; intersection: ours of the common keys. Ties are ours."""
    if how == "intersection":
        return ours.join(theirs.select(key), key, "left_semi")
    cols = [c for c in ours.columns if c != key]
    a, b = ours.select(key, F.struct(*cols).alias("a")), theirs.select(key, F.struct(*cols).alias("b"))
    by = {"union": "recency", "priority": "priority"}[how]
    zero = F.lit(0.0)
    theirs_wins = F.col("a").isNull() | (F.coalesce(F.col(f"b.{by}"), zero) > F.coalesce(F.col(f"a.{by}"), zero))
    both = a.join(b, key, "full_outer").withColumn("m", F.when(theirs_wins & F.col("b").isNotNull(), F.col("b")).otherwise(F.col("a")))
    return both.select(key, "m.*")


def merge_best(ours: DataFrame, theirs: DataFrame, ours_quality: DataFrame, theirs_quality: DataFrame, group: str, dimension: str = "overall") -> DataFrame:
    """Per group the whole side of the better quality (for redundancy the lower one); a tie is ours. The qualities are one row a group."""
    sign = -1.0 if dimension == "redundancy" else 1.0
    a, b = (q.select(group, (F.coalesce(F.col(dimension), F.lit(0.0)) * sign).alias(n)) for q, n in ((ours_quality, "_a"), (theirs_quality, "_b")))
    won = a.join(b, group, "full_outer").select(group, F.coalesce(F.col("_b") > F.col("_a"), F.col("_a").isNull()).alias("_theirs"))
    return ours.join(won.where("not _theirs").select(group), group, "left_semi").unionByName(theirs.join(won.where("_theirs").select(group), group, "left_semi"))


def merge_removed(ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """(key, side): what an intersection leaves out, of either side."""
    return ours.join(theirs.select(key), key, "left_anti").select(key, F.lit("ours").alias("side")).unionByName(theirs.join(ours.select(key), key, "left_anti").select(key, F.lit("theirs").alias("side")))


def item_diff(a: DataFrame, b: DataFrame, group: str, key: str) -> DataFrame:
    """(group, only_in_a, only_in_b, shared): numbers of different keys."""
    x, y = (d.select(group, key).distinct().withColumn(n, F.lit(1)) for d, n in ((a, "_a"), (b, "_b")))
    both = x.join(y, [group, key], "full_outer")
    return both.groupBy(group).agg(
        F.count_if(F.col("_b").isNull()).alias("only_in_a"), F.count_if(F.col("_a").isNull()).alias("only_in_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared")
    )


def insights(diffs: DataFrame) -> DataFrame:
    """(group columns, insight) from item_diff() with quality_a, quality_b, redundancy_a, redundancy_b, utilization_a and utilization_b."""
    better_b, better_a = F.col("quality_b") > F.col("quality_a"), F.col("quality_a") > F.col("quality_b")
    extra = F.col("only_in_b") > 0
    rules = [
        (better_b & extra, "additional-items-helped"), (better_a & extra, "additional-items-are-noise"), (F.abs(F.col("redundancy_a") - F.col("redundancy_b")) > 0.1, "redundancy-differs"),
        (F.abs(F.col("utilization_a") - F.col("utilization_b")) > 0.2, "utilization-differs"), ((F.col("shared") == 0) & (F.col("only_in_a") + F.col("only_in_b") > 0), "nothing-shared"),
        ((F.col("only_in_a") + F.col("only_in_b") == 0) & (F.col("shared") > 0), "identical-items"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))
    return diffs.withColumn("insight", F.explode(found))


def replay(recorded: DataFrame, rows: DataFrame, variants: dict[str, int]) -> DataFrame:
    """One row a variant (name: budget): rows packed again under it against the packs recorded(pack_id, id, tokens, budget, ...) under their own.

    (variant, avg_token_delta, avg_utilization, recordings_affected) over the packs that select anything either way.
    """
    from .packing import greedy

    before = greedy(recorded, ["pack_id"]).where("chosen").select("pack_id", "id", F.col("tokens").alias("_t"))
    pairs = F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(b).cast("long").alias("budget")) for n, b in variants.items()])
    again = greedy(rows.drop("budget").withColumn("_v", F.explode(pairs)).select("*", "_v.variant", "_v.budget").drop("_v"), ["variant", "pack_id"]).where("chosen")
    after = again.select("variant", "pack_id", "id", "budget", F.col("tokens").alias("_u"))
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(b).cast("long").alias("_b")) for n, b in variants.items()])).alias("_n")
    old = before.select("*", names).select("pack_id", "id", "_t", "_n.variant", "_n._b")
    both = old.join(after, ["variant", "pack_id", "id"], "full_outer")
    per = both.groupBy("variant", "pack_id").agg(
        (F.coalesce(F.sum("_u"), F.lit(0)) - F.coalesce(F.sum("_t"), F.lit(0))).alias("delta"), (F.coalesce(F.sum("_u"), F.lit(0)) / F.max(F.coalesce("budget", "_b")) * 100).alias("use"),
        F.count_if(F.col("_t").isNull() | F.col("_u").isNull()).alias("moved"),
    )
    def two(x):
        return F.floor(x * 100 + 0.5) / 100.0

    return per.groupBy("variant").agg(two(F.avg("delta")).alias("avg_token_delta"), two(F.avg("use")).alias("avg_utilization"), F.count_if(F.col("moved") > 0).alias("recordings_affected"))


class Timeline:
    """Snapshots of item sets on branches, as two tables that only grow and a small state on the driver.

    Snapshots(id, name, branch, parent, seq) and their items are DataFrames under one folder:
    every snapshot is a partition written once, so a rewind or a fork copies no items.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path
        self.snapshots: list[dict] = []
        self.heads: dict[str, str | None] = {"main": None}
        self.forks: dict[str, str | None] = {}
        self.branch = "main"

    def _add(self, name: str, where: str, parent: str | None) -> str:
        snap = {"id": f"s{len(self.snapshots) + 1}", "name": name, "branch": self.branch, "parent": parent, "where": where}
        self.snapshots.append(snap)
        self.heads[self.branch] = snap["id"]
        return snap["id"]

    def _find(self, name: str, branch: str | None = None) -> dict:
        for s in reversed(self.snapshots):
            if name in (s["id"], s["name"]) and branch in (None, s["branch"]):
                return s
        raise ValueError(f"no snapshot {name}" + (f" on {branch}" if branch else ""))

    def checkpoint(self, name: str, items: DataFrame) -> str:
        where = f"{self.path}/s{len(self.snapshots) + 1}"
        items.write.parquet(where)
        return self._add(name, where, self.heads[self.branch])

    def items(self, name: str | None = None) -> DataFrame:
        """The items of a snapshot, by default the branch's head."""
        snap = self._find(name or self.heads[self.branch])
        return self.spark.read.parquet(snap["where"])

    def rewind(self, name: str) -> None:
        self.heads[self.branch] = self._find(name, self.branch)["id"]

    def fork(self, branch: str, name: str | None = None) -> None:
        if branch in self.heads:
            raise ValueError(f"branch {branch} exists")
        source = self._find(name or self.heads[self.branch])
        self.branch = branch
        self.forks[branch] = source["id"]
        self._add(f"fork:{branch}", source["where"], source["id"])

    def checkout(self, branch: str) -> None:
        if branch not in self.heads:
            raise ValueError(f"no branch {branch}")
        self.branch = branch

    def history(self, branch: str | None = None) -> list[dict]:
        """The snapshots of a branch, in order."""
        return [s for s in self.snapshots if s["branch"] == (branch or self.branch)]

    def export(self) -> dict:
        return {"snapshots": self.snapshots, "heads": self.heads, "forks": self.forks, "branch": self.branch}

    def restore(self, state: dict) -> None:
        self.snapshots, self.heads, self.forks, self.branch = list(state["snapshots"]), dict(state["heads"]), dict(state["forks"]), state["branch"]


def upsert(existing: DataFrame, updates: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row per key: updates over existing rows, later over earlier; `first_at` keeps the key's first place."""
    rows = existing.withColumn("_u", F.lit(0)).unionByName(updates.withColumn("_u", F.lit(1)))
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*existing.columns), F.struct("_u", order)).alias("r"), F.min(F.struct("_u", order)).alias("first_at"))
    return latest.select("r.*", F.col("first_at._u").alias("added_by_update"))


def session_delta(manifest: DataFrame) -> DataFrame:
    """Per (session, step >= 2) of manifest(session, step, pos, id, content_hash, tokens): changes against the step before.

    The reusable prefix is the run of equal leading positions; its tokens over the earlier
    step's tokens is the reuse ratio.
    """
    now = manifest.alias("n")
    prev = manifest.withColumn("step", F.col("step") + 1).alias("p")
    by_id = now.join(prev, ["session", "step", "id"], "full_outer")
    state = F.when(F.col("p.pos").isNull(), "added").when(F.col("n.pos").isNull(), "removed").when(F.col("n.content_hash") == F.col("p.content_hash"), "kept").otherwise("changed")
    counts = by_id.withColumn("state", state).withColumn("t", F.coalesce("n.tokens", "p.tokens")).groupBy("session", "step").agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in ("added", "removed", "changed", "kept")],
        F.coalesce(F.sum(F.when(F.col("state") != "kept", F.col("t"))), F.lit(0)).alias("delta_tokens"),
        F.count("n.pos").alias("_now"), F.count("p.pos").alias("_prev"),
        F.coalesce(F.sum("p.tokens"), F.lit(0)).alias("prev_tokens"),
    )
    by_pos = prev.join(now, ["session", "step", "pos"], "left").select("session", "step", "pos", F.col("p.tokens").alias("t"), ((F.col("p.id") == F.col("n.id")) & (F.col("p.content_hash") == F.col("n.content_hash"))).alias("same"))
    end = F.min(F.when(~F.coalesce("same", F.lit(False)), F.col("pos"))).over(W.partitionBy("session", "step"))
    reused = by_pos.withColumn("_end", end).groupBy("session", "step").agg(F.coalesce(F.sum(F.when(F.col("_end").isNull() | (F.col("pos") < F.col("_end")), F.col("t"))), F.lit(0)).alias("reusable_tokens"))
    out = counts.where("_now > 0 and _prev > 0").join(reused, ["session", "step"]).drop("_now", "_prev")
    return out.withColumn("reuse_ratio", F.when(F.col("prev_tokens") > 0, F.floor(F.col("reusable_tokens") / F.col("prev_tokens") * 1000 + 0.5) / 1000.0).otherwise(0.0))


def compare(before: DataFrame, after: DataFrame, key: str, values: list[str], order: str) -> DataFrame:
    """One row: how many items only the first set has, only the second, both alike, both but changed."""
    names = {"removed": "only_in_1", "added": "only_in_2", "kept": "common", "changed": "modified"}
    changes = diff(before, after, key, values, order)
    return changes.agg(*[F.count_if(F.col("change") == c).alias(n) for c, n in names.items()])


def compare_branches(before: DataFrame, after: DataFrame, key: str, values: list[str], order: str) -> DataFrame:
    """compare() with the quality of each set, as quality.analyze() gives it, in columns quality_1 and quality_2 (null for an empty set)."""
    from .quality import analyze

    row = compare(before, after, key, values, order)
    for n, side in (("1", before), ("2", after)):
        whole = side.withColumn("pack_id", F.lit(0))
        measured = analyze(whole).agg(F.first(F.struct("density", "diversity", "freshness", "redundancy", "overall")).alias(f"quality_{n}"))
        row = row.crossJoin(F.broadcast(measured))  # one row each
    return row


def prune(snapshots: DataFrame, protected: DataFrame, most: int) -> DataFrame:
    """The snapshots(timeline, id, created) that stay: all protected ones (heads, fork points) and the newest others, `most` together."""
    held = snapshots.join(protected.select("timeline", "id").distinct().withColumn("_p", F.lit(True)), ["timeline", "id"], "left")
    held = held.withColumn("_p", F.coalesce("_p", F.lit(False)))
    n = F.count_if("_p").over(W.partitionBy("timeline"))
    nth = F.row_number().over(W.partitionBy("timeline", "_p").orderBy(F.desc("created"), F.desc("id")))
    return held.withColumn("_n", n).withColumn("_k", nth).where(F.col("_p") | (F.col("_k") <= F.lit(most) - F.col("_n"))).drop("_p", "_n", "_k")


def unique_ignoring_case(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The first of the group's rows for each value, letter case aside, in its own spelling."""
    return rows.groupBy(group, F.lower(value).alias("_v")).agg(F.min_by(value, order).alias(value), F.min(order).alias(order)).drop("_v")
