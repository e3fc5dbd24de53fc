"""The extended pack: supersession, parents, vectors and links, for all packs in rounds.

The next item that a pack takes is the one of highest score among those that fit what is left,
whose parent is not in and whose vector is not too near to one that is in; what an item that is in
adds to others changes their scores. Such items only ever become fewer. So a round takes the
`width` best of each pack and settles as many of them as no item outside could overtake: outside
items have at most the score of the next one, or, if they link to one that the round takes, what
all links into the round would add. A task sees `width` rows of a pack, whatever its size.

Why the others stay out follows from what the pack took before their turn, which all rows can
tell at once from the pack's list of taken items.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .packing import without_superseded
from .scratch import dropped, stored

#: Rows of a pack that a round looks at.
WIDTH = 1000
_TAKEN = "pack_id {kind}, nth int, id string, ord long, tokens long, at double, recency double, vector array<double>"


def unit(vector: Column) -> Column:
    """The vector at length 1; null stays null, zero stays zero, an empty one is null."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(F.size(vector) > 0, F.transform(vector, lambda x: F.when(length > 0, x / length).otherwise(0.0)))


def _near(a: Column, b: Column, limit: float) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return (F.size(a) == F.size(b)) & (dot > limit)


def _round(boost: float, redundancy: float | None):
    """One pack's best rows in; those that it takes for sure out, in their order."""

    def run(key, table):
        rows = table.to_pylist()
        ceiling = max((r["outside"] for r in rows if r["outside"] is not None), default=-np.inf)
        left = rows[0]["left"]
        heap = [(-r["score"], -r["recency"], r["ord"], i) for i, r in enumerate(rows)]
        heapq.heapify(heap)
        linked: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            for x in r["links"] or ():
                linked.setdefault(x, []).append(i)
        gain = [0] * len(rows)
        done, parents, vectors, taken = [False] * len(rows), set(), [], []
        while heap:
            score, _, _, i = heapq.heappop(heap)
            r = rows[i]
            if done[i] or -score != r["score"] + boost * gain[i]:
                continue
            # the first is the pack's best whatever is outside
            if taken and -score <= ceiling:
                break
            done[i] = True
            v = np.asarray(r["vector"]) if redundancy is not None and r["vector"] else None
            if r["tokens"] > left or r["parent"] in parents or (v is not None and any(len(x) == len(v) and float(x @ v) > redundancy for x in vectors)):
                continue
            left -= r["tokens"]
            taken.append((len(taken), r["id"], r["ord"], r["tokens"], -score, r["recency"], r["vector"]))
            parents.add(r["id"])
            if v is not None:
                vectors.append(v)
            if r["reach"] is not None:
                ceiling = max(ceiling, r["reach"])
            for j in linked.get(r["id"], ()):
                if not done[j]:
                    gain[j] += 1
                    heapq.heappush(heap, (-(rows[j]["score"] + boost * gain[j]), -rows[j]["recency"], rows[j]["ord"], j))
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
        columns = list(zip(*taken, strict=True)) or [()] * len(kinds)
        names = ["nth", "id", "ord", "tokens", "at", "recency", "vector"]
        return pa.table([pa.array([rows[0]["pack_id"]] * len(taken), table.schema.field("pack_id").type), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["pack_id", *names])

    return run


def taken_items(items: DataFrame, boost: float = 2.0, redundancy: float | None = None, width: int = WIDTH) -> DataFrame:
    """(pack_id, nth, id, ord, tokens, at, recency, vector): what each pack takes, in its order; `at` is the score with which it was taken."""
    kind = items.schema["pack_id"].dataType.simpleString()
    none = F.array().cast("array<string>")
    vector = unit(F.transform("embedding", lambda x: x.cast("double"))) if redundancy is not None else F.lit(None).cast("array<double>")
    open_ = without_superseded(items).where(F.col("tokens") <= F.col("budget")).select(
        "pack_id", F.col("id").cast("string").alias("id"), F.col("ord").cast("long").alias("ord"), F.col("tokens").cast("long").alias("tokens"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        F.coalesce(F.col("recency").cast("double"), F.lit(0.0)).alias("recency"), F.col("parent_id").cast("string").alias("parent"), F.array_distinct(F.array_compact(F.coalesce("links", none))).alias("links"),
        vector.alias("vector"), F.col("budget").cast("long").alias("left"),
    )
    open_ = stored(open_)
    by_turn = W.partitionBy("pack_id").orderBy(F.desc("score"), F.desc("recency"), "ord")
    done, frames, count = None, [], 0
    while True:
        best = open_.withColumn("_k", F.row_number().over(by_turn)).where(F.col("_k") <= width + 1)
        best = stored(best)
        if best.isEmpty():
            dropped(best, open_)
            break
        first = best.where(F.col("_k") <= width)
        next_ = best.where(F.col("_k") > width).select("pack_id", F.col("score").alias("outside"))
        # how high links into the round can lift those outside
        outer = open_.where(F.size("links") > 0).join(first.select("pack_id", "ord"), ["pack_id", "ord"], "left_anti")
        met = outer.select("pack_id", "ord", "score", F.explode("links").alias("id")).join(first.select("pack_id", "id"), ["pack_id", "id"])
        lifted = met.withColumn("_top", F.col("score") + boost * F.count("*").over(W.partitionBy("pack_id", "ord")))
        reach = lifted.groupBy("pack_id", "id").agg(F.max("_top").alias("reach"))
        seen = first.drop("_k").join(next_, "pack_id", "left").join(reach, ["pack_id", "id"], "left")
        new = seen.groupBy("pack_id").applyInArrow(_round(boost, redundancy), _TAKEN.format(kind=kind))
        new = stored(new.withColumn("nth", F.col("nth") + count))
        frames.append(new)
        count += width
        done = new if done is None else done.unionByName(new)
        sums = new.groupBy("pack_id").agg(F.sum("tokens").alias("_used"), F.collect_list("id").alias("_ids"), F.filter(F.collect_list("vector"), lambda v: v.isNotNull()).alias("_vectors"))
        joined = open_.join(new.select("pack_id", "ord"), ["pack_id", "ord"], "left_anti").join(sums, "pack_id")
        stays = (F.col("tokens") <= F.col("left") - F.col("_used")) & ~F.coalesce(F.array_contains("_ids", F.col("parent")), F.lit(False))
        if redundancy is not None:
            stays = stays & ~F.coalesce(F.exists("_vectors", lambda v: _near(v, F.col("vector"), redundancy)), F.lit(False))
        lift = F.size(F.array_intersect("links", "_ids")) * float(boost)
        rest = joined.where(stays).select("pack_id", "id", "ord", "tokens", (F.col("score") + lift).alias("score"), "recency", "parent", "links", "vector", (F.col("left") - F.col("_used")).alias("left"))
        last, open_ = open_, stored(rest)
        dropped(last, best)
    if done is None:
        return items.sparkSession.createDataFrame([], _TAKEN.format(kind=kind))
    out = stored(done)
    dropped(*frames)
    return out


def extended(items: DataFrame, boost: float = 2.0, redundancy: float | None = None, width: int = WIDTH) -> DataFrame:
    """items(pack_id, id, ord, tokens, score, recency, parent_id, links, embedding, budget, supersedes) with `decision`: include, or why not.

    Superseded items are out first. The others have their turn by score, recency and ord; one is
    left out if its parent is in, if its vector is nearer than `redundancy` to one that is in, or
    if it does not fit; each item that is in adds `boost` to the score of those that link to it.
    ids and ords are unique in a pack; null scores and recencies count 0; an empty table gives
    no rows. A pack's list of taken items, which its budget bounds unless items have no tokens,
    is held beside each of its rows; texts never move.
    """
    taken = taken_items(items, boost, redundancy, width)
    listed = taken.groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "ord", "at", "recency", "vector"))).alias("_taken"))
    alive = without_superseded(items).select("pack_id", "ord").withColumn("_a", F.lit(True))
    rows = items.join(alive, ["pack_id", "ord"], "left").join(listed, "pack_id", "left")
    score, recency, ord_ = F.coalesce(F.col("score").cast("double"), F.lit(0.0)), F.coalesce(F.col("recency").cast("double"), F.lit(0.0)), F.col("ord").cast("long")
    links, vector = F.coalesce("links", F.array().cast("array<string>")), unit(F.transform("embedding", lambda x: x.cast("double")))

    def before(acc, s):
        """What the pack had taken when the row had its turn: up to the first item that stands behind it."""
        at = score + acc["links"] * float(boost)
        sooner = (at > s["at"]) | ((at == s["at"]) & ((recency > s["recency"]) | ((recency == s["recency"]) & (ord_ < s["ord"]))))
        over = acc["over"] | sooner
        near = _near(s["vector"], F.col("_v"), redundancy) if redundancy is not None else F.lit(False)
        return F.when(over, F.struct(F.lit(True).alias("over"), acc["links"].alias("links"), acc["parent"].alias("parent"), acc["near"].alias("near"))).otherwise(
            F.struct(
                F.lit(False).alias("over"), (acc["links"] + F.when(F.array_contains(links, s["id"]), 1).otherwise(0)).alias("links"),
                (acc["parent"] | F.coalesce(s["id"] == F.col("parent_id").cast("string"), F.lit(False))).alias("parent"), (acc["near"] | F.coalesce(near, F.lit(False))).alias("near"),
            )
        )

    start = F.struct(F.lit(False).alias("over"), F.lit(0).alias("links"), F.lit(False).alias("parent"), F.lit(False).alias("near"))
    seen = F.aggregate(F.coalesce("_taken", F.array().cast(listed.schema["_taken"].dataType)), start, before)
    judged = rows.withColumn("_v", vector).withColumn("_s", seen)
    why = F.when(F.col("_a").isNull(), "negated_by_newer_info").when(F.coalesce(F.exists("_taken", lambda s: s["ord"] == ord_), F.lit(False)), "include")
    why = why.when(F.col("_s.parent"), "parent_already_included").when(F.col("_s.near"), "semantic_redundancy").otherwise("over_budget")
    return judged.withColumn("decision", why).drop("_a", "_taken", "_v", "_s")
