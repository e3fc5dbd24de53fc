"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every row of a source is wanted `target / source size` times. The whole part is taken
outright. The fractional parts are rounded in pairs: mass (fraction times size) moves at
random from one row to the other until one of them is integral, with odds that keep each
row's expectation. The pair's total never changes, so a source ends within one row of its
target. Pairs form inside chunks of bounded size; each chunk leaves one unsettled row, and
these meet in a reduction tree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import expand, global_rank, materialize, n_words

CHUNK = 64


def source_targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code point order, null last, get the weights in turn. `share` times all sizes is
    split by weight; a target stops at `cap` times its source, and the excess goes to the others
    by weight, until none is above. Each round of that is one sum over the sources; sources are
    ranked by a distributed sort, so their number is free.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = global_rank(by, [F.col("source").asc_nulls_last()], "_k")
    given = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("_w", F.get(given, F.pmod("_k", F.lit(len(weights)))))
    full = F.col("source_size") * F.lit(float(cap))
    level = math.inf
    while True:
        # the common level of the sources that it does not fill; it rises as the filled ones leave
        open_ = ~(full < F.lit(level) * F.col("_w")) if level < math.inf else F.lit(True)
        total, filled, weight = ranked.agg(F.sum("source_size"), F.sum(F.when(~open_, full)), F.sum(F.when(open_, F.col("_w")))).first()
        new = (share * (total or 0) - (filled or 0.0)) / weight if weight else math.inf
        if new == level or not weight:
            break
        level = new
    target = F.least(full, F.lit(level) * F.col("_w")) if level < math.inf else full
    return ranked.select("source", "source_size", target.alias("target"))


def _uniform(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _round_chunk(rows: Column, seed: int) -> Column:
    """Fold an array of units; `out` holds the settled ones, `held` the one whose mass is still between."""

    def unit(u, **new):
        return F.struct(*[new.get(c, u[c]).alias(c) for c in ("h", "doc_id", "size", "whole", "mass", "copies")])

    def step(acc, u):
        c = acc["held"]
        both = c["mass"] + u["mass"]
        size_c, size_u = c["size"].cast("double"), u["size"].cast("double")
        most, least = F.least(size_c, both), both - F.least(size_u, both)
        odds = F.when(most > least, (c["mass"] - least) / (most - least)).otherwise(1.0)
        toward = _uniform(c["h"], u["h"], F.lit(seed)) < odds
        zero = F.lit(0.0)
        paired = (
            F.when(toward & (both >= size_c), F.struct(unit(c, copies=c["whole"] + 1).alias("done"), unit(u, mass=both - size_c).alias("held")))
            .when(toward, F.struct(unit(u, copies=u["whole"], mass=zero).alias("done"), unit(c, mass=both).alias("held")))
            .when(both >= size_u, F.struct(unit(u, copies=u["whole"] + 1).alias("done"), unit(c, mass=both - size_u).alias("held")))
            .otherwise(F.struct(unit(c, copies=c["whole"], mass=zero).alias("done"), unit(u, mass=both).alias("held")))
        )
        return F.transform(
            F.array(paired), lambda p: F.struct(F.concat(acc["out"], F.array(p["done"])).alias("out"), p["held"].alias("held"))
        )[0]

    return F.transform(
        F.array(rows),
        lambda r: F.aggregate(
            F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))),
            F.struct(F.slice(r, 1, 0).alias("out"), r[0].alias("held")),
            step,
        ),
    )[0]


def pivotal_copies(units: DataFrame, seed: int = 7) -> DataFrame:
    """Whole numbers of copies for units (source, doc_id, size, source_size, target).

    Adds `copies`. Deterministic: the same rows give the same copies in any order and
    partitioning. A source of a third of all rows is many chunks, like any other. Of m equal
    rows of fraction f, rounding among themselves settles all but one: floor(m * f) go up, one
    keeps the rest of the fraction, the others go down; so they are counted, not dealt.
    """
    equal = materialize(units.groupBy(*units.columns).agg(F.count("*").alias("_m")), "equal")
    most = equal.agg(F.max("_m")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = equal.withColumn("_whole", F.floor(rate).cast("long")).withColumn("_f", rate - F.floor(rate))
    base = base.withColumn("_up", F.floor(F.col("_m") * F.col("_f")).cast("long")).withColumn("_rest", F.col("_m") * F.col("_f") - F.floor(F.col("_m") * F.col("_f")))
    # a row without size has no mass to give or take: its copies count for nothing
    base = base.withColumn("_mass", F.col("_rest") * F.col("size"))
    sure = base.withColumn("_sure", F.col("_m") - (F.col("_mass") > 0).cast("long")).where("_sure > 0")
    settled = expand(sure, "_sure", most).select("source", "doc_id", "size", (F.col("_whole") + (F.col("_nth") < F.col("_up")).cast("long")).alias("copies"))
    open_ = base.where(F.col("_mass") > 0)
    per_source = open_.groupBy("source").agg(F.ceil(F.count("*") / F.lit(CHUNK * 3 // 4)).cast("long").alias("_chunks"))
    largest = per_source.agg(F.max("_chunks")).first()[0] or 1
    h = F.xxhash64("source", "doc_id", "size", F.lit(seed))
    level = open_.join(per_source.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        "source",
        F.pmod(h, F.col("_chunks")).alias("chunk"),
        F.struct(h.alias("h"), "doc_id", "size", F.col("_whole").alias("whole"), F.col("_mass").alias("mass"), F.lit(None).cast("long").alias("copies")).alias("u"),
    )
    parts, depth = [settled], 0
    while True:
        folded = level.groupBy("source", "chunk").agg(F.array_sort(F.collect_list("u")).alias("r"))
        folded = folded.select("source", "chunk", _round_chunk(F.col("r"), seed + depth).alias("f"))
        if largest > 1:
            folded = materialize(folded, "pivotal")
        parts.append(folded.select("source", F.explode("f.out").alias("u")).select("source", "u.doc_id", "u.size", "u.copies"))
        if largest <= 1:
            break
        level = folded.select("source", F.floor(F.col("chunk") / CHUNK).alias("chunk"), F.col("f.held").alias("u"))
        largest = math.ceil(largest / CHUNK)
        depth += 1
    last = F.col("f.held")
    drawn = last["whole"] + (_uniform(last["h"], F.lit(seed - 1)) < last["mass"] / last["size"]).cast("long")
    parts.append(folded.select("source", F.col("f.held.doc_id"), F.col("f.held.size"), drawn.alias("copies")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs(doc_id, text, source).

    size is the number of words (null text: 0). A row without words takes part with size 0.
    Repeated rows are rounded one by one; a null source is a source of its own, the last;
    an empty table gives no rows. Other columns are not carried.
    """
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    targets = source_targets(sized, list(weights), share, cap)
    t = targets.select(F.col("source").alias("_source"), "source_size", "target")
    units = sized.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    copies = pivotal_copies(units, seed)
    out = copies.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it (0, 1, 2, ... times), columns unchanged.

    Rows equal in doc_id, source and text act as one unit of their joint size. Null texts have
    size 0; a null source is a source of its own, the last; an empty table gives no rows.
    Columns of any name stay as they are.
    """
    key = F.xxhash64("doc_id", "source", "text")
    sized = docs.select(key.alias("doc_id"), "source", n_words(F.col("text")).alias("size"))
    units = materialize(sized.groupBy("doc_id", "source").agg(F.sum("size").alias("size")), "sizes")
    weights, share, cap, seed = (options.get(k, v) for k, v in (("weights", (5, 2, 1)), ("share", 1.5), ("cap", 2.0), ("seed", 7)))
    t = source_targets(units, list(weights), share, cap).select(F.col("source").alias("_source"), "source_size", "target")
    copies = pivotal_copies(units.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), seed)
    # by key alone: copies are made after the join, so a text moves once
    times = copies.where("copies > 0").select(F.col("doc_id").alias("key"), "copies")
    joined = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key")).join(times, "key")
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
