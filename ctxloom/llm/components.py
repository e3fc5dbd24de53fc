"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Every node sends its larger (large) or its other smaller (small) neighbours to the least one."""
    out = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        out = out.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        out = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # the least neighbour is found by a partial aggregate, so a node of many edges is no burden
    least = out.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = out.join(least, "u")
    moved = joined.where("v > u") if large else joined.where("v <> m")
    sent = moved.select(F.col("m").alias("a"), F.col("v").alias("b"))
    if not large:
        sent = sent.unionByName(least.where("u <> m").select(F.col("m").alias("a"), F.col("u").alias("b")))
    return sent.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component is the least node reachable.

    edges(a, b). The edges stay distributed; each round is written to the shared folder.
    """
    now = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        last, now = now, materialize(_star(_star(now, True), False), "edges")
        release(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    named = now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(
        now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
    out = materialize(named, "components")
    release(now)
    return out
