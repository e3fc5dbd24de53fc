"""Depth of dependency graphs with cycles: strongly connected components, then level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, stored


def _grown(now: DataFrame, step) -> DataFrame:
    """step(now) until it changes nothing; step keeps `now`'s rows and may add `changed`."""
    while True:
        new = stored(step(now))
        moved = not new.where("changed").isEmpty()
        dropped(now)
        now = new
        if not moved:
            return now


def _core(edges: DataFrame) -> DataFrame:
    """The edges between nodes that have one in and one out, over and over: what is left lies on cycles or between them."""
    now = stored(edges)
    count = now.count()
    while count:
        inner = now.join(now.select(F.col("at").alias("node")).distinct(), "node", "left_semi").join(now.select(F.col("node").alias("at")).distinct(), "at", "left_semi")
        new = stored(inner.select("node", "at"))
        left = new.count()
        dropped(now)
        now = new
        if left == count:
            break
        count = left
    return now


def cycles(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that lie on a cycle of edges(node, at), by strongly connected components; component is one of its nodes.

    The node of largest hash that reaches a node colours it; of a colour, those nodes that reach
    the one that gave it are one component. They go, and what is left is coloured again, a number
    of times that grows with the logarithm of how many components stand above each other. A node
    with an edge to itself alone is a component too.
    """
    out = edges.where("node = at").select("node", F.col("node").alias("component")).distinct()
    left = _core(edges.where("node <> at").distinct())
    frames: list[DataFrame] = []
    while not left.isEmpty():
        nodes = left.select("node").unionByName(left.select(F.col("at").alias("node"))).distinct()

        def colour(now, left=left):
            came = left.join(now.select("node", "colour"), "node").groupBy(F.col("at").alias("node")).agg(F.max("colour").alias("c"))
            both = now.drop("changed").join(came, "node", "left")
            return both.select("node", F.greatest("colour", "c").alias("colour"), (F.coalesce(F.col("c") > F.col("colour"), F.lit(False))).alias("changed"))

        coloured = _grown(stored(nodes.select("node", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("id")).alias("colour"), F.lit(True).alias("changed"))), colour)
        a, b = coloured.select("node", "colour"), coloured.select(F.col("node").alias("at"), F.col("colour").alias("_c"))
        inner = stored(left.join(a, "node").join(b, "at").where("colour = _c").select("node", "at"))

        def back(now, inner=inner):
            new = inner.join(now.where("changed").select(F.col("node").alias("at"), "colour"), "at").select("node", "colour").distinct().join(now.select("node"), "node", "left_anti")
            return now.select("node", "colour", F.lit(False).alias("changed")).unionByName(new.withColumn("changed", F.lit(True)))

        found = _grown(stored(coloured.where("node = colour.id").select("node", "colour", F.lit(True).alias("changed"))), back)
        frames.append(found)
        gone = found.select("node")
        rest = left.join(gone, "node", "left_anti").join(gone.withColumnRenamed("node", "at"), "at", "left_anti").select("node", "at")
        last, left = left, _core(rest)
        dropped(last, coloured, inner)
    dropped(left)
    for f in frames:
        # a component of one node that was between cycles is none
        size = f.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour")
        out = out.unionByName(f.join(size, "colour", "left_semi").select("node", F.col("colour.id").alias("component")))
    # a node with an edge to itself belongs to the component that it shares with others, if any
    alone = F.col("component") == F.col("node")
    several = stored(out.groupBy("node").agg(F.coalesce(F.max(F.when(~alone, F.col("component"))), F.max("component")).alias("component")))
    dropped(*frames)
    return several


#: Paths of one step up to which what is on or above cycles is walked as one.
PATHS = 1_000_000


def depth(edges: DataFrame, nodes: DataFrame, most: int = PATHS, enough: int | None = None) -> DataFrame:
    """(node, depth): edges(node, needs) on the longest chain of dependencies from a node that visits no node twice, and the step back into a cycle.

    A dependency that is no node counts as one step. Nodes outside cycles are settled level by
    level, from those that need nothing upwards, without a cap. What is left, on cycles or above
    them, is walked at once, as long as no step has more than `most` paths. Where one has, strongly
    connected components are found, and each is settled when all that its nodes need outside of it
    is: only there paths are followed with the nodes visited, so the work is the number of simple
    paths inside single components, which is large in a dense one. Both ways give the same depths.

    A caller that does not tell depths from `enough` upwards apart gets any figure from there on for
    them: paths on cycles are then followed for so many steps only. Smaller depths are exact.
    """
    needs = stored(edges.select("node", F.col("needs").alias("at")).where("at is not null").distinct())
    every = nodes.select("node").unionByName(needs.select(F.col("at").alias("node"))).distinct()
    known = _Known(every.join(needs.select("node").distinct(), "node", "left_anti").select("node", F.lit(0).cast("long").alias("depth")))
    left = needs
    while True:
        step = left.join(known.frame().withColumnRenamed("node", "at"), "at", "left")
        ready = stored(step.groupBy("node").agg(F.max("depth").alias("d"), F.count_if(F.col("depth").isNull()).alias("open")).where("open = 0").select("node", (F.col("d") + 1).alias("depth")))
        if ready.isEmpty():
            dropped(ready)
            break
        left = _without(left, ready)
        known.add(ready)
    if not left.isEmpty():
        # what is left lies on cycles or above them
        open_ = left.join(known.frame().withColumnRenamed("node", "at"), "at", "left").withColumn("inner", F.col("depth").isNull())
        walked = _inside(open_, most, enough)
        if walked is not None:
            known.add(stored(walked))
            dropped(walked)
            last, left = left, stored(left.limit(0))
            dropped(last)
    if not left.isEmpty():
        own = stored(cycles(left))
        of = own.select(F.col("node").alias("at"), F.col("component").alias("_to"))
        on = left.join(own, "node", "left").join(of, "at", "left").withColumn("inner", F.coalesce(F.col("component") == F.col("_to"), F.lit(False)))
        last, left = left, stored(on.select("node", "at", "component", "inner"))
        dropped(last, own)
    while not left.isEmpty():
        step = stored(left.join(known.frame().withColumnRenamed("node", "at"), "at", "left"))
        # a component waits as one for what is outside of it, a plain node by itself
        unit = F.struct(F.col("component").alias("c"), F.when(F.col("component").isNull(), F.col("node")).alias("n"))
        free = step.groupBy(unit.alias("u")).agg(F.count_if(~F.col("inner") & F.col("depth").isNull()).alias("open")).where("open = 0").select("u.c", "u.n")
        free = stored(free)
        plain = step.join(free.where("c is null").select(F.col("n").alias("node")), "node", "left_semi").groupBy("node").agg((F.max("depth") + 1).alias("depth"))
        whole = step.join(free.where("c is not null").select(F.col("c").alias("component")), "component", "left_semi")
        new = stored(plain if whole.isEmpty() else plain.unionByName(_inside(whole, enough=enough)))
        left = _without(left, new)
        known.add(new)
        dropped(step, free)
    dropped(left)
    return nodes.select("node").distinct().join(known.frame(), "node").select("node", F.col("depth").cast("int").alias("depth"))


class _Known:
    """Settled nodes (node, depth), in files that are merged before they are many."""

    MOST = 8

    def __init__(self, first: DataFrame):
        self.frames = [stored(first)]

    def frame(self) -> DataFrame:
        out = self.frames[0]
        for f in self.frames[1:]:
            out = out.unionByName(f)
        return out

    def add(self, new: DataFrame) -> None:
        self.frames.append(new)
        if len(self.frames) > self.MOST:
            merged = stored(self.frame())
            dropped(*self.frames)
            self.frames = [merged]


def _without(rows: DataFrame, settled: DataFrame) -> DataFrame:
    """rows (stored) without those of settled nodes; its files go."""
    out = stored(rows.join(settled.select("node"), "node", "left_anti"))
    dropped(rows)
    return out


def _inside(edges: DataFrame, most: int | None = None, enough: int | None = None) -> DataFrame | None:
    """(node, depth) of the nodes of components whose edges(node, at, inner, depth of what is outside) are all here; None once a step has more than `most` paths. Paths of `enough` steps are followed no further."""
    inner = stored(edges.where("inner").select("node", "at"))
    exits = stored(edges.groupBy("node").agg(F.max(F.when(~F.col("inner"), F.col("depth") + 1)).alias("out")))
    paths = stored(exits.select("node", F.col("node").alias("here"), F.array("node").alias("seen"), F.lit(0).cast("long").alias("d")))
    found: DataFrame | None = None
    steps = 0
    while number := paths.count():
        if most is not None and number > most:
            dropped(inner, exits, paths, *([found] if found is not None else []))
            return None
        left = paths.join(exits.select(F.col("node").alias("here"), "out"), "here").select("node", (F.col("d") + F.coalesce("out", F.lit(0))).alias("depth"))
        on = stored(paths.join(inner.select(F.col("node").alias("here"), "at"), "here"))
        closed = on.where(F.array_contains("seen", F.col("at"))).select("node", (F.col("d") + 1).alias("depth"))
        gains = left.unionByName(closed) if found is None else left.unionByName(closed).unionByName(found)
        best = stored(gains.groupBy("node").agg(F.max("depth").alias("depth")))
        if found is not None:
            dropped(found)
        found = best
        steps += 1
        longer = ~F.array_contains("seen", F.col("at")) if enough is None or steps <= enough else F.lit(False)
        more = stored(on.where(longer).select("node", F.col("at").alias("here"), F.array_append("seen", F.col("at")).alias("seen"), (F.col("d") + 1).alias("d")))
        dropped(paths, on)
        paths = more
    dropped(inner, exits, paths)
    return found
