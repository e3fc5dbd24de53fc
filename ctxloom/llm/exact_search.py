"""Exact top-k inner products by columnar branch and bound.

Vectors are dealt by hash into blocks of bounded size, and a block is stored dimension by
dimension, those that carry most of its mass first. A cell is one block of queries against one
block of candidates: it adds up the inner products a few dimensions at a time for all
candidates, and after each step keeps only those whose partial product plus the most that the
remaining dimensions can add (remaining length of the query times that of the candidate) still
reaches the k-th best score known. Survivors are compacted, so later dimensions are read for
fewer and fewer of them.

The blocks are searched in rounds of growing numbers; each round starts from the k-th scores
that the rounds before have found, so later cells return next to nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import expand, materialize, release

#: Candidates and queries of a block, about.
BLOCK = 16384
QUERIES = 2048
#: Dimensions that a step adds, queries that are held against a block at once, and by how much the rounds grow.
STEP = 16
BATCH = 128
GROWTH = 4
_KINDS = (np.int16, np.int32, np.float64)


def _pack(table: pa.Table, vertical: bool) -> tuple:
    """(dims, n, kind, order, data, ids, counts) of a block's rows (dims, vector, vec_id, m)."""
    dims = table.column("dims")[0].as_py()
    flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    values = flat.reshape(table.num_rows, dims)
    top = np.abs(values).max(initial=0)
    kind = 0 if top < 2**15 else 1 if top < 2**31 else 2
    order = np.argsort(-np.square(values).sum(axis=0), kind="stable").astype(np.int32) if vertical else np.arange(dims, dtype=np.int32)
    data = values[:, order].T if vertical else values
    counts = table.column("m").to_numpy().astype(np.int64)
    return dims, table.num_rows, kind, order.tobytes(), np.ascontiguousarray(data).astype(_KINDS[kind]).tobytes(), table.column("vec_id").to_pylist(), counts.tobytes()


_PACKED = "dims long, block long, n long, kind int, dim_order binary, data binary, ids array<long>, counts binary"


def _packer(vertical: bool):
    def run(key, table):
        dims, n, kind, order, data, ids, counts = _pack(table, vertical)
        return pa.table(
            [pa.array([dims]), pa.array([key[1].as_py()]), pa.array([n]), pa.array([kind], pa.int32()), pa.array([order], pa.binary()), pa.array([data], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.binary())],
            ["dims", "block", "n", "kind", "dim_order", "data", "ids", "counts"],
        )

    return run


def _rest(values: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Lengths of what lies beyond each cut; values[dims, n]."""
    squares = np.square(values.astype(np.float64))
    return np.sqrt(np.stack([squares[c:].sum(axis=0) for c in cuts]))


def survivors(block: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int, step: int = STEP):
    """For each query: (positions, scores) of the candidates that may be among its k best of the block and reach `least`.

    block[dims, n] and queries[dims, q] hold integers in the same order of dimensions; the
    result holds every candidate of at least the k-th best score that reaches `least`, ties included.
    """
    dims, n = block.shape
    top = float(np.abs(block).max(initial=0)) * float(np.abs(queries).max(initial=0)) * dims
    if top >= 2**53:  # beyond exact doubles: Python's integers, each candidate in full
        whole = [[int(x) for x in row] for row in block.T]
        for i in range(queries.shape[1]):
            q = [int(x) for x in queries[:, i]]
            yield np.arange(n), np.array([sum(a * b for a, b in zip(q, row, strict=True)) for row in whole], object)
        return
    exact = np.float32 if top < 2**24 else np.float64
    block, queries = block.astype(exact), queries.astype(exact)
    cuts = [*range(min(step, dims), dims, step), dims]
    beyond, own = _rest(block, cuts), _rest(queries, cuts)
    slack = 1 + 1e-9
    for begin in range(0, queries.shape[1], BATCH):
        q = queries[:, begin : begin + BATCH]
        first = q[: cuts[0]].T @ block[: cuts[0]]
        bound = least[begin : begin + BATCH].copy()
        if n > k:
            # the exact scores of those that lead after one step: their k-th is a bound from below
            lead = min(n, 8 * k)
            ahead = np.argpartition(first, n - lead, axis=1)[:, n - lead :]
            for i in range(q.shape[1]):
                known = np.sort(q[:, i] @ block[:, ahead[i]])
                bound[i] = max(bound[i], known[-k])
        open_ = first + (own[0, begin : begin + BATCH][:, None] * beyond[0]) * slack >= bound[:, None]
        for i in range(q.shape[1]):
            at = np.flatnonzero(open_[i])
            score = first[i, at]
            for j in range(1, len(cuts)):
                if not len(at):
                    break
                score = score + q[cuts[j - 1] : cuts[j], i] @ block[cuts[j - 1] : cuts[j], at]
                stay = score + (own[j, begin + i] * beyond[j, at]) * slack >= bound[i]
                at, score = at[stay], score[stay]
            yield at, score.astype(np.int64)


def _unpacked(row: dict, dims: int, vertical: bool) -> np.ndarray:
    values = np.frombuffer(row["data"], _KINDS[row["kind"]])
    return values.reshape(dims, row["n"]) if vertical else values.reshape(row["n"], dims).T


_HITS = "dims long, block long, at int, query_id long, copies long, score long, vec_id long, m long"


def _cell(k: int):
    def run(key, asked, given):
        out: list[list] = [[] for _ in range(8)]
        if asked.num_rows and given.num_rows:
            q, c = asked.to_pylist()[0], given.to_pylist()[0]
            dims = q["dims"]
            order = np.frombuffer(c["dim_order"], np.int32)
            block, plain = _unpacked(c, dims, True), _unpacked(q, dims, False)
            queries = plain[order]
            copies, counts = np.frombuffer(q["counts"], np.int64), np.frombuffer(c["counts"], np.int64)
            least = np.full(q["n"], -np.inf)
            for x in q["least"] or ():
                least[x["at"]] = x["score"]
            empty = np.array([x is None for x in c["ids"]], bool)
            ids = np.array([0 if x is None else x for x in c["ids"]], np.int64)
            # one more than k, as the query's own row may be among them
            for i, (at, score) in enumerate(survivors(block, queries, least, k + 1)):
                m, mine = counts[at].copy(), np.flatnonzero((ids[at] == q["ids"][i]) & ~empty[at])
                for j in mine:
                    if np.array_equal(block[:, at[j]], queries[:, i]):
                        m[j] -= 1
                left = np.flatnonzero(m > 0)
                if len(left) > 8 * k:  # all that tie with the k-th stay for the order by id
                    least_kept = np.partition(score[left], len(left) - k)[len(left) - k]
                    left = left[score[left] >= least_kept]
                best = sorted(left, key=lambda j: (-score[j], empty[at[j]], ids[at[j]]))
                taken = 0
                for j in best:
                    if taken >= k:
                        break
                    taken += m[j]
                    for column, value in zip(out, (dims, q["block"], i, q["ids"][i], int(copies[i]), int(score[j]), c["ids"][at[j]], int(m[j])), strict=True):
                        column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5]
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], [x.split()[0] for x in _HITS.split(", ")])

    return run


def top_inner_products(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest integer inner product for each query.

    vectors(vec_id, embedding); each component x counts as floor(scale * x). Queries are the rows
    whose vec_id `every` divides; candidates are all rows but the query's own, ties go to the
    smaller vec_id, null ids last. Vectors that are null or hold null or non-finite components
    take no part; vectors of different lengths are not compared; all products of empty ones are
    0. A repeated row is a candidate of its own for each of its copies, the other copies of the
    query's own row included, and a repeated query gives its result for each copy. Scores that no
    long can hold raise an error. An empty table gives no rows; other columns are not carried.
    """
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))

    def whole(x):
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y) + 0.0

    rows = vectors.where(F.col("embedding").isNotNull() & ~broken).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("vector"))
    kinds = materialize(rows.groupBy("vector", "vec_id").agg(F.count("*").alias("m")).withColumn("dims", F.size("vector").cast("long")), "vectors")
    # of equal vectors only those of the k + 1 least ids can be in a result; Spark cuts each task's share before it moves
    least = F.row_number().over(W.partitionBy("dims", "vector").orderBy(F.col("vec_id").asc_nulls_last()))
    few = kinds.withColumn("_nth", least).where(F.col("_nth") <= k + 1).drop("_nth")
    few = materialize(few.select("dims", "vector", "vec_id", "m"), "candidates")
    asked = kinds.where(F.col("vec_id") % every == 0).select("dims", "vector", "vec_id", "m")
    blocks, parts = max(1, math.ceil(few.count() / BLOCK)), max(1, math.ceil(asked.count() / QUERIES))
    block = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("long")
    given = materialize(few.withColumn("block", block(blocks, "vector")).groupBy("dims", "block").applyInArrow(_packer(True), _PACKED), "blocks")
    queries = materialize(asked.withColumn("block", block(parts, "vector", "vec_id")).groupBy("dims", "block").applyInArrow(_packer(False), _PACKED), "queries")

    query = ["dims", "block", "at"]
    best = W.partitionBy(*query).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    hits, begin, size = None, 0, 1
    while begin < blocks:
        end = min(blocks, begin + size)
        if hits is None:
            known = queries.withColumn("least", F.lit(None).cast("array<struct<at:int,score:long>>"))
        else:
            lows = hits.groupBy(*query).agg(F.min("score").alias("score"), F.count("*").alias("found")).where(F.col("found") == k)
            known = queries.join(lows.groupBy("dims", "block").agg(F.collect_list(F.struct("at", "score")).alias("least")), ["dims", "block"], "left")
        left = known.withColumn("other", F.explode(F.sequence(F.lit(begin).cast("long"), F.lit(end - 1).cast("long"))))
        right = given.where((F.col("block") >= begin) & (F.col("block") < end)).withColumnRenamed("block", "other")
        right = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        cell = ["dims", "block", "other"]
        found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell(k), _HITS)
        if hits is not None:
            found = found.unionByName(hits)
        last, hits = hits, materialize(found.withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= k).drop("_nth"), "hits")
        if last is not None:
            release(last)
        begin, size = end, size * GROWTH
    release(kinds, few, given, queries)

    before = best.rowsBetween(W.unboundedPreceding, -1)
    placed = hits.withColumn("_from", F.coalesce(F.sum("m").over(before), F.lit(0))).where(F.col("_from") < k)
    ranked = placed.withColumn("rank", F.explode(F.sequence(F.col("_from") + 1, F.least(F.col("_from") + F.col("m"), F.lit(k)))))
    most = hits.agg(F.max("copies")).first()[0] or 0
    return expand(ranked, "copies", most).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same rows in SQL, for vec_ids that do not repeat.
SQL = """with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5"""
