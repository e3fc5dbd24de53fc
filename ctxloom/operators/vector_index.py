"""Nearest vectors by an inverted file: lists around centroids, probed nearest first, ranked exactly.

The centroids are fitted on a bounded sample (SAMPLE rows) and bounded in number (LISTS), so they
go to every task; all rows are in the index. A list that grows is split into cells of about CELL
rows, and the queries that probe it into blocks, so no task holds a list. How many lists to probe
is measured: against all vectors, for a bounded number of queries.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import top, vector_top
from .scratch import stored

#: Rows that centroids are fitted on, centroids, and rows of a list that they aim at.
SAMPLE = 50_000
LISTS = 4096
LENGTH = 1000
#: Vectors and queries that meet in one task, about.
CELL = 8192
#: Queries that recall is measured on.
TRIED = 200


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n == 0, 1, n)


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column of one length, at length 1."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return _unit(flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dims))


def centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Directions of `lists` centres of unit vectors; an empty centre moves to a vector that is far from its own."""
    rng = np.random.default_rng(seed)
    sample = _unit(np.asarray(sample, float))
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        near = sample @ centres.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = sample[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        moved = _unit(sums)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


@dataclass
class Index:
    """Centroids, and rows (vec_id, list, part, embedding) of all vectors of their length that are not zero."""

    centres: np.ndarray
    rows: DataFrame
    parts: DataFrame
    probes: int = 1


def _lists(centres: np.ndarray, probes: int, name: str):
    """Adds `list`, one row for each of the `probes` nearest centres."""

    def run(batches):
        for b in batches:
            near = _matrix(b.column(name), centres.shape[1]) @ centres.T
            best = np.argpartition(-near, probes - 1, axis=1)[:, :probes] if probes < len(centres) else np.tile(np.arange(len(centres)), (len(near), 1))
            rows = np.repeat(np.arange(b.num_rows), best.shape[1])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(rows)) for c in b.schema.names), pa.array(best.reshape(-1).astype(np.int32))], [*b.schema.names, "list"])

    return run


def _usable(rows: DataFrame, name: str, dims: int) -> DataFrame:
    fine = (F.size(name) == dims) & F.exists(name, lambda x: x != 0) & ~F.exists(name, lambda x: x.isNull() | F.isnan(x.cast("double")))
    return rows.where(F.coalesce(fine, F.lit(False)))


def build(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 0) -> Index:
    """The index of vectors(vec_id, embedding), on disk in the shared folder.

    Vectors have the length that most have; null and zero vectors, those of another length and
    those with a null component are not in it. The sample is the `sample` rows of least hash of
    vec_id, so it is the same at each run.
    """
    sizes = vectors.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(1).collect()
    if not sizes:
        empty = vectors.limit(0).select("vec_id", F.lit(0).alias("list"), F.lit(0).alias("part"), "embedding")
        return Index(np.zeros((1, 1)), empty, empty.select("list", F.lit(1).alias("parts")))
    dims, n = sizes[0]
    known = _usable(vectors.select("vec_id", "embedding"), "embedding", dims)
    drawn = known.select("embedding", F.xxhash64("vec_id", F.lit(seed)).alias("_h")).orderBy("_h").limit(sample).select("embedding").toArrow()
    if not drawn.num_rows:
        return build(vectors.limit(0))
    wanted = lists or min(LISTS, max(1, math.ceil(n / LENGTH)), max(1, drawn.num_rows // 8))
    centres = centroids(_matrix(drawn.column(0), dims), wanted, seed=seed)
    schema = known.withColumn("list", F.lit(0)).schema
    listed = stored(known.mapInArrow(_lists(centres, 1, "embedding"), schema))
    parts = listed.groupBy("list").agg(F.ceil(F.count("*") / CELL).cast("int").alias("parts"))
    rows = listed.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    return Index(centres, rows.select("vec_id", "list", "part", "embedding"), stored(parts))


def _cell(k: int, dims: int):
    def run(key, asked, given):
        out = [[], [], []]
        if asked.num_rows and given.num_rows:
            q, v = _matrix(asked.column("query"), dims), _matrix(given.column("embedding"), dims)
            ids, own = given.column("vec_id").to_numpy(), asked.column("query_id").to_numpy()
            for begin in range(0, len(q), 256):
                score = np.floor(q[begin : begin + 256] @ v.T * 1e6 + 0.5) / 1e6
                for row, i in zip(score, own[begin : begin + 256], strict=True):
                    there = np.flatnonzero(ids != i)
                    if len(there) > k:  # ties with the k-th stay for the order by id
                        there = there[row[there] >= np.partition(row[there], len(there) - k)[len(there) - k]]
                    best = there[np.lexsort((ids[there], -row[there]))[:k]]
                    for column, values in zip(out, ([i] * len(best), ids[best], row[best]), strict=True):
                        column.extend(values)
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return run


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest by cosine, to six digits, among the vectors of the lists probed; ties by vec_id.

    queries(query_id, query); a query is not paired with the vector of its own id. Queries of
    another length, zero and null ones find nothing.
    """
    dims, probes = index.centres.shape[1], min(probes or index.probes, len(index.centres))
    usable = _usable(queries.select(F.col("query_id").cast("long").alias("query_id"), "query"), "query", dims)
    asked = usable.mapInArrow(_lists(index.centres, probes, "query"), usable.withColumn("list", F.lit(0)).schema)
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
    # the lists are bounded in number, so both tables are
    split = F.broadcast(blocks.join(F.broadcast(index.parts), "list"))
    left = asked.join(split, "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "part", "block", "query_id", "query")
    right = index.rows.join(split, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = right.select("list", "part", "block", F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    cell = ["list", "part", "block"]
    near = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell(k, dims), "query_id long, vec_id long, score double")
    return top(near, "query_id", "vec_id", k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the rows (query_id, vec_id) of exact that are in found; 1 if there are none."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id").withColumn("_f", F.lit(1)), ["query_id", "vec_id"], "left")
    share = hit.agg(F.avg(F.coalesce("_f", F.lit(0)))).first()[0]
    return 1.0 if share is None else float(share)


def tuned(index: Index, vectors: DataFrame, queries: DataFrame, k: int, target: float = 0.95, tried: int = TRIED) -> Index:
    """The index with the least number of probes, doubled from 1, whose recall reaches the target on the `tried` queries of least hash.

    All lists are probed in the end, which is exact.
    """
    few = stored(queries.orderBy(F.xxhash64("query_id"), "query_id").limit(tried))
    exact = stored(vector_top(vectors, few, k))
    probes = 1
    while probes < len(index.centres) and recall(search(index, few, k, probes), exact) < target:
        probes *= 2
    return Index(index.centres, index.rows, index.parts, min(probes, len(index.centres)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, target: float = 0.95) -> DataFrame:
    """search() over an index of all vectors, with as many probes as the target asks for."""
    return search(tuned(build(vectors), vectors, queries, k, target), queries, k)
