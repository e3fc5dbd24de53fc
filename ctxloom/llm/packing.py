"""Packing into optimal length buckets and token-budget batches.

The global histogram of lengths is bounded: lengths up to 2048 count exactly, longer
ones in cells of 1/1024 of their size, so its size depends on the longest text alone and
not on the number of rows. Dynamic programming over it finds the bucket boundaries with
the least padding. Batches are formed from gapless ranks inside each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, materialize, n_words

EXACT = 2048


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Upper ends of at most `buckets` buckets over ascending lengths, and the least total padding."""
    n = len(lengths)
    if not n:
        return [], 0
    rows = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    mass = np.concatenate([[0], np.cumsum(lengths * counts, dtype=np.float64)])
    # cost of one bucket over cells i..j: length[j] * rows(i..j) - mass(i..j)
    best = lengths * rows[1:] - mass[1:]
    choice = []
    for _ in range(min(buckets, n) - 1):
        new, arg = best.copy(), np.full(n, -1)
        for j in range(1, n):
            cost = best[:j] + lengths[j] * (rows[j + 1] - rows[1 : j + 1]) - (mass[j + 1] - mass[1 : j + 1])
            i = int(np.argmin(cost))
            if cost[i] < new[j]:
                new[j], arg[j] = cost[i], i
        best = new
        choice.append(arg)
    ends, j, level = [], n - 1, len(choice) - 1
    while j >= 0:
        ends.append(int(lengths[j]))
        while level >= 0 and choice[level][j] < 0:
            level -= 1
        if level < 0:
            break
        j, level = int(choice[level][j]), level - 1
    return ends[::-1], int(best[-1])


def length_cell(length) -> F.Column:
    """The histogram cell of a length, as the largest length in it."""
    width = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(length, F.lit(1)))) - 10, F.lit(0)))
    return F.when(length <= EXACT, length).otherwise(F.ceil(length / width) * width).cast("long")


def pack(docs: DataFrame, buckets: int = 16, budget: int = 16_384) -> DataFrame:
    """One row per row of docs(doc_id, text): n_tokens (words), bucket_len, batch_id, slot, padding.

    A batch holds rows of one bucket, each padded to the bucket's length, and at most `budget`
    padded tokens; a row longer than the budget is a batch of its own. Null and empty texts
    have length 0 and form batches of `budget` rows. Repeated rows are packed one by one; ties
    in length share a bucket; an empty table gives no rows. Other columns are not carried.
    """
    # texts are read once: all that follows works on lengths
    sized = materialize(docs.select("doc_id", n_words(F.col("text")).alias("n_tokens")), "lengths")
    cells = sized.groupBy(length_cell(F.col("n_tokens")).alias("cell")).agg(F.count("*").alias("n")).toPandas().sort_values("cell")
    ends, _ = optimal_boundaries(cells["cell"].to_numpy(np.float64), cells["n"].to_numpy(np.float64), buckets)
    if not ends:
        ends = [0]
    bucket = F.lit(len(ends) - 1)
    for i in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= ends[i], F.lit(i)).otherwise(bucket)
    bounds = F.array(*[F.lit(e).cast("long") for e in ends])
    dealt = sized.withColumn("bucket", bucket).withColumn("bucket_len", F.get(bounds, F.col("bucket")))
    ranked = gapless_rank(dealt, ["bucket"], ["n_tokens", "doc_id"], "_rank")
    room = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))), F.lit(1)).cast("long")
    return ranked.select(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_len",
        F.concat(F.col("bucket"), F.lit("-"), F.floor(F.col("_rank") / room)).alias("batch_id"),
        F.pmod(F.col("_rank"), room).alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
