"""Shared parts: table access, shared storage, words, distributed ranks."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

_written: list[tuple[SparkSession, str]] = []
_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where the master is local and none is set."""
    global _own_dir
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="ctxloom-")
    return f"file://{_own_dir}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet to the shared folder and read it again.

    The files outlive lost executors. They go by release(), else when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ctxloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    read = spark.read.schema(df.schema).parquet(path)
    read._written_at = path
    return read


def _delete(session: SparkSession, path: str) -> None:
    try:
        p = session._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(session._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        return


def release(*frames: DataFrame) -> None:
    """Delete the files of frames that materialize() returned and nothing reads any more."""
    paths = {f._written_at for f in frames}
    for entry in [x for x in _written if x[1] in paths]:
        _written.remove(entry)
        _delete(*entry)


def mark() -> int:
    """A point in what materialize() has written, for release_since()."""
    return len(_written)


def release_since(point: int, keep: DataFrame) -> None:
    """Delete what was written since `point`, but for the files of `keep`."""
    for entry in [x for x in _written[point:] if x[1] != keep._written_at]:
        _written.remove(entry)
        _delete(*entry)


def discard(spark: SparkSession | None = None) -> None:
    """Delete all that materialize() has written."""
    while _written:
        _delete(*_written.pop())


atexit.register(discard)


def n_words(text) -> F.Column:
    """Words of the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def expand(df: DataFrame, times: str, most: int, name: str = "_nth", chunk: int = 10_000) -> DataFrame:
    """Each row as often as its column `times` (at most `most`) says, numbered from 0 in `name`.

    A row that comes very often is split into chunks that are dealt over all tasks first.
    """
    if most <= chunk:
        return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1))) if most > 0 else df.limit(0).withColumn(name, F.lit(0).cast("long"))
    split = df.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(times) / chunk) - 1)))
    dealt = split.repartition(F.xxhash64(*df.columns, "_chunk"))
    last = F.least(F.col(times), (F.col("_chunk") + 1) * chunk) - 1
    return dealt.withColumn(name, F.explode(F.sequence(F.col("_chunk") * chunk, last))).drop("_chunk")


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add `name`: 0, 1, 2, ... in the order given, which must be total. The result is on disk.

    Spark's range sort deals the rows; a partition's offset is the number of rows in those
    before it, so what is broadcast has one row per partition of the sort.
    """
    placed = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    written = materialize(placed, "sorted")
    parts = written.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("_part", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    ranked = written.join(F.broadcast(offsets), "_part")
    out = materialize(ranked.select(*df.columns, (F.col("_from") + F.col("_at") - F.col("_low")).cast("long").alias(name)), "ranked")
    release(written)
    return out


def gapless_rank(df: DataFrame, group: list[str], order: list[str], name: str, spread: Column | None = None, block: int = 50_000) -> DataFrame:
    """Add `name`: 0, 1, 2, ... within each group, without a task that holds a group.

    Rows follow `spread`, a hash of 0 to 2**32 - 1 (by default of the order columns), and then
    the order columns, which must tell different rows apart, nulls first; so the ranks are the
    same at every size. Equal rows are interchangeable: they are counted first, so a row that
    the table repeats is one row here, and a hot one no burden. Rows are dealt into ranges of
    the hash, of about `block` rows; a range's offset is the number of rows before it.
    """
    low = F.xxhash64(*order).bitwiseAND(F.lit(2**32 - 1)) if spread is None else spread
    counted = materialize(df.groupBy(*df.columns).agg(F.count("*").alias("_m")), "counted")
    kinds, most = counted.agg(F.count("*"), F.max("_m")).first()
    n = max(1, math.ceil(kinds / block))
    dealt = counted.withColumn("_h", low).withColumn("_block", F.floor(F.col("_h") * F.lit(n) / F.lit(2.0**32)))
    counts = dealt.groupBy(*group, "_block").agg(F.sum("_m").alias("_n"))
    before = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = W.partitionBy(*group, "_block").orderBy("_h", *order).rowsBetween(W.unboundedPreceding, -1)
    ranked = dealt.withColumn("_at", F.coalesce(F.sum("_m").over(inside), F.lit(0)))
    # groups are never null here: callers deal rows into numbered shards or buckets
    placed = ranked.join(offsets, [*group, "_block"]).select(*df.columns, "_m", (F.col("_from") + F.col("_at")).alias("_first"))
    return expand(placed, "_m", most or 0).select(*df.columns, (F.col("_first") + F.col("_nth")).cast("long").alias(name))
