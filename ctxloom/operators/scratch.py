"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None
_kept: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where the master is local and none is set."""
    global _own
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    _own = _own or tempfile.mkdtemp(prefix="ctxloom-")
    return f"file://{_own}"


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in folder()."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """df, written as Parquet to folder() and read again; the files go by dropped(), else when the driver's process ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/ctxloom-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    _kept[path] = spark
    read = spark.read.schema(df.schema).parquet(path)
    read._stored_at = path
    return read


def packed(df: DataFrame) -> DataFrame:
    """stored(), in a smaller form that costs more time."""
    return stored(df, "zstd")


#: Ids that are broadcast at most.
IDS = 1_000_000


def only(rows: DataFrame, ids: DataFrame, on: list[str], how: str) -> DataFrame:
    """A semi or anti join with stored ids, which are broadcast if they are few, so that rows need not move."""
    return rows.join(F.broadcast(ids) if ids.count() <= IDS else ids, on, how)


def _delete(path: str, spark: SparkSession) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        return


def dropped(*frames: DataFrame) -> None:
    """Delete the files of frames that stored() returned and nothing reads any more."""
    for f in frames:
        if f._stored_at in _kept:
            _delete(f._stored_at, _kept.pop(f._stored_at))


def _last() -> None:
    while _kept:
        _delete(*_kept.popitem())


atexit.register(_last)
