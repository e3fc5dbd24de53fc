"""Stores and sinks beyond plain files: feedback, recordings, audit log, SQLite and JDBC tables, payloads of every kind, recommendations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import upsert

FEEDBACK = "id string, pack_id string, segment string, ts timestamp, budget long, utilization double, quality double, selected array<string>, dropped array<string>"
RECORDING = "id string, items array<struct<id:string,tokens:long,score:double>>, budget long, selected array<string>, total_tokens long, metadata map<string,string>"


class FeedbackStore:
    """Feedback as an append-only Parquet table; outcomes are a second one, joined on reading. The latest outcome of a pack counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def record(self, rows: DataFrame) -> None:
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], FEEDBACK).schema]).write.mode("append").parquet(f"{self.path}/records")

    def report(self, outcomes: DataFrame) -> None:
        """outcomes(pack_id, quality, ts); a quality that is no finite number is refused."""
        finite = outcomes.where("quality is not null and not isnan(quality) and abs(quality) < double('infinity')")
        finite.select("pack_id", F.col("quality").cast("double").alias("quality"), F.col("ts").cast("timestamp").alias("ts")).write.mode("append").parquet(f"{self.path}/outcomes")

    def query(self, segment: str | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
        """Records with their outcome, newest first."""
        rows = self.spark.read.schema(FEEDBACK).parquet(f"{self.path}/records")
        try:
            told = self.spark.read.schema("pack_id string, quality double, ts timestamp").parquet(f"{self.path}/outcomes")
            latest = told.groupBy("pack_id").agg(F.max_by("quality", "ts").alias("_q"))
            rows = rows.join(latest, "pack_id", "left").withColumn("quality", F.coalesce("_q", "quality")).drop("_q")
        except Exception as e:  # noqa: BLE001  no outcome was reported yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        if segment is not None:
            rows = rows.where(F.col("segment") == segment)
        if since is not None:
            rows = rows.where(F.col("ts") >= F.lit(since).cast("timestamp"))
        rows = rows.orderBy(F.desc("ts"), F.desc("id"))
        return rows.limit(limit) if limit is not None else rows


def save_recordings(recordings: DataFrame, path: str) -> None:
    recordings.write.json(path)


def load_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Recordings; rows without an id or items are skipped."""
    return spark.read.schema(RECORDING).json(path).where("id is not null and items is not null")


def audit(events: DataFrame, path: str) -> None:
    """Append events as JSON lines."""
    events.write.mode("append").json(path)


def merge_issue_files(spark: SparkSession, existing: str, updates: DataFrame, path: str) -> None:
    """Task JSONL at `existing` with updates(issue columns) over it, written to `path` in order: known ids where they stood, new ones last."""
    from ..operators.issues import merge_issues
    from .stores import read_issues, write_issues

    old = read_issues(spark, existing).withColumn("ord", F.monotonically_increasing_id())
    new = updates.withColumn("ord", F.monotonically_increasing_id()).select(*old.columns)
    merged = merge_issues(old, new).orderBy("added", "ord").drop("added", "ord")
    write_issues(merged, path)


class MemoryStore:
    """Memories in a DataFrame of this session."""

    def __init__(self, spark: SparkSession, schema: str):
        self.rows = spark.createDataFrame([], schema)

    def put(self, rows: DataFrame, key: str = "id", order: str = "updated_at") -> None:
        self.rows = upsert(self.rows, rows.select(*self.rows.columns), key, order).select(*self.rows.columns)

    def forget(self, ids: DataFrame) -> None:
        self.rows = self.rows.join(ids.select("id").distinct(), "id", "left_anti")

    def all(self) -> DataFrame:
        return self.rows


class FileStore:
    """Memories as an append-only Parquet table of rows and tombstones; the latest row of an id counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def put(self, rows: DataFrame) -> None:
        rows.withColumns({"_at": F.current_timestamp(), "_gone": F.lit(False)}).write.mode("append").parquet(self.path)

    def forget(self, ids: DataFrame) -> None:
        empty = self.spark.createDataFrame([], self.schema)
        gone = ids.select("id").distinct().select(*[F.col("id") if f.name == "id" else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema])
        gone.withColumns({"_at": F.current_timestamp(), "_gone": F.lit(True)}).write.mode("append").parquet(self.path)

    def all(self) -> DataFrame:
        empty = self.spark.createDataFrame([], f"{self.schema}, _at timestamp, _gone boolean")
        rows = self.spark.read.schema(empty.schema).parquet(self.path)
        keep = [c for c in rows.columns if not c.startswith("_")]
        return rows.groupBy("id").agg(F.max_by(F.struct(*keep, "_gone"), "_at").alias("r")).where("not r._gone").select(*[f"r.{c}" for c in keep])


class TableStore:
    """Memories in a database table, over JDBC; what a query filters is pushed down by Spark. Puts append; the latest row of an id counts."""

    def __init__(self, spark: SparkSession, url: str, name: str, **options):
        self.spark, self.options = spark, {"url": url, "dbtable": name, **options}

    def put(self, rows: DataFrame) -> None:
        rows.write.format("jdbc").options(**self.options).mode("append").save()

    def all(self, order: str = "updated_at") -> DataFrame:
        rows = self.spark.read.format("jdbc").options(**self.options).load()
        return rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def register_sqlite(spark: SparkSession) -> None:
    """The format "sqlite": tables of a file that all executors reach, read in ranges of rowid, so a large table is many tasks.

    Options: path, table, partitions (8). The schema is given by the reader.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Range(InputPartition):
        def __init__(self, low, high):
            self.low, self.high = low, high

    class Reader(DataSourceReader):
        def __init__(self, schema, options):
            self.schema, self.options = schema, options

        def partitions(self):
            import sqlite3

            with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
                low, high = c.execute(f'select min(rowid), max(rowid) from "{self.options["table"]}"').fetchone()
            if low is None:
                return [Range(0, 0)]
            n = int(self.options.get("partitions", 8))
            step = -(-(high + 1 - low) // n)
            return [Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

        def read(self, partition):
            import sqlite3

            names = ", ".join(f'"{f.name}"' for f in self.schema)
            with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
                yield from c.execute(f'select {names} from "{self.options["table"]}" where rowid >= ? and rowid < ?', (partition.low, partition.high))

    class Sqlite(DataSource):
        @classmethod
        def name(cls):
            return "sqlite"

        def reader(self, schema):
            return Reader(schema, self.options)

    spark.dataSource.register(Sqlite)


def open_store(spark: SparkSession, kind: str, **options):
    """A store by its kind: memory (schema), file (path, schema) or jdbc (url, name, ...)."""
    kinds = {"memory": MemoryStore, "file": FileStore, "jdbc": TableStore}
    if kind not in kinds:
        raise ValueError(f"no store {kind}; there are {', '.join(kinds)}")
    return kinds[kind](spark, **options)


#: The fields of each kind of payload.
PAYLOADS = {
    "pack": ["pack_id", "total_tokens", "selected_count", "dropped_count", "utilization"],
    "trace": ["pack_id", "step", "id", "decision", "reason"],
    "handoff": ["source_agent", "target_agent", "pack_id", "budget"],
    "quality": ["pack_id", "density", "diversity", "freshness", "redundancy", "overall"],
    "cost": ["pack_id", "cost_uncached", "cost_cached", "saving"],
}


def payloads(rows: DataFrame, kind: str, at: str) -> DataFrame:
    """One JSON payload a row, with the kind's fields as far as rows have them."""
    fields = [c for c in PAYLOADS[kind] if c in rows.columns]
    return rows.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.lit(at).alias("timestamp"), *fields)).alias("payload"))


def send(payload_rows: DataFrame, post) -> None:
    """Hand each partition's payloads to post(list of texts); an error there does not stop the query. Also for foreachBatch."""

    def each(rows):
        batch = [r["payload"] for r in rows]
        if batch:
            try:
                post(batch)
            except OSError:
                return

    payload_rows.foreachPartition(each)


def recommended(defaults: DataFrame, fetched: DataFrame) -> DataFrame:
    """defaults(segment, budget, confidence) with what fetched(segment, budget, confidence) recommends instead; its confidence is held in 0 to 1."""
    f = fetched.select("segment", F.col("budget").alias("_b"), F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)).alias("_c"))
    both = defaults.join(f, "segment", "left")
    return both.select("segment", F.coalesce("_b", "budget").alias("budget"), F.coalesce("_c", "confidence").alias("confidence"), F.col("_b").isNotNull().alias("fetched"))


def load_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON file that is an array of them, or an object with them under "items" (a plan)."""
    from .stores import ITEM_SCHEMA, read_items

    head = spark.read.text(path, wholetext=True).select(F.ltrim("value").substr(1, 1).alias("c")).first()
    if head is None or head["c"] == "[":
        return read_items(spark, path)
    plan = spark.read.schema(f"items array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in _fields(ITEM_SCHEMA))}>>").json(path, multiLine=True)
    return plan.select(F.explode("items").alias("i")).select("i.*")


def _fields(schema: str) -> list[str]:
    """The schema's fields; commas inside angle brackets do not part them."""
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def state_export(rows: DataFrame, path: str) -> None:
    """A state table (antibodies, observations, outcomes) as JSON lines."""
    rows.write.mode("overwrite").json(path)


def state_import(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def dumps(row) -> str:
    """A row as JSON with its keys sorted."""
    return json.dumps(row.asDict(recursive=True), sort_keys=True, default=str)
