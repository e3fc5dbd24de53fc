"""Readers and writers: item JSON, task JSONL, memory stores, webhook payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM_SCHEMA = (
    "id string, content string, kind string, priority double, recency double, tokens int, score double, metadata map<string,string>, "
    "compressions array<struct<content:string,tokens:int,note:string>>, embedding array<double>, taskId string, isOutcome boolean, "
    "dependsOn array<string>, supersedes string, parentId string, cost double, latency double, links array<string>"
)
ISSUE_SCHEMA = (
    "id string, title string, status string, priority int, issue_type string, created_at string, updated_at string, labels array<string>, "
    "dependencies array<struct<issue_id:string,depends_on_id:string,type:string>>, defer_until string, ephemeral boolean"
)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEM_SCHEMA).json(path, multiLine=True)


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """Task JSONL; blank lines, comments, malformed lines and rows without an id are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "").where(~F.ltrim("value").startswith("#"))
    return lines.select(F.from_json("value", ISSUE_SCHEMA).alias("r")).where("r.id is not null").select("r.*")


def write_issues(issues: DataFrame, path: str) -> None:
    issues.select(F.to_json(F.struct(*issues.columns)).alias("value")).write.text(path)


def append_memories(memories: DataFrame, path: str) -> None:
    """A store is an append-only Parquet table; the view of the latest row per id is read_memories."""
    memories.withColumn("_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_memories(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    keep = [c for c in rows.columns if c != "_at"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*keep), F.struct("_at", "updated_at")).alias("r")).select("r.*")


def webhook_payloads(summary: DataFrame) -> DataFrame:
    """One JSON payload per pack summary, for a foreachBatch sink."""
    return summary.select(F.to_json(F.struct(F.lit("pack").alias("type"), *summary.columns)).alias("payload"))
