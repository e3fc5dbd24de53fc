"""Memories: normal form, latest rows, removal, hybrid ranking, consolidation, keys seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import cosine


def normalize(rows: DataFrame, now: str) -> DataFrame:
    """rows(id, content, and as far as given created_at, updated_at, last_accessed_at, salience, is_summary) with what is missing or null filled in."""
    have = set(rows.columns)

    def given(name, kind):
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    created = F.coalesce(given("created_at", "timestamp"), F.lit(now).cast("timestamp"))
    filled = {
        "created_at": created,
        "updated_at": F.coalesce(given("updated_at", "timestamp"), created),
        "last_accessed_at": F.coalesce(given("last_accessed_at", "timestamp"), created),
        "salience": F.coalesce(given("salience", "double"), F.lit(1.0)),
        "is_summary": F.coalesce(given("is_summary", "boolean"), F.lit(False)),
    }
    return rows.withColumns(filled)


def get(store: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """The memories of ids(id), touched now."""
    return store.join(ids.select("id").distinct(), "id", "left_semi").withColumn("last_accessed_at", F.lit(now).cast("timestamp"))


def forget(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id").distinct(), "id", "left_anti")


def expired(now: str) -> Column:
    at = F.unix_millis(F.lit(now).cast("timestamp"))
    return F.coalesce(F.col("ttl_seconds") > 0, F.lit(False)) & (F.unix_millis("created_at") + F.col("ttl_seconds") * 1000 <= at)


def hybrid(memories: DataFrame, queries: DataFrame, now: str, half_life: float, alpha: float = 0.5, least: float = 0.0, limit: int = 10) -> DataFrame:
    """(query_id, id, score, rank): alpha * cosine + (1 - alpha) * salience halved each half life, best first.

    memories(id, created_at, ttl_seconds, salience, embedding, ord), queries(query_id, vector,
    text: null or what the content must hold). Queries without a vector find every memory of
    relevance 1, memories without one are of relevance 0. queries is a stated set; it is joined
    in, and every pair is scored once in generated code.
    """
    age = (F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis("created_at")) / 1000.0
    live = memories.where(~expired(now)).withColumn("_s", F.coalesce("salience", F.lit(1.0)) * F.pow(F.lit(0.5), age / F.lit(float(half_life))))
    pairs = live.join(queries, F.col("text").isNull() | F.contains(F.lower("content"), F.lower("text")))
    relevance = F.when(F.col("vector").isNull(), 1.0).when(F.col("embedding").isNull(), 0.0).otherwise(cosine(F.col("vector"), F.col("embedding")))
    scored = pairs.select("query_id", "id", (F.lit(alpha) * relevance + F.lit(1.0 - alpha) * F.col("_s")).alias("score")).where(F.col("score") >= least)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit)


def consolidate(memories: DataFrame, summarize: Callable[[Column], Column], now: str, threshold: float = 0.3) -> DataFrame:
    """memories with those of little salience, and no summary yet, turned into summaries by `summarize`, an expression of the content."""
    cold = (F.coalesce("salience", F.lit(1.0)) < threshold) & ~F.coalesce("is_summary", F.lit(False))
    return memories.withColumns(
        {
            "content": F.when(cold, F.concat(F.lit("[Flashcard] "), summarize(F.col("content")))).otherwise(F.col("content")),
            "updated_at": F.when(cold, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at")),
            "salience": F.when(cold, F.lit(threshold + 0.1)).otherwise(F.col("salience")),
            "is_summary": F.coalesce("is_summary", F.lit(False)) | cold,
        }
    )


def unseen(tasks: DataFrame, seen: DataFrame, now: str, ttl: int) -> DataFrame:
    """The tasks(key) whose key is not in seen(key, at), or was there more than `ttl` seconds ago; of tasks with one key the first by ord."""
    at = F.unix_millis(F.lit(now).cast("timestamp"))
    live = seen.where(F.unix_millis("at") + ttl * 1000 > at).select("key").distinct()
    first = tasks.withColumn("_k", F.row_number().over(W.partitionBy("key").orderBy("ord"))).where("_k = 1").drop("_k")
    return first.join(live, "key", "left_anti")


def bridged(memories: DataFrame, now: str, half_life: float = 3600.0, priority: float = 5.0, kind: str = "memory") -> DataFrame:
    """memories(id, content, created_at, salience) as items: recency from 10 down by half lives, salience 1 where there is none."""
    from .monitoring import bridge_recency

    age = (F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis("created_at")) / 1000.0
    return memories.select("id", "content", F.lit(kind).alias("kind"), F.lit(priority).alias("priority"), bridge_recency(age, half_life).alias("recency"), F.coalesce("salience", F.lit(1.0)).alias("salience"))
