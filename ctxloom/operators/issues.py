"""Items as task records and back, handoffs as task records."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bucket_priority, estimate_tokens, priority_bucket

# Kinds that are not of type "context".
TYPES = {"task": "task", "bug": "bug", "feature": "feature"}
ISSUE = ["id", "title", "description", "status", "priority", "issue_type", "source_system", "labels", "defer_until", "metadata"]


@dataclass(frozen=True)
class Names:
    """What task records call their origin: a caller that exchanges records with other tools gives theirs."""

    source: str = "packs"
    prefix: str = "item-"
    handoff: str = "handoff-"
    title: str = "Handoff"
    about: str = "Items handed on"
    item_key: str = "_item"
    handoff_key: str = "_handoff"


NAMES = Names()


def to_issues(items: DataFrame, status: str = "open", names: Names = NAMES) -> DataFrame:
    """items(id, content, kind, priority, recency, tokens, score) as issue rows; what an issue has no field for goes into metadata, as JSON."""
    kind = F.lit("context")
    for k, t in TYPES.items():
        kind = F.when(F.col("kind") == k, t).otherwise(kind)
    i = F.col("id").cast("string")
    extra = F.to_json(F.struct(F.struct("kind", "priority", "recency", "tokens", "score", i.alias("originalId")).alias(names.item_key)))
    return items.select(
        F.concat(F.lit(names.prefix), i).alias("id"), i.alias("title"), F.col("content").alias("description"), F.lit(status).alias("status"), priority_bucket(F.col("priority")).alias("priority"), kind.alias("issue_type"),
        F.lit(names.source).alias("source_system"), F.array_compact(F.array(F.concat(F.lit("kind:"), F.col("kind")), F.lit(names.source))).alias("labels"), F.lit(None).cast("string").alias("defer_until"), extra.alias("metadata"),
    )


def to_items(issues: DataFrame, names: Names = NAMES) -> DataFrame:
    """Issue rows as items: what metadata holds counts first, then labels, the bucket and the text itself."""
    known = F.from_json("metadata", f"`{names.item_key}` struct<kind:string,priority:double,recency:double,tokens:long,score:double,originalId:string>")[names.item_key]
    label = F.get(F.filter("labels", lambda x: x.startswith("kind:")), F.lit(0))
    content = F.coalesce("description", "title")
    return issues.withColumn("_k", known).select(
        F.coalesce("_k.originalId", F.regexp_replace("id", "^" + re.escape(names.prefix), "")).alias("id"), content.alias("content"), F.coalesce("_k.kind", F.substring(label, F.lit(6), F.length(label))).alias("kind"),
        F.coalesce("_k.priority", bucket_priority(F.col("priority")).cast("double")).alias("priority"), F.col("_k.recency").alias("recency"), F.coalesce("_k.tokens", estimate_tokens(content)).alias("tokens"), F.col("_k.score").alias("score"),
    )


def create_handoff(decided: DataFrame, now: str, handoff_id: str, dropped: bool = True, names: Names = NAMES) -> DataFrame:
    """Issue rows for all packs of decided items: one manifest, chosen items open, and the others deferred until now."""
    chosen = to_issues(decided.where("chosen"), names=names)
    out = chosen
    if dropped:
        out = out.unionByName(to_issues(decided.where("not chosen"), "deferred", names).withColumn("defer_until", F.lit(now)))
    total = decided.agg(F.coalesce(F.sum(F.when(F.col("chosen"), F.col("tokens"))), F.lit(0)).alias("totalTokens"), F.count_if("chosen").alias("selectedCount"), F.count_if(~F.col("chosen")).alias("droppedCount"))
    meta = F.to_json(F.struct(F.struct("totalTokens", "selectedCount", "droppedCount", F.lit(now).alias("createdAt")).alias(names.handoff_key)))
    manifest = total.select(
        F.lit(names.handoff + handoff_id).alias("id"), F.lit(names.title).alias("title"), F.lit(names.about).alias("description"), F.lit("pinned").alias("status"), F.lit(0).alias("priority"),
        F.lit("message").alias("issue_type"), F.lit(names.source).alias("source_system"), F.array(F.lit(names.source), F.lit("handoff")).alias("labels"), F.lit(None).cast("string").alias("defer_until"), meta.alias("metadata"),
    )
    return manifest.unionByName(out)


def pickup(issues: DataFrame, names: Names = NAMES) -> DataFrame:
    """issues with `part`: manifest, item, deferred, closed (an item that is done) or work."""
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    manifest = F.col("id").startswith(names.handoff) | (F.array_contains(labels, "handoff") & (F.col("issue_type") == "message"))
    own = (F.col("issue_type") == "context") | (F.col("source_system") == names.source) | F.array_contains(labels, names.source) | F.get_json_object("metadata", f"$.{names.item_key}").isNotNull()
    state = F.when(F.col("status") == "deferred", "deferred").when(F.col("status") == "closed", "closed").otherwise("item")
    return issues.withColumn("part", F.when(F.coalesce(manifest, F.lit(False)), "manifest").when(F.coalesce(own, F.lit(False)), state).otherwise("work"))


def merge_issues(existing: DataFrame, updates: DataFrame) -> DataFrame:
    """existing(id, ord, ...) with updates over it: the last update of an id counts, new ids come last; `ord` is the new order's key."""
    from pyspark.sql import Window as W

    rows = existing.withColumn("_u", F.lit(0)).unionByName(updates.withColumn("_u", F.lit(1)))
    w = W.partitionBy("id")
    latest = rows.withColumn("_k", F.row_number().over(w.orderBy(F.desc("_u"), F.desc("ord")))).withColumn("_f", F.min(F.struct("_u", "ord")).over(w))
    return latest.where("_k = 1").withColumn("ord", F.col("_f.ord")).withColumn("added", F.col("_f._u") == 1).drop("_k", "_f", "_u")
