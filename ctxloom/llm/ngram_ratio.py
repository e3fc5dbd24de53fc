"""Hashed n-gram multinomials of target and raw text, in DataFrame functions only.

Tokens and pairs of adjacent tokens are hashed into a fixed number of bins. The
target model counts documents that are labelled good, the raw model all documents. The
ratio's table has one row per bin, so its size is bounded by the parameter `bins`, whatever
the corpus; it alone is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BROADCAST_IDS = 1_000_000


def gram_rows(docs: DataFrame, keep: list[str], bins: int) -> DataFrame:
    """keep columns and `bin`, one row per n-gram of the text: tokens between blanks, and pairs of adjacent tokens.

    A text always has a token (the empty text and null: one empty token), so no row is lost.
    Hashing runs on exploded columns, inside generated code, and not in lambda functions.
    """

    def bin_of(*cols):
        return F.pmod(F.xxhash64(*cols), F.lit(bins)).cast("int")

    tokens = docs.select(*keep, F.split(F.coalesce("text", F.lit("")), " ").alias("_t"))
    pairs = tokens.select(*keep, F.explode(F.arrays_zip("_t", F.slice("_t", 2, 2**31 - 1).alias("_next"))).alias("_p"))
    return pairs.select(*keep, F.explode(F.array(bin_of("_p._t"), bin_of("_p._t", "_p._next"))).alias("bin"))


def ratio_table(grams: DataFrame, prior: float = 10.0) -> DataFrame:
    """(bin, ratio): log of target over raw probability, from rows (bin, target boolean or null).

    Counts are summed over all rows, before anything is joined. Each bin gets `prior`
    pseudo-counts that follow the raw model, so a bin with little evidence is near 0.
    Without any target row every ratio is 0.
    """
    per_bin = grams.groupBy("bin").agg(F.count("*").alias("raw"), F.count(F.when(F.col("target"), 1)).alias("good"))
    per_bin = materialize(per_bin, "bins")
    all_raw, all_good = per_bin.agg(F.sum("raw"), F.sum("good")).first()
    if not all_good:
        return per_bin.select("bin", F.lit(0.0).alias("ratio"))
    expected = F.col("raw") * F.lit(all_good / all_raw)
    return per_bin.select("bin", F.log((F.col("good") + prior) / (expected + prior)).alias("ratio"))


def tag_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, ...) with `target`: true where some label row says quality 1.

    The labelled ids are counted first and broadcast if they are few; beyond that the join
    shuffles both sides. Either way the rows are the same.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct().withColumn("target", F.lit(True))
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    return docs.join(good, docs["doc_id"] == good["_id"], "left").drop("_id")


def fit(docs: DataFrame, labels: DataFrame, bins: int = 1 << 16, prior: float = 10.0) -> DataFrame:
    """The ratio table of docs(doc_id, text). Only bins are shuffled, counted map-side first."""
    tagged = tag_target(docs.select("doc_id", "text"), labels)
    return ratio_table(gram_rows(tagged, ["target"], bins), prior)


def score(docs: DataFrame, ratios: DataFrame, bins: int = 1 << 16) -> DataFrame:
    """docs (all columns but text) with ratio_sum and n_grams, over whole texts.

    Rows equal in all columns come out once, with the sums of all of them.
    """
    keep = [c for c in docs.columns if c != "text"]
    joined = gram_rows(docs, keep, bins).join(F.broadcast(ratios), "bin", "left")
    return joined.groupBy(*keep).agg(F.coalesce(F.sum("ratio"), F.lit(0.0)).alias("ratio_sum"), F.count("*").alias("n_grams"))
