"""Quality classifier by importance resampling.

A document's log importance weight is the log ratio of two hashed n-gram models, target text
against raw text, over its whole text. Adding Gumbel noise and taking the k largest draws k
documents without replacement in proportion to their weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .ngram_ratio import fit, score


def kth_largest(values: DataFrame, k: int, held: int = 100_000, eps: float = 1e-3) -> tuple:
    """The k-th largest of values(v), none null, 1 <= k <= count, and how many are larger.

    Approximate quantiles bracket the k-th value, exact counts tell on which side of the marks
    it lies, and only those rows are looked at again, until at most `held` are left to sort.
    v must be exact as a double.
    """
    v, part, above = F.col("v"), values, 0
    size = part.count()
    while size > held:
        q = 1 - (k - above) / size
        low, high = part.agg(F.percentile_approx("v", [max(0.0, q - 2 * eps), min(1.0, q + 2 * eps)], int(1 / eps))).first()[0]
        regions = [v > high, v == high, (v < high) & (v > low), (v == low) & (v < high), v < low]
        counts = part.agg(*[F.count_if(r) for r in regions]).first()
        for at, (region, n) in enumerate(zip(regions, counts, strict=True)):
            if k <= above + n:
                break
            above += n
        if at in (1, 3):
            return (high if at == 1 else low), above
        part, size = part.where(region), n
    cut = part.orderBy(F.desc("v")).offset(k - above - 1).limit(1).first()[0]
    return cut, above + part.where(v > cut).count()


def top_k(df: DataFrame, by: str, ties: list[str], k: int, name: str) -> DataFrame:
    """Add `name`: true for exactly the k rows with the largest `by`, ties by ascending integer columns, null first.

    The table is never sorted: each column's threshold comes from kth_largest over the rows
    that tie in the columns before it, however many these are.
    """
    n = df.count()
    if k >= n or k <= 0:
        return df.withColumn(name, F.lit(k >= n and n > 0))
    keys = [F.col(by)]
    for c in ties:  # halves of 32 bits are exact as doubles
        x = F.col(c).cast("long")
        keys += [-F.coalesce(F.shiftright(x, 32), F.lit(-(2**31) - 1)), -F.coalesce(x.bitwiseAND(F.lit(2**32 - 1)), F.lit(0))]
    over, tied, need = F.lit(False), F.lit(True), k
    for key in keys:
        cut, larger = kth_largest(df.where(tied).select(key.alias("v")), need)
        over, tied, need = over | (tied & (key > cut)), tied & (key == cut), need - larger
        if df.where(tied).count() == need:
            return df.withColumn(name, over | tied)
    raise ValueError("rows are equal in all columns of the order")


def resample(docs: DataFrame, labels: DataFrame, *, fraction: float | None = None, bins: int = 1 << 16, seed: int = 11) -> DataFrame:
    """One row per row of docs(doc_id, text): log_weight, gumbel_key, selected.

    labels(doc_id, quality): quality 1 is target text. `fraction` of the rows is drawn; by
    default the target's share of the labelled documents. Noise comes from a hash of doc_id,
    so reruns agree. Null and empty texts have weight log 1 = 0. Repeated rows tie: they are
    scored as one and expanded again; an empty table gives no rows. Other columns are not
    carried.
    """
    if fraction is None:
        share = labels.where("doc_id is not null and quality is not null").agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
        fraction = 1.0 if share is None else share
    ratios = fit(docs, labels, bins)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", F.lit(seed)), 11) + 0.5) / F.lit(float(1 << 53))
    scored = score(keyed, ratios, bins).withColumn("log_weight", F.col("ratio_sum"))
    scored = scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))
    counted = keyed.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"))
    both = counted.withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"})
    joined = scored.join(both, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("text_hash").eqNullSafe(F.col("_t")))
    # rows scored as one share their sum: back to the weight of one copy
    one = F.col("log_weight") / F.col("copies")
    fixed = joined.withColumn("gumbel_key", F.col("gumbel_key") - F.col("log_weight") + one).withColumn("log_weight", one)
    rows = materialize(fixed.select("doc_id", "text_hash", "n_grams", "log_weight", "gumbel_key", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")), "weights")
    k = round(fraction * rows.count())
    return top_k(rows, "gumbel_key", ["doc_id", "text_hash", "copy"], k, "selected").drop("text_hash", "copy")
