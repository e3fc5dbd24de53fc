"""Quality rules: hard base rules and a hashed n-gram likelihood ratio, in DataFrame functions only.

Every document's mean log-likelihood ratio per n-gram, trusted target against raw corpus,
is held against one fixed threshold. Nothing is sampled and no document is skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD
from .ngram_ratio import fit, score

#: Mean log ratio per n-gram below which a document is rejected.
THRESHOLD = -0.07


def _repeat_words(words: Column) -> Column:
    """Words that stand in an 8-word window found twice or more in the text."""
    n = F.size(words) - 7

    def doubled(step):
        # shifts and XOR: a polynomial of the word hashes over GF(2), by doubling 1, 2, 4, 8 words
        def of(h):
            m = F.greatest(F.size(h) - step, F.lit(0))
            return F.zip_with(F.slice(h, F.lit(1), m), F.slice(h, F.lit(1 + step), m), lambda a, b: F.shiftleft(a, step).bitwiseXOR(b))

        return of

    windows = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        windows = F.transform(F.array(windows), doubled(step))[0]

    def covered(hs):
        # starts of windows that occur again, ascending; each adds the words beyond the one before it
        pairs = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        m = F.size(hs)
        starts = F.transform(
            F.array(pairs),
            lambda p: F.array_sort(
                F.transform(
                    F.filter(
                        F.sequence(F.lit(0), m - 1),
                        lambda i: ((i > 0) & (F.get(p, i - 1)["h"] == p[i]["h"])) | ((i < m - 1) & (F.get(p, i + 1)["h"] == p[i]["h"])),
                    ),
                    lambda i: p[i]["i"],
                )
            ),
        )[0]
        return F.transform(
            F.array(starts), lambda s: F.aggregate(F.transform(s, lambda x, k: F.when(k == 0, 8).otherwise(F.least(F.lit(8), x - F.get(s, k - 1)))), F.lit(0), lambda a, b: a + b)
        )[0]

    return F.when(n < 2, 0).otherwise(
        F.transform(F.array(windows), lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), 0).otherwise(covered(hs)))[0]
    ).cast("long")


def base_rules(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    # white space at either end leaves an empty piece there, and only there
    words = F.array_remove(F.split(text, SPACE + "+"), "")
    counts = F.transform(
        F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))
    )[0]
    out = docs.withColumn("_w", counts).withColumn("_l", F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0])
    out = out.withColumns(
        {
            "n_words": F.col("_w.n_words"),
            "word_chars": (F.char_length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": F.col("_l").cast("long"),
            "n_repeat_words": F.col("_w.n_repeat_words"),
        }
    ).drop("_w", "_l")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bins: int = 1 << 16) -> DataFrame:
    """One row per row of docs(doc_id, text): the base counts, base_failed, score and kept.

    labels(doc_id, quality) marks the trusted target; without any, the ratio is 0 and only the
    base rules decide. Null and empty texts have no words and fail. Rows equal in doc_id and
    text are judged together and come out as often as they came in; an empty table gives no
    rows. Other columns are not carried.
    """
    ratios = fit(docs, labels, bins)
    n_own = 2 * (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(" ")) + 1)
    based = base_rules(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), n_own.alias("n_own")))
    scored = score(based, ratios, bins)
    # equal rows were summed, and each has the same number of n-grams
    scored = scored.withColumn("_times", F.floor(F.col("n_grams") / F.col("n_own")).cast("int"))
    out = scored.withColumn("score", F.col("ratio_sum") / F.col("n_grams"))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return out.drop("_copy", "_times", "ratio_sum", "n_grams", "n_own")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rows that the rules reject, columns of any name unchanged.

    Null and empty texts go (they have fewer than 20 words); equal rows stay or go together; an
    empty table gives no rows.
    """
    good = judge(docs, labels, **options).where("kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("doc"), F.xxhash64("text").alias("text"))
    return rows.join(good, F.col("doc").eqNullSafe(F.col("id")) & (F.col("text") == F.col("hash")), "left_semi").select("row.*")
