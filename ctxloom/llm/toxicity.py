"""Toxicity by class-conditional Kneser-Ney models.

Two language models, of toxic and of ordinary text, each with interpolated absolute discounts
at two orders: words given nothing, and the stems (first four bytes) of words given nothing.
A model's discounted mass of words goes to words by way of their stem:

    P_c(w) = max(n_c(w) - D, 0) / N_c + l_c * P_c(stem of w) / (V(stem) + 1)
    P_c(s) = max(n_c(s) - E, 0) / N_c + m_c * B(s)

with each class's own discounts (three each, from its counts of counts) and left masses l_c,
m_c, so each sums to 1. V, the number of different words that continue a stem, and B, the share
of stems in all different words, are continuation counts over both classes together: the shared
backoff, in which a rare word counts like others of its stem. A text is judged by one figure:
the log-likelihoods of the two models, length-normalised, compared over each WINDOW words in a
row (over the whole text, if it has fewer), at its largest. One logistic curve maps that to a
probability; it is fitted to the training folds, each compared by models that leave it out.

Counts are taken over all labelled training texts, by bins of hashed words: the tables that
reach the driver and are broadcast have at most BINS rows each, whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .hashing import LOWER, SPACE, mix, slices, text_bytes, word_hashes

BINS = 1 << 20
#: Words over which likelihoods are compared.
WINDOW = 8
STEM = 4
#: Labelled rows of each training fold that the logistic curve is fitted on, at most.
CALIBRATION_ROWS = 20_000
BROADCAST_IDS = 1_000_000
#: Training folds.
PARTS = 3
#: Damping of the logistic curve's slope.
RIDGE = 0.01


def _words(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each word its bins (of the word and of its stem), and its row."""
    data, offsets = text_bytes(column)
    hashes, rows, starts = word_hashes(data, offsets)
    none = np.zeros(0, np.int64)
    if not len(rows):
        return [none, none], rows
    code, inside, limit = np.zeros(len(starts), np.uint64), np.ones(len(starts), bool), offsets[1:][rows]
    for j in range(STEM):
        at = np.minimum(starts + j, len(data) - 1)
        inside &= (starts + j < limit) & ~SPACE[data[at]]
        code = (code << np.uint64(8)) | np.where(inside, LOWER[data[at]], 0).astype(np.uint64)
    return [(x % np.uint64(BINS)).astype(np.int64) for x in (hashes, mix(code))], rows


def _count(batches):
    """Counts by one packed key: two bins of 20 bits, and three bits for the training fold and the class."""
    for part in slices(batches):
        (word, stem), rows = _words(part.column("text"))
        kind = np.asarray(part.column("kind").to_pylist(), dtype=np.int64)[rows] if len(rows) else rows
        keys, n = np.unique((((word << 20) | stem) << 3) | kind, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])


def _without(levels: list[pd.DataFrame], part: int | None) -> list[pd.DataFrame]:
    """Each level's (bin, ordinary, toxic, types) over the training folds but `part`."""
    folds = [f for f in range(PARTS) if f != part]
    return [
        pd.DataFrame({"bin": x["bin"], **{c: sum(x[f"{c}_{f}"] for f in folds) for c in ("ordinary", "toxic")}, "types": x["types_all" if part is None else f"types_{part}"]})
        for x in levels
    ]


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken from each count: three discounts, for 1, 2 and more, from the counts of counts; at least half of 1."""
    n = [float((counts == i).sum()) for i in range(1, 5)]
    y = n[0] / max(n[0] + 2 * n[1], 1.0)
    d = [min(max(i + 1 - (i + 2) * y * n[i + 1] / max(n[i], 1.0), 0.5), i + 1.0) for i in range(3)]
    return np.where(counts >= 3, d[2], np.where(counts == 2, d[1], np.where(counts == 1, d[0], 0.0)))


class Model:
    """Tables by bin: per class the kept counts and left masses of both orders, and the shared continuation counts."""

    def __init__(self, levels):
        """levels: frames (bin, ordinary, toxic, types) of words and of stems; types of stems: the different words that continue them."""

        def dense(frame, column):
            out = np.zeros(BINS)
            out[frame["bin"].to_numpy()] = frame[column].to_numpy()
            return out

        words, stems = levels
        self.types = dense(stems, "types").astype(np.float32)
        self.base = ((self.types + 0.5) / (self.types.sum(dtype=np.float64) + 0.5 * BINS)).astype(np.float32)
        self.words, self.stems = [], []
        for c in ("ordinary", "toxic"):
            for made, frame in ((self.words, words), (self.stems, stems)):
                n = dense(frame, c)
                total, cut = max(n.sum(), 1.0), discounts(n)
                # without any text of a class all its mass is left to the backoff
                made.append((((n - cut) / total).astype(np.float32), float(cut.sum() / total) if n.any() else 1.0))

    def log_probabilities(self, bins: list[np.ndarray], c: int) -> np.ndarray:
        """log P of each word; c: 0 ordinary, 1 toxic."""
        word, stem = bins
        kept, left = self.stems[c]
        p = kept[stem].astype(np.float64) + left * self.base[stem]
        kept, left = self.words[c]
        return np.log(kept[word] + left * p / (self.types[stem] + 1))

    def differences(self, column: pa.Array) -> np.ndarray:
        """Of each text the largest mean difference of log-likelihoods per word, toxic less ordinary, over WINDOW words in a row; 0 without words."""
        bins, rows = _words(column)
        out = np.zeros(len(column))
        if not len(rows):
            return out
        total = np.concatenate([[0.0], np.cumsum(self.log_probabilities(bins, 1) - self.log_probabilities(bins, 0))])
        present, first = np.unique(rows, return_index=True)
        number = np.diff(np.append(first, len(rows)))
        size = np.minimum(number, WINDOW)
        # the windows of a text end at its word `size` and at each later one
        begin, width = np.repeat(first, number), np.repeat(size, number)
        end = np.arange(1, len(rows) + 1)
        mean = np.where(end - begin >= width, (total[end] - total[np.maximum(end - width, 0)]) / width, -np.inf)
        out[present] = np.maximum.reduceat(mean, first)
        return out


def _compare(model):
    def run(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(model.value.differences(part.column("text")))], ["toxic", "difference"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Intercept and slope of the log odds, by Newton steps; the intercept is free."""
    a, b = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    ridge = np.diag([1e-6, RIDGE])
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        b = b - np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ b)
    return b


def _score(model, curve, threshold):
    def run(batches):
        for part in slices(batches):
            p = 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * model.value.differences(part.column("text")), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    return run


def fold(parts: int):
    """crc32 of the doc_id as text, modulo `parts`; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs(doc_id, text).

    labels(doc_id, toxic) are used in folds 0, 1 and 3 only; a document
    that several label rows name is toxic if one says so, null labels are ignored. Scores depend
    on the text alone. Null, empty and wordless texts have difference 0. Without labels every
    score is 0.5. Repeated rows score alike; an empty table gives no rows; other columns are not
    carried.
    """
    spark = docs.sparkSession
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic")).where(fold(4) != 2)
    if marks.count() <= BROADCAST_IDS:
        marks = F.broadcast(marks)
    known = docs.select("doc_id", "text").join(marks, "doc_id")
    known = known.select("doc_id", "text", "toxic", F.when(fold(4) == 3, 2).otherwise(fold(4)).cast("long").alias("part"))
    coded = known.select("text", (F.col("part") * 2 + F.col("toxic")).alias("kind"))
    counted = materialize(coded.mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    kind, mask = F.col("key").bitwiseAND(F.lit(7)), F.lit(BINS - 1)
    names = [f"{c}_{f}" for f in range(PARTS) for c in ("ordinary", "toxic")]
    by_class = [F.sum(F.when(kind == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(names)]
    forms = counted.groupBy(F.shiftright("key", 3).alias("form")).agg(*by_class)
    sums = [F.sum(c).cast("float").alias(c) for c in names]
    others = [sum(F.col(c) for c in names if not c.endswith(f"_{f}")) for f in range(PARTS)]
    types = [F.count_if(x > 0).cast("int").alias(f"types_{f}") for f, x in enumerate(others)]
    levels = []
    for shift in (20, 0):
        bin_ = F.shiftright("form", shift).bitwiseAND(mask).cast("int").alias("bin")
        levels.append(forms.groupBy(bin_).agg(*sums, *types, F.count("*").cast("int").alias("types_all")).toArrow().to_pandas())

    # each training fold is compared by a model that has not seen it; the curve is fitted to all of them
    n = known.count()
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < min(1_000_000, 1_200_000 * CALIBRATION_ROWS // max(n, 1)))
    fitted = []
    for f in range(PARTS):
        early = spark.sparkContext.broadcast(Model(_without(levels, f)))
        run = some.where(F.col("part") == f).select("text", "toxic").mapInArrow(_compare(early), "toxic long, difference double")
        fitted.append(run.limit(CALIBRATION_ROWS).toPandas())
        early.unpersist()
    # the model that scores has seen all training folds
    model = spark.sparkContext.broadcast(Model(_without(levels, None)))
    del levels
    release(counted)

    fitted = pd.concat(fitted)
    curve = _logistic(fitted["difference"].to_numpy(), fitted["toxic"].to_numpy(np.float64))
    rows = docs.select("doc_id", (fold(4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(_score(model, curve, threshold), "doc_id long, held_out boolean, score double, predicted int")
