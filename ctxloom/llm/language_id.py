"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded sample of byte windows. Every
byte position of every text is labelled from a forward and a backward recurrence; a document's
probabilities are the mean of its positions'. Gates use the softsign curve, x / (1 + |x|),
which numpy evaluates with plain arithmetic.

Long texts are labelled in windows of WINDOW positions side by side, and each recurrence runs
in over the CONTEXT bytes before its window (after it, for the backward one). So a text of at
most WINDOW bytes is labelled by the whole recurrence, and every position of a longer one has
at least CONTEXT bytes of context on either side, or all there is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .hashing import slices, text_bytes
from .toxicity import fold

HIDDEN = 8
TRAIN_WINDOW = 32
WINDOW = 128
CONTEXT = 32
#: The training sample: documents a language, and windows a document, at most.
SAMPLE_DOCS = 400
SAMPLE_WINDOWS = 24
STEPS = 700
BATCH = 256


def _soft(x):
    return x / (1 + np.abs(x))


class Network:
    """Both directions side by side in axis 0. Byte 256 is padding, whose positions count for nothing."""

    def __init__(self, classes: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {
            "e": rng.normal(0, 0.5, (2, 257, 3 * h)).astype(np.float32),
            "u": rng.normal(0, 0.4, (2, h, 3 * h)).astype(np.float32),
            "v": rng.normal(0, 0.3, (2 * h, classes)).astype(np.float32),
            "c": np.zeros(classes, np.float32),
        }

    def direction(self, d: int, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states [T, B, HIDDEN] of one direction for bytes x [T, B], aligned with positions. The state is 0 in padding."""
        t, b = x.shape
        h = HIDDEN
        out = np.empty((t, b, h), np.float32)
        e, u = self.p["e"][d], self.p["u"][d]
        real = x < 256
        whole = real.all(axis=1)
        s = np.zeros((b, h), np.float32)
        for i in range(t) if d == 0 else range(t - 1, -1, -1):
            g = e.take(x[i], axis=0)
            q = s @ u
            zr = g[:, : 2 * h] + q[:, : 2 * h]
            zr /= 1 + np.abs(zr)
            zr *= 0.5
            zr += 0.5
            r = zr[:, h:]
            m = q[:, 2 * h :]
            a = m * r
            a += g[:, 2 * h :]
            n = _soft(a)
            z = zr[:, :h]
            if keep is not None:
                keep.append((d, i, s, g[:, : 2 * h] + q[:, : 2 * h], zr, m, a, n))
            s = n + z * (s - n)
            if not whole[i]:
                s *= real[i][:, None]
            out[i] = s
        return out

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states [2, T, B, HIDDEN] of both directions."""
        return np.stack([self.direction(d, x, keep) for d in (0, 1)])

    def probabilities(self, x: np.ndarray, lead: int = 0) -> np.ndarray:
        """[T - 2 * lead, B, classes]: of the positions but the first and last `lead`, which only run a recurrence in."""
        h = HIDDEN
        logits = self.direction(0, x[: len(x) - lead])[lead:] @ self.p["v"][:h]
        logits += self.direction(1, x[lead:])[: len(x) - 2 * lead] @ self.p["v"][h:]
        logits += self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of all positions that are not padding, by backpropagation through time."""
        keep: list = []
        s = self.states(x, keep)
        t, b = x.shape
        h = HIDDEN
        both = np.concatenate([s[0], s[1]], axis=2)
        logits = both @ self.p["v"] + self.p["c"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(b), y] -= 1
        p *= (x < 256)[:, :, None] / max((x < 256).sum(), 1)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["v"] = np.einsum("tbh,tbc->hc", both, p)
        g["c"] = p.sum(axis=(0, 1))
        into = p @ self.p["v"].T
        ds = [np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)]
        for d, i, before, raw, zr, m, a, n in reversed(keep):
            z, r = zr[:, :h], zr[:, h:]
            ds[d] = (ds[d] + into[i][:, d * h : (d + 1) * h]) * (x[i] < 256)[:, None]
            da = ds[d] * (1 - z) / (1 + np.abs(a)) ** 2
            dzr = np.concatenate([ds[d] * (before - n), da * m], axis=1) * 0.5 / (1 + np.abs(raw)) ** 2
            dq = np.concatenate([dzr, da * r], axis=1)
            np.add.at(g["e"][d], x[i], np.concatenate([dzr, da], axis=1))
            g["u"][d] += before.T @ dq
            ds[d] = ds[d] * z + dq @ self.p["u"][d].T
        return g


def train(windows: np.ndarray, labels: np.ndarray, classes: int, seed: int = 3) -> Network:
    """Adam over random batches; each class is drawn equally often."""
    net, rng = Network(classes, seed), np.random.default_rng(seed)
    if not len(windows) or classes < 2:
        return net
    by_class = [np.flatnonzero(labels == k) for k in range(classes)]
    by_class = [x for x in by_class if len(x)]
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(x, BATCH // len(by_class) + 1) for x in by_class])
        g = net.gradients(np.ascontiguousarray(windows[pick].T), labels[pick])
        rate = 0.02 * min(1.0, step / 20) * (1 - 0.9 * step / STEPS)
        for k, v in net.p.items():
            first[k] += 0.1 * (g[k] - first[k])
            second[k] += 0.01 * (g[k] ** 2 - second[k])
            v -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return net


def _windows(width: int, most: int):
    """At most `most` windows of a text, evenly over all of it."""

    def run(batches):
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            langs, out = [], []
            for i, lang in enumerate(b.column("lang").to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                for s in np.unique(np.linspace(0, max(len(own) - width, 0), most).astype(np.int64)):
                    langs.append(lang)
                    out.append(own[s : s + width].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "bytes"])

    return run


def pooled(net: Network, column: pa.Array, classes: int) -> np.ndarray:
    """[rows, classes]: mean position probabilities; rows without bytes are 0."""
    data, offsets = text_bytes(column)
    sizes = np.diff(offsets)
    number = -(-sizes // WINDOW)
    at = np.concatenate([[0], np.cumsum(number)])
    out = np.zeros((len(sizes), classes))
    if not at[-1]:
        return out
    rows = np.repeat(np.arange(len(sizes)), number)
    begin = offsets[:-1][rows] + (np.arange(at[-1]) - at[:-1][rows]) * WINDOW
    first, end = offsets[:-1][rows], offsets[1:][rows]
    sums = np.zeros((at[-1], classes))
    for a in range(0, at[-1], 2048):
        pos = begin[a : a + 2048] + np.arange(-CONTEXT, WINDOW + CONTEXT)[:, None]
        inside = (pos >= first[a : a + 2048]) & (pos < end[a : a + 2048])
        x = np.where(inside, data[np.clip(pos, 0, len(data) - 1)].astype(np.int64), np.int64(256))
        p = net.probabilities(x, CONTEXT)
        p *= inside[CONTEXT : CONTEXT + WINDOW, :, None]
        sums[a : a + 2048] = p.sum(axis=0)
    some = np.flatnonzero(number)
    out[some] = np.add.reduceat(sums, at[:-1][some]) / sizes[some, None]
    return out


def _predict(model, langs):
    def run(batches):
        for part in slices(batches, 1 << 20):
            letter = np.asarray(part.column("letter").to_pylist(), dtype=bool)
            p = pooled(model.value, part.column("text"), max(len(langs), 1))
            best = p.argmax(axis=1)
            names = [langs[k] if ok and langs else "und" for k, ok in zip(best, letter, strict=True)]
            score = np.where([n != "und" for n in names], p[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(names), pa.array(np.clip(score, 0.0, 1.0))], ["doc_id", "held_out", "lang_pred", "score"]
            )

    return run


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of docs(doc_id, text, lang).

    Learns from rows whose fold of three is not 1 and whose lang is not null: at most
    SAMPLE_DOCS documents a language, chosen by a hash, SAMPLE_WINDOWS windows each. Every whole
    text is labelled. Null texts and texts without a letter are `und` with score 0, and so is
    all if nothing could be learned. Repeated rows score alike; an empty table gives no rows;
    other columns are not carried.
    """
    spark = docs.sparkSession
    known = docs.where((fold(3) != 1) & F.col("lang").isNotNull() & (F.length("text") > 0))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    h = F.xxhash64("doc_id", "lang")
    rare = F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53)) < F.lit(4.0 * SAMPLE_DOCS) / F.col("n")
    thin = known.select("doc_id", "lang", "text").join(F.broadcast(sizes), "lang").where(rare)
    some = thin.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy(h, "doc_id"))).where(F.col("k") <= SAMPLE_DOCS)
    sample = some.select("lang", "text").mapInArrow(_windows(TRAIN_WINDOW, SAMPLE_WINDOWS), "lang string, bytes binary").orderBy("lang", "bytes").toPandas()
    langs = sorted(sample["lang"].unique())
    x = np.full((len(sample), TRAIN_WINDOW), 256, np.int64)
    for i, raw in enumerate(sample["bytes"]):
        x[i, : len(raw)] = np.frombuffer(raw, np.uint8)
    y = np.searchsorted(np.array(langs, dtype=object), sample["lang"].to_numpy()) if langs else np.zeros(0, np.int64)
    model = spark.sparkContext.broadcast(train(x, y, len(langs)))
    rows = docs.select("doc_id", (fold(3) == 1).alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return rows.mapInArrow(_predict(model, langs), "doc_id long, held_out boolean, lang_pred string, score double")
