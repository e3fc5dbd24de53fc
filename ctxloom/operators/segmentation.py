"""Documents into segments where meaning or surprise changes; the models that judge are the caller's.

Sentences, their tokens and the places where a cut is safe are column expressions on the
document's row, so nothing is shuffled. Python sees the sentences of many documents at once: one
call of the caller's model for up to CHUNK sentences, then arrays over all of them; it returns
where the segments end, and the segments are put together by Spark again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, protected_zones, safe_cut
from .conversations import BLANK, segments

#: Sentences that one call of a model gets, about; a document is never split.
CHUNK = 8192
#: Scores are rounded to so many decimals, so that equal ones compare as equal in whatever order they are added up.
DECIMALS = 9

Embed = Callable[[list[str]], list[list[float]]]
Score = Callable[[list[str]], list[float]]


def sentences(text: Column) -> Column:
    """Array of the sentences, without blank ones; null and blank texts have none."""
    whole = F.split(F.coalesce(text, F.lit("")), rf"(?<=[.!?])(?={BLANK})")
    return F.filter(F.transform(whole, lambda p: F.regexp_replace(p, rf"\A{BLANK}+|{BLANK}+\z", "")), lambda s: s != "")


def safe_ends(text: Column, entities: list[str] = ()) -> Column:
    """For each of sentences(): whether a cut at its end leaves protected runs whole.

    Sentences end at blanks, and of the protected runs only the caller's entities may hold any.
    """
    if not entities:
        return F.transform(sentences(text), lambda s: F.lit(True))
    whole = F.split(F.coalesce(text, F.lit("")), rf"(?<=[.!?])(?={BLANK})")
    # where each piece ends, less the blanks behind it
    sizes = F.transform(whole, lambda p: F.struct(F.length(p).alias("n"), F.length(F.regexp_replace(p, rf"{BLANK}+\z", "")).alias("m")))
    none = F.array().cast("array<int>")
    ends = F.aggregate(
        sizes, F.struct(F.lit(0).alias("at"), none.alias("ends")), lambda a, s: F.struct((a["at"] + s["n"]).alias("at"), F.when(s["m"] > 0, F.concat(a["ends"], F.array(a["at"] + s["m"]))).otherwise(a["ends"]).alias("ends")), lambda a: a["ends"]
    )
    return F.transform(ends, lambda e: safe_cut(protected_zones(F.coalesce(text, F.lit("")), entities), e))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def boundary_scores(vectors: np.ndarray, starts: np.ndarray, narrow: int = 1, wide: int = 5, scope: int = 5) -> np.ndarray:
    """For each sentence but the last of a document, the cosine of the mean vectors before and behind its end; of the last, 0.

    vectors of the sentences of all documents end to end, document i from starts[i] to starts[i + 1].
    The more the likeness of neighbours varies around a gap, the fewer sentences count, from
    `wide` down to `narrow`. Means come from running sums.
    """
    n = len(vectors)
    sizes = np.diff(starts)
    low, high = np.repeat(starts[:-1], sizes), np.repeat(starts[1:], sizes)
    at = np.arange(1, n + 1)  # the gap behind each sentence
    inner = at < high
    unit = _unit(vectors)
    near = np.append((unit[:-1] * unit[1:]).sum(axis=1), 0.0)
    begin, end = np.maximum(low, at - scope), np.minimum(high, at + scope) - 1
    around = begin[:, None] + np.arange(2 * scope - 1)
    there = around < end[:, None]
    count = there.sum(axis=1)
    values = np.where(there, near[np.minimum(around, n - 1)], 0.0)
    mean = values.sum(axis=1) / np.maximum(count, 1)
    spread = np.where(there, np.square(values - mean[:, None]), 0.0).sum(axis=1) / np.maximum(count - 1, 1)
    spread = np.round(np.where(count > 1, spread, 0.0), DECIMALS)
    width = np.ceil(wide - np.minimum(1.0, spread * 10) * (wide - narrow)).astype(np.int64)
    sums = np.concatenate([np.zeros((1, vectors.shape[1])), np.cumsum(vectors, axis=0)])
    before, behind = np.maximum(low, at - width), np.minimum(high, at + width)
    score = (_unit(sums[at] - sums[before]) * _unit(sums[behind] - sums[at])).sum(axis=1)
    return np.where(inner, np.round(score, DECIMALS), 0.0)


def _first_over(total: np.ndarray, begin: int, limit: float, safe: np.ndarray, least: int) -> int:
    """The first sentence from `least` on with which those from `begin` on exceed the limit and that ends safely."""
    over = max(least, int(np.searchsorted(total, total[begin] + limit, side="right")) - 1)
    at = np.searchsorted(safe, over)
    return int(safe[at]) if at < len(safe) else len(total)


def ends_by_meaning(scores: np.ndarray, tokens: np.ndarray, safe: np.ndarray, threshold: float, limit: float, narrow: int) -> list[int]:
    """Where the segments of one document end: below the threshold, at a low between higher neighbours, or above the limit."""
    n = len(tokens)
    if n <= narrow:
        return [n] if n else []
    gaps = scores[: n - 1]
    cut = gaps < threshold
    cut[1:-1] |= (gaps[1:-1] < gaps[:-2]) & (gaps[1:-1] < gaps[2:])
    good = np.flatnonzero(safe[: n - 1])
    forced = np.flatnonzero(cut & safe[: n - 1])
    total = np.concatenate([[0], np.cumsum(tokens)])
    ends, begin = [], 0
    while begin < n - 1:
        i = np.searchsorted(forced, begin)
        at = min(int(forced[i]) if i < len(forced) else n, _first_over(total, begin, limit, good, begin))
        if at >= n - 1:
            break
        ends.append(at + 1)
        begin = at + 1
    # the last sentence has no gap behind it: where nothing is open it goes with the last segment
    return [*ends[: -1 if ends and begin == n - 1 else None], n]


def ends_by_surprise(scores: np.ndarray, tokens: np.ndarray, safe: np.ndarray, z: float, limit: float) -> list[int]:
    """Where the segments of one document end: before a sentence `z` sample deviations above the mean, or above the limit."""
    n = len(tokens)
    if n < 2:
        return [n] if n else []
    spread = scores.std(ddof=1)
    above = np.round((scores - scores.mean()) / spread, DECIMALS) if spread > 0 else np.zeros(n)
    odd, good = np.flatnonzero((above > z) & safe), np.flatnonzero(safe)
    total = np.concatenate([[0], np.cumsum(tokens)])
    ends, begin, least = [], 0, 0
    while begin < n:
        i = np.searchsorted(odd, begin + 1)
        before, over = int(odd[i]) if i < len(odd) else n, _first_over(total, begin, limit, good, least)
        if before <= over:  # an odd sentence opens a segment and is not held against the limit yet
            end, least = before, before + 1
        else:
            end = least = over + 1
        ends.append(min(end, n))
        begin = end
    return ends


def _ends(judge: Callable[[list[str], np.ndarray, np.ndarray, np.ndarray], list[list[int]]]):
    """An Arrow function (sentences, tokens, safe) -> ends of segments that calls judge for many documents at once."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, tokens, safe in batches:
            starts = np.concatenate([[0], np.cumsum(text.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
            out: list[list[int]] = []
            begin = 0
            while begin < len(text):
                stop = max(begin + 1, int(np.searchsorted(starts, starts[begin] + CHUNK, side="right")) - 1)
                part = slice(begin, stop)
                own = [x[part].flatten() for x in (text, tokens, safe)]
                out += judge(own[0].to_pylist(), starts[begin : stop + 1] - starts[begin], own[1].to_numpy(), own[2].to_numpy(zero_copy_only=False))
                begin = stop
            yield pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")


def _by_meaning(embed: Embed, threshold: float, limit: int, narrow: int):
    def judge(text, starts, tokens, safe):
        scores = boundary_scores(np.asarray(embed(text), dtype=float), starts, narrow) if text else np.zeros(0)
        return [ends_by_meaning(scores[a:b], tokens[a:b], safe[a:b], threshold, limit, narrow) for a, b in zip(starts[:-1], starts[1:], strict=True)]

    return _ends(judge)


def _by_surprise(score: Score, z: float, limit: int):
    def judge(text, starts, tokens, safe):
        scores = np.asarray(score(text), dtype=float)
        return [ends_by_surprise(scores[a:b], tokens[a:b], safe[a:b], z, limit) for a, b in zip(starts[:-1], starts[1:], strict=True)]

    return _ends(judge)


def _cut(rows: DataFrame, keys: list[str], text: str, number: str, ends_of, entities: list[str]) -> DataFrame:
    """(*keys, number, body): the segments of each row's text."""
    own = sentences(F.col(text))
    tokens = F.transform(own, lambda s: F.coalesce(estimate_tokens(s), F.lit(0)).cast("long"))
    parts = rows.select(*keys, own.alias("_own"), tokens.alias("_tokens"), safe_ends(F.col(text), entities).alias("_safe"))
    ends = parts.select(*keys, "_own", ends_of("_own", "_tokens", "_safe").alias("_ends"))
    begins = F.slice(F.concat(F.array(F.lit(0)), F.col("_ends")), 1, F.size("_ends"))
    spans = ends.select(*keys, "_own", F.posexplode(F.arrays_zip(begins.alias("a"), F.col("_ends").alias("e"))).alias(number, "_span"))
    return spans.select(*keys, number, F.array_join(F.slice("_own", F.col("_span.a") + 1, F.col("_span.e") - F.col("_span.a")), " ").alias("body"))


def semantic(docs: DataFrame, embed: Embed, threshold: float = 0.7, limit: int = 1000, narrow: int = 1, entities: list[str] = ()) -> DataFrame:
    """(doc_id, segment, body) of docs(doc_id, text), cut where the mean vectors of neighbouring sentences part, at `limit` tokens at the latest, and never inside a protected run.

    embed(sentences) gives one vector for each. Null and blank texts have no segment; repeated
    rows are cut each by itself; an empty table gives no rows.
    """
    return _cut(docs, ["doc_id"], "text", "segment", _by_meaning(embed, threshold, limit, narrow), entities)


def surprise(docs: DataFrame, score: Score, z: float = 2.0, limit: int = 800, entities: list[str] = ()) -> DataFrame:
    """(doc_id, segment, body) of docs(doc_id, text), cut before sentences whose score is far above the text's mean, and at `limit` tokens.

    score(sentences) gives one number for each, such as a perplexity. Null and blank texts have no
    segment; repeated rows are cut each by itself; an empty table gives no rows.
    """
    return _cut(docs, ["doc_id"], "text", "segment", _by_surprise(score, z, limit), entities)


def hybrid(docs: DataFrame, embed: Embed, score: Score, limit: int = 1000, entities: list[str] = ()) -> DataFrame:
    """(doc_id, segment, body): structural segments of twice the limit, cut by meaning, and these by surprise; numbered through each document."""
    from pyspark.sql import Window as W

    keyed = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), "doc_id").alias("doc_id"), "text")
    parts = segments(keyed, limit * 2).select("doc_id", F.col("segment").alias("part"), "body")
    pieces = _cut(parts, ["doc_id", "part"], "body", "piece", _by_meaning(embed, 0.7, limit, 1), entities)
    bits = _cut(pieces, ["doc_id", "part", "piece"], "body", "bit", _by_surprise(score, 2.0, limit), entities)
    at = F.row_number().over(W.partitionBy("doc_id").orderBy("part", "piece", "bit")) - 1
    return bits.withColumn("segment", at).select("doc_id.doc_id", "segment", "body")


def register_segmenters(spark: SparkSession, embed: Embed, score: Score) -> None:
    """Make the segmenters table functions of SQL: meaning_segments and surprise_segments.

    select * from meaning_segments(table(select doc_id, text from docs) partition by doc_id)
    gives (doc_id, segment, body). A row is cut as it comes, so a partition holds one document's
    rows at a time and nothing more.
    """
    from pyspark.sql.functions import udtf

    from .segment_tables import by_meaning, by_surprise

    for name, handler in (("meaning_segments", by_meaning(embed)), ("surprise_segments", by_surprise(score))):
        spark.udtf.register(name, udtf(handler, returnType="doc_id long, segment int, body string"))
