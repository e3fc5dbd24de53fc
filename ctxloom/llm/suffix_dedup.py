"""Removal of long repeated byte strings by a run-length compressed index.

Windows of `length` bytes are dealt by their least `GRAM`-byte hash, so that equal windows
always meet, and consecutive windows with the same least hash travel as one stretch of text.
Only stretches whose hash occurs in other text too are indexed. The index is the
Burrows-Wheeler transform of the stretches in runs, with suffix-array samples at run ends:
inside a run, the longest common prefix of a text position with its neighbour in the suffix
array is one less than that of the position before, so the samples give the matching
statistics of every position in one pass over the text. Positions with a match of at least
`length` bytes start a repeated window.

A hash with very many different surroundings would be one large index. It is indexed in parts of
bounded size instead, and what repeats only across parts is found by cutting its stretches again
by the least hash of longer and longer strings, at last whole windows, and counting equal ones; so
no index grows with a passage's popularity.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mark, materialize, release_since
from .hashing import mix, slices, text_bytes

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_UP = np.ones(1, np.uint64)
_DOWN = np.ones(1, np.uint64)
_SALT = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)
#: Text bytes that one index holds, unless a single hash has more.
INDEX_BYTES = 1 << 20
#: Different text bytes of one hash beyond which its stretches are cut again by longer strings: more than an index holds.
HOT_BYTES = INDEX_BYTES
BROADCAST_IDS = 1_000_000


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        n = max(n, 1 << 16)
        _UP, _DOWN = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        _UP[0] = _DOWN[0] = 1
        _UP, _DOWN = np.multiply.accumulate(_UP), np.multiply.accumulate(_DOWN)
    return _UP, _DOWN


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes from each position on."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SALT[data] * up[: len(data)], out=total[1:])
    n = len(data) - gram + 1
    return mix((total[gram:] - total[:-gram]) * down[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values, from minima towards both ends of blocks of w."""
    n = len(x)
    full = -(-n // w) * w
    padded = np.full(full, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def stretches(data: np.ndarray, length: int, gram: int, look: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least hash, first window start, number of windows, and (if `look`) whether the hash occurs again inside, for each stretch."""
    hashes = gram_hashes(data, gram)
    least = sliding_min(hashes, length - gram + 1)
    cut = np.flatnonzero(least[1:] != least[:-1]) + 1
    start = np.concatenate([[0], cut])
    count = np.diff(np.append(start, len(least)))
    key = least[start]
    if not look:
        return key, start, count, np.zeros(len(start), bool)
    again = np.array([np.count_nonzero(hashes[s : s + c + length - gram] == k) > 1 for s, c, k in zip(start, count, key, strict=True)], bool)
    return key, start, count, again


def _cut(length: int, gram: int):
    def run(batches):
        for part in slices(batches):
            data, offsets = text_bytes(part.column("text"))
            out = [[], [], [], [], [], []]
            for i, key in enumerate(part.column("text_key").to_pylist()):
                own = data[offsets[i] : offsets[i + 1]]
                if len(own) < length:
                    continue
                hashes, start, count, again = stretches(own, length, gram)
                raw = own.tobytes()
                out[0].append(hashes.view(np.int64))
                out[1].extend([key] * len(start))
                out[2].append(start)
                out[3].append(count)
                out[4].append(again)
                out[5].extend(hashlib.blake2b(raw[s : s + c + length - 1], digest_size=16).digest() for s, c in zip(start.tolist(), count.tolist(), strict=True))
            if out[1]:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(out[0])),
                        pa.array(out[1], pa.binary()),
                        pa.array(np.concatenate(out[2]).astype(np.int32)),
                        pa.array(np.concatenate(out[3]).astype(np.int32)),
                        pa.array(np.concatenate(out[4])),
                        pa.array(out[5], pa.binary()),
                    ],
                    ["anchor", "text_key", "start", "windows", "again", "content"],
                )

    return run


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array (int32) of int32 symbols by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    places = np.arange(n, dtype=np.int32)
    # the first key packs as many symbols as fit 62 bits
    key = text.astype(np.int64)
    held, bits = 1, int(key.max() + 2).bit_length()
    key += 1
    while held * 2 * bits <= 62:
        shifted = np.zeros(n, np.int64)
        shifted[: n - held] = key[held:]
        key <<= bits * held
        key |= shifted
        held *= 2
        del shifted
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    del key
    group = np.maximum.accumulate(np.where(new, places, np.int32(0)))
    rank = np.empty(n, np.int32)
    rank[order] = group
    step = held
    while True:
        open_ = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32)
        if not len(open_):
            return order
        at = order[open_]
        after = np.zeros(len(at), np.int32)
        inside = at < n - step
        after[inside] = rank[at[inside] + np.int32(step)] + 1
        del inside
        pair = group[open_].astype(np.int64)
        pair *= n + 2
        pair += after
        del after
        inner = np.argsort(pair, kind="stable")
        at, pair = at[inner], pair[inner]
        del inner
        order[open_] = at
        new[open_] |= np.concatenate([[True], pair[1:] != pair[:-1]])
        del pair
        group = np.maximum.accumulate(np.where(new, places, np.int32(0)))
        rank[at] = group[open_]
        step *= 2


class RunIndex:
    """Run-compressed BWT of texts end to end, with suffix-array samples at the ends of its runs."""

    def __init__(self, texts: list[bytes]):
        ends = np.cumsum([len(t) + 1 for t in texts])
        joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int32) + len(texts)
        joined[ends - 1] = np.arange(len(texts))  # separators differ, so no match passes one
        self.starts = np.concatenate([[0], ends[:-1]])
        self.text = joined
        order = suffix_array(joined)
        before = joined[order - 1]
        head = np.concatenate([[True], before[1:] != before[:-1]])
        self.runs = int(head.sum())
        heads = np.flatnonzero(head)
        # samples: the first suffix of each run with the one above it, the last with the one below it
        self.first, self.above = order[heads[1:]], order[heads[1:] - 1]
        self.last, self.below = self.above, self.first

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefixes of pairs of positions; separators end them."""
        n, out = len(self.text), np.zeros(len(a), np.int32)
        at = np.arange(64, dtype=np.int32)
        for begin in range(0, len(a), 8192):  # so few pairs at a time bound the working memory
            open_ = np.arange(begin, min(begin + 8192, len(a)))
            while len(open_):
                x = self.text[np.minimum((a[open_] + out[open_])[:, None] + at, n - 1)]
                y = self.text[np.minimum((b[open_] + out[open_])[:, None] + at, n - 1)]
                same = x == y
                full = same.all(axis=1)
                out[open_] += np.where(full, 64, same.argmin(axis=1))
                open_ = open_[full]
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each text position, the longest match that starts at some other position too."""
        common = self._common(self.first, self.above)
        best = np.zeros(len(self.text), np.int32)
        places = np.arange(len(self.text), dtype=np.int32)
        for at in (self.first, self.last):
            # from a sampled position on, each next position matches one byte less, so that
            # position plus match stays as it is until the next sample
            until = np.zeros(len(self.text), np.int32)
            here = np.zeros(len(self.text), np.int32)
            until[at] = at + common
            here[at] = at
            np.maximum.accumulate(here, out=here)
            np.maximum(best, until[here] - places, out=best)
        return best


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _indexed(batches, columns: list[str], length: int):
    """Rows sorted by their first column, in groups of about INDEX_BYTES or one larger value, each with the runs of its repeated windows."""

    def index(rows):
        built = RunIndex([r[-1] for r in rows])
        long = built.matching_statistics() >= length
        for r, at in zip(rows, built.starts, strict=True):
            yield r, list(zip(*_runs(long[at : at + len(r[-1])]), strict=True))

    rows, size = [], 0
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
            if size >= INDEX_BYTES and r[0] != rows[-1][0]:
                yield list(index(rows))
                rows, size = [], 0
            rows.append(r)
            size += len(r[-1])
    if rows:
        yield list(index(rows))


def _mark(length: int):
    """Rows sorted by anchor in; (text_key, from, to) of the repeated windows out."""

    def run(batches):
        for found in _indexed(batches, ["anchor", "text_key", "start", "body"], length):
            marks = [(r[1], r[2] + a, r[2] + b - 1 + length) for r, runs in found for a, b in runs]
            columns = list(zip(*marks, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.binary(), pa.int64(), pa.int64()], strict=True)], ["text_key", "from", "to"])

    return run


_BODY = "anchor long, text_key binary, start long, known array<struct<first:long,last:long>>, body binary"


def _know(length: int):
    """Rows sorted by cell in, the same rows out with the first and last window of each repeated run."""
    spans = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def run(batches):
        for found in _indexed(batches, ["cell", "anchor", "text_key", "start", "body"], length):
            known = [[{"first": r[3] + int(a), "last": r[3] + int(b) - 1} for a, b in runs] for r, runs in found]
            columns = [pa.array([r[i] for r, _ in found], t) for i, t in ((1, pa.int64()), (2, pa.binary()), (3, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(known, spans), pa.array([r[4] for r, _ in found], pa.binary())], ["anchor", "text_key", "start", "known", "body"])

    return run


def _bodies(length: int):
    def run(batches):
        for b in batches:
            anchors, keys, starts, bodies = [], [], [], []
            for key, text, wanted in zip(b.column("text_key").to_pylist(), b.column("text"), b.column("wanted").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                for w in wanted:
                    anchors.append(w["anchor"])
                    keys.append(key)
                    starts.append(w["start"])
                    bodies.append(raw[w["start"] : w["start"] + w["windows"] + length - 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors, pa.int64()), pa.array(keys, pa.binary()), pa.array(starts, pa.int64()), pa.array(bodies, pa.binary())],
                ["anchor", "text_key", "start", "body"],
            )

    return run


#: Rows that a cut hands on at once.
CHUNK = 20_000
_RECUT = "anchor long, text_key binary, start long, windows long, again boolean, seen boolean, content binary, known array<struct<first:long,last:long>>, body binary"


def _cut_again(length: int, gram: int):
    """Stretches of a hot anchor in, each cut by the least hash of longer strings; `seen` where all windows of a piece are known to repeat.

    Where `gram` is the length of a window, a row is a run of equal windows: its content is one
    window, which needs no body.
    """
    last = gram == length

    def rows(batches):
        for b in batches:
            for anchor, key, base, known, body in zip(*(b.column(c).to_pylist() for c in ("anchor", "text_key", "start", "known", "body")), strict=True):
                least, start, count, again = stretches(np.frombuffer(body, np.uint8), length, gram, not last)
                anchors = mix(least ^ np.uint64(anchor & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
                for x, s, c, more in zip(anchors.tolist(), start.tolist(), count.tolist(), again.tolist(), strict=True):
                    part = body[s : s + (length if last else c + length - 1)]
                    seen = any(k["first"] <= base + s and base + s + c - 1 <= k["last"] for k in known)
                    yield x, key, base + s, c, more, seen, hashlib.blake2b(part, digest_size=16).digest(), known, None if last else part

    def run(batches):
        spans = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), spans, pa.binary()]
        names = [x.split()[0] for x in _RECUT.split(", ")]
        held, size = [], 0
        for row in rows(batches):
            held.append(row)
            size += len(row[-1] or b"")
            if len(held) >= CHUNK or size >= INDEX_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return run


def _marks(bodies: DataFrame, length: int, grams: list[int], first: bool = True) -> list[DataFrame]:
    """Frames (text_key, from, to) of the repeated windows among different stretches (anchor, text_key, start, known, body).

    Anchors of at most HOT_BYTES are indexed whole. Larger ones are indexed in parts of about
    INDEX_BYTES, which finds what repeats in a part; what repeats only across parts is found by
    cutting the stretches by the next of `grams` and counting those that are equal. The last of
    `grams` is `length`, where whole windows are counted, so nothing is left open.
    """

    def index(rows):
        dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "text_key", "start")
        return dealt.mapInArrow(_mark(length), "text_key binary, from long, to long")

    size = bodies.groupBy("anchor").agg(F.sum(F.length("body")).alias("bytes"))
    hot = materialize(size.where(F.col("bytes") > HOT_BYTES).select("anchor", F.ceil(F.col("bytes") / INDEX_BYTES).alias("parts")), "hot")
    number = hot.count()
    if not number:
        return [index(bodies)]
    few = F.broadcast(hot) if number <= BROADCAST_IDS else hot
    out = [index(bodies.join(few, "anchor", "left_anti"))]
    large = bodies.join(few, "anchor").select("anchor", "parts", "text_key", "start", "known", "body")
    if first:
        cell = F.xxhash64("anchor", F.pmod(F.xxhash64("text_key"), F.col("parts")))
        dealt = large.withColumn("cell", cell).select("cell", "anchor", "text_key", "start", "body").repartition("cell").sortWithinPartitions("cell", "text_key", "start")
        large = materialize(dealt.mapInArrow(_know(length), _BODY), "known")
        out.append(large.select("text_key", F.explode("known").alias("k")).select("text_key", F.col("k.first").alias("from"), (F.col("k.last") + length).alias("to")))
    cut = materialize(large.select("anchor", "text_key", "start", "known", "body").mapInArrow(_cut_again(length, grams[0]), _RECUT), "recut")
    last = grams[0] == length
    # a run of equal windows repeats in itself, and equal runs are alike however long they are
    n = F.sum("windows") if last else F.count("*")
    kinds = cut.groupBy("anchor", "content").agg(n.alias("n"), F.max("again").alias("again"), F.min(F.struct("text_key", "start")).alias("one"))
    kinds = materialize(kinds, "rekinds")
    often = kinds.where("n > 1").select("anchor", "content")
    found = cut.where("not seen").join(often, ["anchor", "content"], "left_semi")
    out.append(found.select("text_key", F.col("start").alias("from"), (F.col("start") + F.col("windows") + length - 1).alias("to")))
    if not last:
        shared = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"))
        wanted = kinds.join(shared, "anchor").where("kinds > 1 or again").select("anchor", "one.text_key", "one.start")
        # one row of each kind goes on, with its body
        left = materialize(cut.join(wanted, ["anchor", "text_key", "start"], "left_semi").select("anchor", "text_key", "start", "known", "body"), "rebodies")
        out += _marks(left, length, grams[1:], False)
    return out


def _text_key():
    """128 bits of the text's SHA-256; null is as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32))


def _one_of_each(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """One row of each text of rows(text_key, doc, text): that of the least doc, and one of those if the table repeats it."""
    shared = copies.where("copies > 1").select("text_key", F.col("doc").alias("first"), "same")
    number, most = shared.agg(F.count("*"), F.max("same")).first()
    if not number:
        return rows
    joined = rows.join(F.broadcast(shared) if number <= BROADCAST_IDS else shared, "text_key", "left")
    one = joined.where("first is null or (doc = first and same = 1)").select("text_key", "doc", "text")
    if most > 1:
        # equal rows: each task hands on one of them
        repeated = joined.where("doc = first and same > 1").groupBy("text_key").agg(F.min("doc").alias("doc"), F.min("text").alias("text"))
        one = one.unionByName(repeated)
    return one


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """(text_key, spans): for each distinct text with repeats, its maximal byte spans covered by repeated windows.

    text_key is half the SHA-256 of the text. docs(doc_id, text) are all rows; a text that several rows share
    repeats in all of its windows.
    """
    gram = max(8, length // 4)
    rows = docs.where(F.octet_length("text") >= length).select(_text_key().alias("text_key"), F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), "text")
    counted = rows.groupBy("text_key", "doc").agg(F.count("*").alias("same"), F.min(F.octet_length("text")).alias("n"))
    copies = counted.groupBy("text_key").agg(F.sum("same").alias("copies"), F.min("n").alias("n"), F.min(F.struct("doc", "same")).alias("first"))
    copies = materialize(copies.select("text_key", "copies", "n", "first.doc", "first.same"), "copies")
    copied = copies.where("copies > 1").select("text_key", F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n").cast("long").alias("to"))).alias("spans"))
    hashed = _one_of_each(rows, copies)

    cut = materialize(
        hashed.mapInArrow(_cut(length, gram), "anchor long, text_key binary, start int, windows int, again boolean, content binary"), "stretches"
    )
    # equal stretches of one anchor are one kind; a text that rows share is here once
    kinds = cut.groupBy("anchor", "content").agg(
        F.count("*").alias("n"), F.max("again").alias("again"), F.min(F.struct("text_key", "start", "windows")).alias("one")
    )
    kinds = materialize(kinds, "kinds")
    shared = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"))
    index = kinds.join(shared, "anchor").where("kinds > 1 or again").select("anchor", "one.text_key", "one.start", "one.windows")
    wanted = index.groupBy("text_key").agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("wanted"))
    # one row of each text serves, so no text is hot; few ids thin out the texts before they move
    wanted = materialize(wanted.join(copies.select("text_key", "doc"), "text_key"), "wanted")
    ids = wanted.select("doc").distinct()
    if ids.count() <= BROADCAST_IDS:
        hashed = hashed.join(F.broadcast(ids), "doc", "left_semi")
    texts = hashed.join(wanted, ["doc", "text_key"])
    bodies = texts.select("text_key", "text", "wanted").mapInArrow(_bodies(length), "anchor long, text_key binary, start long, body binary")
    bodies = materialize(bodies.withColumn("known", F.array().cast("array<struct<first:long,last:long>>")), "bodies")
    longer = sorted({x for x in (length // 2, 13 * length // 16, 15 * length // 16, 49 * length // 50, length) if x > gram})
    found = _marks(bodies, length, longer)

    # texts that several rows share are marked whole already
    several = copied.select("text_key")
    if several.count() <= BROADCAST_IDS:
        several = F.broadcast(several)
    often = kinds.where("n > 1").select("anchor", "content")
    whole = cut.join(several, "text_key", "left_anti").join(often, ["anchor", "content"], "left_semi").select(
        "text_key", F.col("start").cast("long").alias("from"), (F.col("start") + F.col("windows") + length - 1).cast("long").alias("to")
    )
    for more in found:
        whole = whole.unionByName(more)
    marks = whole.groupBy("text_key").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("spans"))
    both = marks.join(copied.withColumnRenamed("spans", "all"), "text_key", "full_outer")
    return both.select("text_key", F.coalesce("all", "spans").alias("spans"))


def _union(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans or ():
        a, b = s["from"], s["to"]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _without(raw: bytes, cut: list[tuple[int, int]]) -> bytes:
    return b"".join(raw[a:e] for a, e in zip([0, *(x[1] for x in cut)], [*(x[0] for x in cut), len(raw)], strict=True))


def _whole_characters(raw: bytes, cut: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, shrunk to characters that lie in them whole."""
    out = []
    for a, e in cut:
        while a < e and raw[a] & 0xC0 == 0x80:
            a += 1
        while e > a and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        out.append((a, e))
    return out


def _report(batches):
    for b in batches:
        n, removed, number, digest, left = [], [], [], [], []
        for text, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            cut = _union(spans)
            kept = _without(raw, cut)
            n.append(len(raw))
            removed.append(len(raw) - len(kept))
            number.append(len(cut))
            digest.append(hashlib.sha256(kept).hexdigest())
            left.append(_without(raw, _whole_characters(raw, cut)).decode())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, number)), pa.array(digest, pa.string()), pa.array(left, pa.string())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"],
        )


def removal_report(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text) per row of docs(doc_id, text).

    A byte goes if any `length`-byte string that covers it also starts elsewhere, in the same
    text or another. Null texts are empty; texts shorter than `length` bytes keep everything;
    equal texts of at least `length` bytes lose everything, wherever they stand. Repeated rows
    count as copies. `text` is what is left; where a removed run begins or ends inside a
    character, the whole character stays in it, so it is valid (the digest is of the exact
    bytes). An empty table gives no rows; other columns are not carried.
    """
    joined = docs.select("doc_id", "text", _text_key().alias("text_key")).join(_spans(docs, length), "text_key", "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(
        _report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    )


def _spans(docs: DataFrame, length: int) -> DataFrame:
    """repeated_spans() on disk, with what led to it deleted."""
    point = mark()
    spans = materialize(repeated_spans(docs, length), "spans")
    release_since(point, spans)
    return spans


def _clean(batches):
    for b in batches:
        out = []
        for text, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
            if not text.is_valid:
                out.append(None)
                continue
            raw = text.as_buffer().to_pybytes()
            out.append(_without(raw, _whole_characters(raw, _union(spans))).decode())
        yield pa.RecordBatch.from_arrays([b.column("rest"), pa.array(out, pa.string())], ["rest", "text"])


def remove_repeats(docs: DataFrame, length: int = 240) -> DataFrame:
    """docs with repeated strings of at least `length` bytes taken out of the text; n_chars follows where it exists.

    Rows and their other columns, of any name, stay, also where nothing is left of the text.
    Null texts stay null; an empty table gives no rows.
    """
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("rest"), "text", _text_key().alias("text_key"))
    joined = rows.join(_spans(docs, length), "text_key", "left").select("rest", "text", "spans")
    schema = joined.select("rest", "text").schema
    out = joined.mapInArrow(_clean, schema).select(*[F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
