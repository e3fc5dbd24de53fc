"""Vectorised hashing of the words of an Arrow column, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SALT = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """_BASE**0 ... modulo 2**64, at least n of them."""
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 1024), _BASE, dtype=np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers; changes x in place and returns it."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows end to end, and where each row starts (and the last ends); null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, budget: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Record batches of about `budget` text bytes (or one longer row), to bound working memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column("text"))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + budget, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash of each word, the row that it is in, and the byte at which it starts; `space` flags the bytes between words."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~space[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    rows = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[rows] = inside[rows]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    body = data[starts[0] :]
    at = np.arange(len(body), dtype=np.int64) - np.repeat(starts - starts[0], np.diff(np.append(starts, len(data))))
    coded = _SALT[LOWER[body] if lower else body] * inside[starts[0] :]
    coded *= powers(int(at.max()) + 1)[at]
    hashes = np.add.reduceat(coded, starts - starts[0])
    return mix(hashes), np.searchsorted(offsets, starts, side="right") - 1, starts


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of a row, and their rows."""
    if n == 1:
        return hashes, rows
    if len(hashes) < n:
        return hashes[:0], rows[:0]
    m = len(hashes) - n + 1
    out = np.zeros(m, dtype=np.uint64)
    for i in range(n):
        out += hashes[i : i + m] * powers(n + 1)[i + 1]
    same = rows[:m] == rows[n - 1 :]
    return mix(out[same]), rows[:m][same]
