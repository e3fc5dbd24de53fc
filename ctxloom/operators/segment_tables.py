"""Handlers of the segmenters as table functions, for rows that come one by one."""

from __future__ import annotations

import re

import numpy as np

from ..functions.text import PROTECTED
from .segmentation import boundary_scores, ends_by_meaning, ends_by_surprise

_END = re.compile(r"(?<=[.!?])(?=\s)")
_HELD = re.compile(PROTECTED)


def _tokens(sentence: str) -> int:
    return max(1, int(np.ceil(len(sentence.split()) * 1.3)))


def _parts(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Sentences, their tokens, and whether each ends outside all protected runs."""
    own, ends, at = [], [], 0
    for piece in _END.split(text):
        if piece.strip():
            own.append(piece.strip())
            ends.append(at + len(piece.rstrip()))
        at += len(piece)
    # protected runs come in order and apart from each other: only the last that begins before an end can hold it
    zones = np.array([m.span() for m in _HELD.finditer(text)], np.int64).reshape(-1, 2)
    last = np.searchsorted(zones[:, 0], ends)
    return own, np.array([_tokens(s) for s in own]), np.append(0, zones[:, 1])[last] <= ends


def _rows(doc_id, own: list[str], ends: list[int]):
    for segment, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        yield doc_id, segment, " ".join(own[a:b])


def by_meaning(embed, threshold: float = 0.7, limit: int = 1000, narrow: int = 1):
    class Meaning:
        def eval(self, row):
            own, tokens, safe = _parts(row["text"] or "")
            if own:
                scores = boundary_scores(np.asarray(embed(own), dtype=float), np.array([0, len(own)]), narrow)
                yield from _rows(row["doc_id"], own, ends_by_meaning(scores, tokens, safe, threshold, limit, narrow))

    return Meaning


def by_surprise(score, z: float = 2.0, limit: int = 800):
    class Surprise:
        def eval(self, row):
            own, tokens, safe = _parts(row["text"] or "")
            if own:
                yield from _rows(row["doc_id"], own, ends_by_surprise(np.asarray(score(own), dtype=float), tokens, safe, z, limit))

    return Surprise
