"""Words of many texts at once: bounds, hashes and distinct words as arrays, without one Python object per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lobspark.llm.common import Rolling, mix

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LIFT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Words:
    """``start``/``end`` in ``buffer``; ``bounds[d]`` is the first word of text d; ``first`` and ``which`` name the distinct words."""

    buffer: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    first: np.ndarray
    which: np.ndarray
    hashes: np.ndarray

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        return self.start[self.first], self.end[self.first]


def _of(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, text_start: np.ndarray) -> Words:
    bounds = np.searchsorted(start, text_start)
    if not len(start):
        none = np.zeros(0, dtype=np.int64)
        return Words(buffer, start, end, bounds, none, none, none.astype(np.uint64))
    h = Rolling(LIFT[buffer], 0x9E3779B97F4A7C15).stretches(start, end)
    hashes, first, which = np.unique(h, return_index=True, return_inverse=True)
    return Words(buffer, start, end, bounds, first, which, hashes)


def split_at_space(texts: list[bytes]) -> Words:
    """Words are runs of bytes other than 0x20 and 0x09-0x0D."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    gap = SPACE[buffer]
    edge = np.diff(gap.astype(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sizes = np.array([len(t) + 1 for t in texts])
    return _of(buffer, start, end, np.cumsum(np.concatenate([[0], sizes])))


def split_before_blanks(texts: list[bytes]) -> Words:
    """Parts that begin at the first blank of each run of blanks; one blank is put before every text that is not empty."""
    texts = [b" " + t if t else t for t in texts]
    buffer = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts])
    text_start = np.cumsum(np.concatenate([[0], sizes]))
    blank = buffer == 32
    head = blank.copy()
    head[1:] &= ~blank[:-1]
    head[text_start[:-1][sizes > 0]] = True
    start = np.flatnonzero(head)
    return _of(buffer, start, np.append(start[1:], len(buffer)) if len(start) else start, text_start)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start[0], start[0]+1, ..., then start[1], ...; ``size`` of each."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)
