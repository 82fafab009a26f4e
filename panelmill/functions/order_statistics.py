"""Order statistics of many ranges of an array at once."""

from __future__ import annotations

import numpy as np


class RangeSelect:
    """The k-th smallest value of any range of an array, for many ranges in a few vector steps.

    A wavelet matrix over the ranks of the values: one level per bit, each with the running
    count of zeros, so that a range is carried from level to level by two look-ups.
    """

    def __init__(self, values: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.values = values[order]
        ranks = np.empty(len(values), np.int64)
        ranks[order] = np.arange(len(values))
        self.levels = []
        for bit in range(max(len(values) - 1, 0).bit_length() - 1, -1, -1):
            ones = (ranks >> bit) & 1 == 1
            zeros = np.concatenate([[0], np.cumsum(~ones)])
            self.levels.append((bit, zeros))
            ranks = np.concatenate([ranks[~ones], ranks[ones]])

    def kth(self, start: np.ndarray, stop: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The values with `k` (from 0) smaller ones before them in `[start, stop)`, ties by place."""
        found = np.zeros(len(k), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[start], zeros[stop]
            up = k >= b - a
            found |= up.astype(np.int64) << bit
            k = np.where(up, k - (b - a), k)
            start, stop = np.where(up, zeros[-1] + start - a, a), np.where(up, zeros[-1] + stop - b, b)
        return self.values[found]

    def quantile(self, start: np.ndarray, stop: np.ndarray, q: float, size: np.ndarray | None = None,
                 below: int = 0) -> np.ndarray:
        """Linearly interpolated quantile of each range.

        Where the ranges stand for sets of `size` values, of which the `below` smallest and
        some of the largest are not in the array, it is the quantile of those sets.
        """
        size = stop - start if size is None else size
        at = q * (size - 1)
        low = np.floor(at).astype(np.int64)
        high = np.minimum(low + 1, size - 1)
        a, b = (self.kth(start, stop, k - below) for k in (low, high))
        return a + (b - a) * (at - low)


def frame_parts(block: np.ndarray, n: np.ndarray, window: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """How the centred frames of a block of positions overlap: `(first, inner, outer, end)`.

    All frames of the block hold the whole blocks in `[inner, outer)`; they begin at or after
    `first`, up to `inner`, and end between `outer` and `end`. For windows of four blocks or more.
    """
    begin, stop = block * size, np.minimum((block + 1) * size, n)
    first, last_first = np.maximum(0, begin - window // 2), np.maximum(0, stop - 1 - window // 2)
    first_end, end = (np.minimum(n, p + (window - 1) // 2 + 1) for p in (begin, stop - 1))
    inner = -(-last_first // size) * size
    return first, inner, np.where(first_end >= n, n, first_end // size * size), end


def frame_of(position: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The frame `[start, stop)` of each position, cut off at both ends of the series."""
    return np.maximum(0, position - window // 2), np.minimum(n, position + (window - 1) // 2 + 1)


def inner_ranks(block: int, n: int, window: int, size: int, q: float) -> tuple[int, int]:
    """The ranks among the values in `[inner, outer)` that quantile `q` of any frame of the block can have.

    At most as many of a frame's smaller values lie outside as there are values outside, so
    the ranks span some blocks, however long the window is.
    """
    first, inner, outer, end = (int(x) for x in frame_parts(block, n, window, size))
    start, stop = frame_of(np.array([block * size, min((block + 1) * size, n) - 1]), n, window)
    least, most = int((stop - start).min()), min(window, n)
    low = int(np.floor(q * (least - 1))) - (inner - first) - (end - outer)
    return max(0, low), min(outer - inner - 1, int(np.floor(q * (most - 1))) + 1)
