"""Two-dimensional range reporting: which places of a sequence lie in an interval and hold a value in another, for many queries at once."""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Values 0..2**bits-1 of a sequence, bit by bit: a level holds the values in the order of their higher bits, and for each place how many zeros of
    the level's bit stand before it."""

    def __init__(self, values: np.ndarray):
        v = np.asarray(values, np.int64)
        self.n, self.bits = len(v), max(1, int(v.max(initial=0)).bit_length())
        self.zeros, place = [], np.arange(self.n)
        for level in range(self.bits - 1, -1, -1):
            bit = (v >> level) & 1
            before = np.zeros(self.n + 1, np.int64)
            np.cumsum(1 - bit, out=before[1:])
            self.zeros.append(before)
            order = np.argsort(bit, kind="stable")
            v, place = v[order], place[order]
        self.place = place

    def report(self, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of all places in [lo, hi) with values in [low, high). Nodes whose values all lie outside, and empty ones, are left."""
        query = np.arange(len(lo))
        node = np.zeros(len(lo), np.int64)
        keep = (lo < hi) & (low < high)
        query, node, lo, hi = query[keep], node[keep], np.asarray(lo)[keep], np.asarray(hi)[keep]
        for i, before in enumerate(self.zeros):
            span = self.bits - 1 - i
            a, b, all_zeros = before[lo], before[hi], before[self.n]
            query = np.concatenate([query, query])
            node = np.concatenate([node * 2, node * 2 + 1])
            lo, hi = np.concatenate([a, all_zeros + lo - a]), np.concatenate([b, all_zeros + hi - b])
            first = node << span
            keep = (lo < hi) & (first < high[query]) & (first + (1 << span) > low[query])
            query, node, lo, hi = query[keep], node[keep], lo[keep], hi[keep]
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.repeat(query, size), self.place[at]
