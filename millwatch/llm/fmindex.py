"""A compressed full-text index over integer sequences: BWT in a bit-packed wavelet matrix.

The order of the suffixes is settled up to ``depth`` symbols, which suffices to search patterns of
that length and keeps building time independent of long repeats. The suffix array is dropped after building.
"""

from __future__ import annotations

import numpy as np


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``s`` sorted by their first ``depth`` symbols (or more), by prefix doubling."""
    n = len(s)
    rank = s.astype(np.int64)
    order, h = np.argsort(rank), 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        if h < n:
            after[:-h] = rank[h:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + after if h < depth else rank
        order = np.argsort(key)
        if h >= depth:
            return order
        ranked = key[order]
        fresh = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        h *= 2
        if n and fresh[-1] == n - 1:
            return order


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=bool)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1])).astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)


class FMIndex:
    """Symbols are 0..sigma-1."""

    def __init__(self, s: np.ndarray, depth: int) -> None:
        self.size, self.depth = len(s), depth
        sigma = int(s.max(initial=0)) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=sigma))))
        bwt = s[suffix_order(s, depth) - 1]  # the text is taken as a ring
        self.levels: list[Bits] = []
        width = max(1, int(sigma - 1).bit_length())
        for k in reversed(range(width)):
            bits = (bwt >> k) & 1 == 1
            self.levels.append(Bits(bits))
            bwt = np.concatenate((bwt[~bits], bwt[bits]))
        symbols = np.arange(sigma)
        self.shift = self.first[:-1] - self._descend(symbols, np.zeros(sigma, dtype=np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in zip(reversed(range(len(self.levels))), self.levels, strict=True):
            ones = level.rank(i)
            i = np.where((c >> k) & 1 == 1, level.zeros + ones, i - ones)
        return i

    def extend(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the intervals of cP from those of P."""
        both = self._descend(np.concatenate((c, c)), np.concatenate((low, high)))
        shift = self.shift[c]
        return both[:len(c)] + shift, both[len(c):] + shift

    def repeats(self, s: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the patterns s[start : start + length], the numbers of those that occur twice or more and their intervals' starts.

        A pattern whose interval shrinks to one occurrence is given up at once.
        """
        alive = np.arange(len(starts))
        c = s[starts + length - 1]
        low, high = self.first[c], self.first[c + 1]
        for k in range(length - 2, -1, -1):
            many = high - low > 1
            alive, low, high = alive[many], low[many], high[many]
            if not len(alive):
                break
            low, high = self.extend(s[starts[alive] + k], low, high)
        many = high - low > 1
        return alive[many], low[many]
