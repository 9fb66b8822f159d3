"""Suffix arrays over code points: every occurrence of every piece in a batch of text, in numpy."""

from __future__ import annotations

import numpy as np


def packed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The alphabet, and for each place as many symbols from there as fit into 62 bits, with their number and width.

    A symbol is its rank in the alphabet, from 1; 0 stands for the end.
    """
    alphabet, rank = np.unique(codes, return_inverse=True)
    bits = int(len(alphabet)).bit_length()
    per = max(1, 62 // bits)
    rank = rank.astype(np.int64) + 1
    key = rank.copy()
    for i in range(1, per):
        key <<= bits
        key[: max(0, len(codes) - i)] |= rank[i:]
    return alphabet, key, per, bits


def suffix_array(key: np.ndarray, width: int, depth: int) -> np.ndarray:
    """Starts of all suffixes, ordered by their first ``depth`` symbols at least, by prefix doubling.

    ``key`` orders them by their first ``width`` symbols.
    """
    n = len(key)
    order = np.argsort(key)
    while width < depth and width < n:
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        if rank[order[-1]] == n:
            break
        second = np.zeros(n, np.int64)
        second[:-width] = rank[width:]
        key = rank * (n + 2) + second
        order = np.argsort(key)
        width *= 2
    return order


class Patterns:
    """Strings to search for, in order of their code points, as a padded matrix; ``place`` says which one a row is."""

    def __init__(self, strings: list[str]):
        self.place = np.array(sorted(range(len(strings)), key=strings.__getitem__), np.int32)
        self.length = np.array([len(strings[i]) for i in self.place], np.int32)
        self.depth = int(self.length.max(initial=0))
        self.codes = np.zeros((len(strings), self.depth), np.int32)
        for k, i in enumerate(self.place):
            self.codes[k, : self.length[k]] = [ord(c) for c in strings[i]]
        self.inside = np.arange(self.depth) < self.length[:, None]
        self.rank = np.zeros(0x110001, np.int32)

    def ranked(self, alphabet: np.ndarray) -> np.ndarray:
        """The strings' symbols as ranks in an alphabet, from 1; 0 where a string has ended, -1 for a symbol that isn't in it."""
        self.rank[alphabet] = np.arange(1, len(alphabet) + 1)
        found = self.rank[self.codes]
        self.rank[alphabet] = 0
        return np.where(self.inside, np.where(found > 0, found, -1), 0)


def _bound(codes: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: int, symbol: np.ndarray, after: bool) -> np.ndarray:
    """Binary search in [lo, hi) of the suffix array for the first suffix whose symbol ``at`` reaches (or passes) symbol."""
    lo, hi = lo.copy(), hi.copy()
    live = np.flatnonzero(lo < hi)
    while len(live):
        middle = (lo[live] + hi[live]) >> 1
        there = codes[order[middle] + at]
        below = there <= symbol[live] if after else there < symbol[live]
        lo[live[below]] = middle[below] + 1
        hi[live[~below]] = middle[~below]
        live = live[lo[live] < hi[live]]
    return lo


def occurrences(codes: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(start, pattern number) of all occurrences. Symbols of codes are code points or, to separate texts, larger.

    A pattern's range in the suffix array is found by binary search: at once for the symbols that a packed key holds,
    then symbol by symbol.
    """
    alphabet, key, per, bits = packed(codes)
    order = suffix_array(key, per, patterns.depth)
    held = key[order]
    ranked = patterns.ranked(alphabet)
    able = np.flatnonzero((ranked >= 0).all(axis=1))
    length = patterns.length[able]
    low = np.zeros(len(able), np.int64)
    for i in range(per):
        low <<= bits
        if i < patterns.depth:
            low |= ranked[able, i]
    high = low + (np.int64(1) << (bits * np.maximum(per - length, 0)).astype(np.int64))
    lo, hi = np.searchsorted(held, low), np.searchsorted(held, high)
    padded = np.concatenate([codes, np.full(patterns.depth + 1, -1, codes.dtype)])
    for at in range(per, patterns.depth):
        live = np.flatnonzero((length > at) & (lo < hi))
        symbol = patterns.codes[able[live], at]
        first = _bound(padded, order, lo[live], hi[live], at, symbol, False)
        hi[live] = _bound(padded, order, first, hi[live], at, symbol, True)
        lo[live] = first
    count = hi - lo
    found = np.repeat(patterns.place[able], count)
    first = np.cumsum(count) - count
    return order[np.arange(len(found)) - np.repeat(first - lo, count)].astype(np.int32), found
