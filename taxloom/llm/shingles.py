"""Word shingles of whole texts as 64-bit hashes, and their MinHash signatures, in numpy."""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 20
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_RNG.integers(1, 1 << 62)) * 2 + 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values; x is sorted in place."""
    x.sort()
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            factors = np.full(n + 1, base, np.uint64)
            factors[0] = 1
            _powers[i] = np.multiply.accumulate(factors)
    return _powers[0], _powers[1]


def _chunk_words(data: np.ndarray) -> np.ndarray:
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start])


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word of an UTF-8 text, A to Z lower-cased, split at ASCII white space."""
    data = np.frombuffer(text.lower(), np.uint8)
    if len(data) <= CHUNK:
        return _chunk_words(data)
    parts, at = [], 0
    while at < len(data):  # a hash doesn't depend on the place, so a text is cut at any white space
        to = min(len(data), at + CHUNK)
        while to < len(data) and not _SPACE[data[to]]:
            to += 1
        parts.append(_chunk_words(data[at:to]))
        at = to
    return np.concatenate(parts)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The sorted set of hashes of the text's k-word shingles; with fewer words, of the whole sequence."""
    words = word_hashes(text or b"")
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total = mixed(total + words[i : n - width + 1 + i])
    return distinct(total)


class Minima:
    """Universal hash minima of a set: bands * rows hashes a x + b modulo 2**32 with odd a."""

    def __init__(self, bands: int, rows: int):
        draw = np.random.default_rng(97)
        n = bands * rows
        self.bands, self.rows = bands, rows
        self.a = draw.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)[:, None] | np.uint32(1)
        self.b = draw.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)[:, None]
        self.salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 2048):
            np.minimum(out, (self.a * x[i : i + 2048] + self.b).min(axis=1), out=out)
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """One bucket key for each band."""
        key = self.salt
        for row in minima.reshape(self.bands, self.rows).T:
            key = mixed(key + row)
        return key.view(np.int64)
