"""Locally consistent parsing of texts into hierarchical phrases, in numpy."""

from __future__ import annotations

import numpy as np

from taxloom.llm.shingles import distinct, mixed

LEVELS = 3
FEW = 32
SKETCH = 64
_ONE = np.uint64(1)


def _coin_table(n: int) -> np.ndarray:
    """The next label of each pair (previous, own) of labels under n: twice the lowest differing bit, plus own bit."""
    a, b = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    differ = a ^ b
    low = np.bitwise_count((differ & -differ) - 1).astype(np.int64)
    low[differ == 0] = 0
    return (2 * low + ((b >> low) & 1)).astype(np.uint8)


_COIN = _coin_table(128).ravel()


def landmarks(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases start, for names of which no two neighbours are equal; ``first`` marks each text's first name.

    Deterministic coin tossing: four rounds replace a name by the place and value of the lowest bit in which it
    differs from its predecessor, which leaves labels under six and neighbours unequal. Phrases start at local maxima,
    so a start depends on five names to the left and one to the right only.
    """
    previous = np.empty_like(names)
    previous[0] = ~names[0]
    previous[1:] = names[:-1]
    previous[first] = ~names[first]
    differ = previous ^ names
    low = np.bitwise_count((differ & (~differ + _ONE)) - _ONE).astype(np.uint64)
    label = (low + low + ((names >> low) & _ONE)).astype(np.uint8)
    heads = np.flatnonzero(first)
    pair = np.empty(len(label), np.uint16)
    for _ in range(3):
        np.multiply(label[:-1], np.uint16(128), out=pair[1:], dtype=np.uint16)
        pair[heads] = (label[heads] ^ 1).astype(np.uint16) * 128
        pair += label
        label = _COIN[pair]
    small = label.view(np.int8)
    left, right = np.full_like(small, -1), np.full_like(small, -1)
    left[1:], right[:-1] = small[:-1], small[1:]
    left[first] = -1
    right[np.flatnonzero(first[1:])] = -1
    return first | ((small > left) & (small >= right))


def _grouped(names: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One name for each group of names, from their values, order and number."""
    at = np.flatnonzero(starts)
    size = np.diff(at, append=len(names))
    place = (np.arange(len(names)) - np.repeat(at, size)).astype(np.uint64)
    spread = names * (place * np.uint64(0x9E3779B97F4A7C16) + np.uint64(0xD6E8FEB86659FD93))
    spread ^= spread >> np.uint64(32)
    return mixed(np.add.reduceat(spread, at) + size.astype(np.uint64))


def _parsed(names: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level up: runs of equal names become one name, then names become phrases."""
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (text_of[1:] != text_of[:-1])
    if not new.all():
        run = np.diff(np.flatnonzero(new), append=len(names))
        names, text_of = names[new], text_of[new]
        names = np.where(run > 1, mixed(mixed(names) ^ run.astype(np.uint64)), names)
    first = np.ones(len(names), bool)
    first[1:] = text_of[1:] != text_of[:-1]
    starts = landmarks(names, first)
    return _grouped(names, starts), text_of[starts]


def fingerprints(texts: list[str]) -> list[np.ndarray]:
    """For each text, two sketches in one sorted array: the ``SKETCH`` smallest hashes of each kind of its phrase names.

    Names of levels 2 and 3 (phrases of about 10 and 35 characters) have even 32-bit hashes, names of level 1 (about 3
    characters) odd ones. What a fingerprint holds doesn't depend on the text's length.
    """
    out = [np.empty(0, np.uint32)] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    points = [np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32) for i in full]
    names = np.concatenate(points).astype(np.uint64) + _ONE
    text_of = np.repeat(np.arange(len(full)), [len(p) for p in points])
    found = []
    for level in range(1, LEVELS + 1):
        names, text_of = _parsed(names, text_of)
        hashes = mixed(names + np.uint64(level)) >> np.uint64(32)
        found.append((text_of.astype(np.uint64) << np.uint64(32)) | (hashes | _ONE if level == 1 else hashes & ~_ONE))
    keys = distinct(np.concatenate(found))
    ends = np.searchsorted(keys, (np.arange(len(full) + 1, dtype=np.uint64)) << np.uint64(32))
    low = keys.astype(np.uint32)
    for k, i in enumerate(full):
        own = low[ends[k] : ends[k + 1]]
        odd = (own & 1).astype(bool)
        out[i] = own[np.where(odd, np.cumsum(odd), np.cumsum(~odd)) <= SKETCH]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases: of the smallest hashes of the union, those in both. Two empty ones: 1.

    A share of s is met within sqrt(s (1 - s) / ``SKETCH``), 0.0625 at most, as standard error. Phrases of levels 2 and 3
    count; where either text has under ``FEW`` of those, the names of level 1 of both count too.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    high, other = a[a & 1 == 0], b[b & 1 == 0]
    if min(len(high), len(other)) >= FEW:
        a, b = high, other
    union = np.union1d(a, b)[:SKETCH]
    last = union[-1]
    both = len(np.intersect1d(a[a <= last], b[b <= last], assume_unique=True))
    return both / len(union)
