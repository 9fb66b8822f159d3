"""A linear-chain CRF over words in numpy: hashed affix and n-gram features, a lexicon, exact forward-backward."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np

TABLE = 1 << 15
STEP = 32
_M1, _M2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_ALPHABET: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 for what isn't a letter."""
    if not _ALPHABET:
        low = np.zeros(sys.maxunicode + 2, np.uint32)
        for c in range(sys.maxunicode + 1):
            if (ch := chr(c)).isalpha():
                low[c] = ord(s) if len(s := ch.lower()) == 1 else c
        _ALPHABET.append(low)
    return _ALPHABET[0]


@dataclass
class Words:
    """The words of some texts: where each one's letters start, hashes of its features, its length and place."""

    grams: np.ndarray  # [2, letters]
    first: np.ndarray  # [words]
    affixes: np.ndarray  # [2, words]
    whole: np.ndarray  # [words], 64-bit
    length: np.ndarray  # [words]
    place: np.ndarray  # [words], of the first letter in the text


def words_of(text: str) -> Words:
    """Runs of letters. n-grams of two and three letters take in the word's ends; affixes have up to three letters."""
    points = np.frombuffer(f"\0\0{text}\0\0".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _letters()[points]
    inside = c != 0
    at = np.flatnonzero(inside)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    now, after, before = c[at], c[at + 1], c[at - 1]
    two = (now * _M1 + after * _M2) ^ np.uint32(0x51ED270B)
    three = two * _M1 + before * np.uint32(0xC2B2AE35)
    grams = np.stack([two, three])
    head = (c[start] * _M1 + c[start + 1] * _M2) * _M1 + np.where(end - start > 2, c[np.minimum(start + 2, len(c) - 1)], 0) + np.uint32(77)
    tail = (c[end - 1] * _M2 + c[end - 2] * _M1) * _M2 + np.where(end - start > 2, c[end - 3], 0) + np.uint32(99)
    affixes = np.stack([head, tail])
    for x in (grams, affixes):
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x >>= np.uint32(32 - 15)
    letters = now.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    length = end - start
    first = np.cumsum(length) - length
    place = (np.arange(len(at)) - np.repeat(first, length)).astype(np.uint64)
    spread = (letters ^ (letters >> np.uint64(29))) * (place * np.uint64(2) + np.uint64(0xD6E8FEB86659FD93))
    spread ^= spread >> np.uint64(32)
    whole = np.add.reduceat(spread, first) if len(first) else np.empty(0, np.uint64)
    return Words(grams, first, affixes, whole, length, start - 2)


def _words_of_all(texts: list[str]) -> tuple[Words, np.ndarray]:
    """The words of all texts, and the number in each. Texts are taken one by one, so only the result is held whole."""
    parts = [words_of(t) for t in texts]
    for w in parts:
        w.grams, w.affixes = w.grams.astype(np.uint16), w.affixes.astype(np.uint16)
    letters = np.array([w.grams.shape[1] for w in parts], np.int64)
    before = np.cumsum(letters) - letters

    def joined(name: str, empty: np.ndarray) -> np.ndarray:
        return np.concatenate([empty, *[getattr(w, name) for w in parts]], axis=-1)

    none = np.empty(0, np.int64)
    first = np.concatenate([none, *[w.first + b for w, b in zip(parts, before, strict=True)]])
    words = Words(joined("grams", np.empty((2, 0), np.uint16)), first, joined("affixes", np.empty((2, 0), np.uint16)), joined("whole", np.empty(0, np.uint64)), joined("length", none), joined("place", none))
    return words, np.array([len(w.first) for w in parts], np.int64)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # [TABLE, labels]
    lexicon: np.ndarray  # sorted word hashes
    lexical: np.ndarray  # [lexicon + 1, labels]; the last is of other words
    moves: np.ndarray  # [labels, labels], from and to

    def known(self, whole: np.ndarray) -> np.ndarray:
        n = len(self.lexicon)
        if not n:
            return np.zeros(len(whole), np.intp)
        i = np.minimum(np.searchsorted(self.lexicon, whole), n - 1)
        return np.where(self.lexicon[i] == whole, i, n)

    def emissions(self, words: Words) -> np.ndarray:
        if not len(words.first):
            return np.empty((0, len(self.labels)), np.float32)
        per_letter = self.weights[words.grams[0]]
        per_letter += self.weights[words.grams[1]]
        out = np.add.reduceat(per_letter, words.first, axis=0)
        out += self.weights[words.affixes[0]]
        out += self.weights[words.affixes[1]]
        out += self.lexical[self.known(words.whole)]
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def marginals(emissions: np.ndarray, sizes: np.ndarray, moves: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Each word's label probabilities by forward-backward over sequences of the given sizes (all over 0).

    Given all words, and given the words up to it.

    A sequence is cut into blocks of ``step`` words. A block's effect is a matrix, so vectors are handed over from
    block to block, and all blocks run at once; the result is that of one pass from end to end.
    """
    n_labels = emissions.shape[1]
    potential = np.exp(emissions - emissions.max(axis=1, keepdims=True)) + np.float32(1e-30)
    move = np.exp(moves - moves.max()).astype(np.float32)
    blocks = -(-sizes // step)
    start = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    at = np.arange(len(emissions)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, col = np.repeat(start, sizes) + at // step, at % step
    grid = np.ones((step, total, n_labels), np.float32)
    there = np.zeros((step, total), bool)
    grid[col, row], there[col, row] = potential, True

    effect = np.broadcast_to(np.eye(n_labels, dtype=np.float32), (total, n_labels, n_labels)).copy()
    for s in range(step):
        new = (effect.reshape(-1, n_labels) @ move).reshape(effect.shape) * grid[s][:, None, :]
        new /= new.max(axis=(1, 2), keepdims=True)
        effect = np.where(there[s][:, None, None], new, effect)

    into = np.full((total, n_labels), 1 / n_labels, np.float32)
    outof = np.full((total, n_labels), 1 / n_labels, np.float32)
    order = np.argsort(-blocks, kind="stable")
    ranked = blocks[order]
    for k in range(1, int(blocks.max(initial=0))):
        live = start[order[: np.searchsorted(-ranked, -k, side="left")]]
        into[live + k] = _unit(np.einsum("bi,bij->bj", into[live + k - 1], effect[live + k - 1]))
    ends = start + blocks - 1
    for k in range(1, int(blocks.max(initial=0))):
        live = ends[order[: np.searchsorted(-ranked, -k, side="left")]]
        outof[live - k] = _unit(np.einsum("bj,bij->bi", outof[live - k + 1], effect[live - k + 1]))

    forward, both = np.empty_like(grid), np.empty_like(grid)
    now = into
    for s in range(step):
        now = np.where(there[s][:, None], _unit((now @ move) * grid[s]), now)
        forward[s] = now
    now = outof
    for s in range(step - 1, -1, -1):
        np.multiply(forward[s], now, out=both[s])
        now = np.where(there[s][:, None], _unit((now * grid[s]) @ move.T), now)
    return _unit(both[col, row]), forward[col, row]


def train(texts: list[str], labels: list[str], epochs: int = 3, window: int = 64, run: float = 20.0, seed: int = 5, rate: float = 0.3) -> Model:
    """Fit the weights to labelled texts by Adagrad on the conditional likelihood.

    Every word has its text's label. So that moves between labels are learned, training sequences are spliced from
    runs of words of random texts, of ``run`` words in the mean. The lexicon has the words seen 20 times or more.
    """
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    code = {s: i for i, s in enumerate(names)}
    n_labels = len(names)
    words, per_text = _words_of_all(texts)
    gold = np.repeat(np.array([code[s] for s in labels], np.int64), per_text)
    seen, counts = np.unique(words.whole, return_counts=True)
    model = Model(names, np.zeros((TABLE, n_labels), np.float32), seen[counts >= 20], np.zeros((int((counts >= 20).sum()) + 1, n_labels), np.float32), np.zeros((n_labels, n_labels)))
    if not len(gold) or n_labels < 2:
        return model
    known = model.known(words.whole)
    begin = np.cumsum(per_text) - per_text
    full = np.flatnonzero(per_text)
    size = np.append(words.first[1:], words.grams.shape[1]) - words.first
    square = {k: np.full(getattr(model, k).shape, 1e-2) for k in ("weights", "lexical", "moves")}

    def sequence(n: int) -> np.ndarray:
        out, left = [], n
        while left > 0:
            t = full[rng.integers(len(full))]
            k = min(left, int(per_text[t]), 1 + int(rng.exponential(run)))
            s = begin[t] + rng.integers(per_text[t] - k + 1)
            out.append(np.arange(s, s + k))
            left -= k
        return np.concatenate(out)

    batch = window * 256
    for _ in range(max(1, epochs * len(gold) // batch)):
        pick = sequence(batch)
        n = size[pick]
        letter = np.repeat(words.first[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        sub = Words(words.grams[:, letter], np.cumsum(n) - n, words.affixes[:, pick], words.whole[pick], n, pick)
        wanted = gold[pick]
        sizes = np.full(256, window)
        e = model.emissions(sub)
        p, upto = marginals(e, sizes, model.moves)
        wrong = -p
        wrong[np.arange(batch), wanted] += 1
        by_letter = np.repeat(wrong, n, axis=0)
        keys = np.concatenate([sub.grams[0], sub.grams[1], sub.affixes[0], sub.affixes[1]])
        values = np.concatenate([by_letter, by_letter, wrong, wrong])
        step = {
            "weights": np.stack([np.bincount(keys, values[:, i], TABLE) for i in range(n_labels)], 1),
            "lexical": np.stack([np.bincount(known[pick], wrong[:, i], len(model.lexical)) for i in range(n_labels)], 1),
        }
        move = np.exp(model.moves)
        ahead, upto = p.reshape(256, window, n_labels)[:, 1:], upto.reshape(256, window, n_labels)[:, :-1]
        pair = upto[:, :, :, None] * move * (ahead / np.maximum(upto @ move, 1e-30))[:, :, None, :]
        g = wanted.reshape(256, window)
        real = np.bincount((g[:, :-1] * n_labels + g[:, 1:]).ravel(), minlength=n_labels**2).reshape(n_labels, n_labels)
        step["moves"] = real - pair.sum(axis=(0, 1))
        for k, x in step.items():
            now = getattr(model, k)
            x = x - 1e-4 * now
            square[k] += x * x
            now += (rate * x / np.sqrt(square[k])).astype(now.dtype)
    return model
