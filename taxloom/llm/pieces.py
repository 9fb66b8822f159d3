"""SentencePiece encoding and decoding of whole texts by suffix-array matching and relaxation."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from taxloom.llm.common import give_back
from taxloom.llm.suffix import Patterns, occurrences

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
SEPARATOR = 0x110000
CACHE = 60_000
BATCH = 1 << 17
GROUP = 1 << 20
IDS = 1 << 18
UNKNOWN, START, NONE = -1, -2, -3


class Codec:
    """Encoder and decoder of one BPE model with byte fallback, without normalisation of characters.

    Encoding has the model's own result, which merges the best-scored neighbours first. That result is found by
    relaxing edges in order of position: the pieces of a text's encoding are those of its prefix's encoding and one
    more piece, and a row of pieces is an encoding just when each two neighbours alone encode to themselves. So at
    each position one edge is kept: the piece that fits the piece kept where it starts.
    """

    def __init__(self, model: bytes):
        sp = SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.bytes_at = {}
        self.text = []
        self.ids, self.pieces, self.score = [], {}, {}
        strings = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_at[int(piece[3:-1], 16)] = i
                self.text.append(bytes([int(piece[3:-1], 16)]))
            elif special[i]:
                self.text.append(" ⁇ ".encode() if sp.is_unknown(i) else b"")
            else:
                self.text.append(piece.replace(SPACE, " ").encode())
                self.pieces[piece], self.score[piece] = i, sp.get_score(i)
                self.ids.append(i)
                strings.append(piece)
        self.string = {i: s for s, i in self.pieces.items()}
        self.patterns = Patterns(strings)
        self.ids = np.array(self.ids, np.int32)
        self.lengths = np.array([len(s) for s in strings], np.int32)
        apart = all(SPACE not in s.lstrip(SPACE) and "\n" not in s for s in strings)  # no piece crosses a word's start
        self.apart = apart
        self.words = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n+" if apart else "(?s).+")
        size = [len(x) for x in self.text]
        self.text_size = np.array(size, np.int64)
        self.text_start = np.cumsum(self.text_size) - self.text_size
        self.text_bytes = np.frombuffer(b"".join(self.text), np.uint8)
        self.histories: dict[int, list[tuple] | None] = {}
        self.table = np.zeros(1 << 20, np.int64)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def history(self, piece: int) -> list[tuple] | None:
        """The merges by which a piece's own characters become it: (score, first symbol, last symbol); None if they don't."""
        if piece not in self.histories:
            parts = list(self.string[piece])
            steps = [(None, parts[0], parts[-1])]
            while len(parts) > 1:
                found = [(self.score.get(x + y), -i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False))]
                best = max((f for f in found if f[0] is not None), default=None)
                if best is None:
                    break
                at = -best[1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                steps.append((best[0], parts[0], parts[-1]))
            self.histories[piece] = steps if len(parts) == 1 else None
        return self.histories[piece]

    def fit(self, before: int, piece: int) -> bool:
        """Whether the two pieces, next to each other, encode to themselves: no merge across the border comes first.

        Away from the border both sides merge as they do alone, the better score first and the left one of a tie.
        """
        if piece == UNKNOWN:
            return True
        right = self.history(piece)
        if before < 0 or right is None:
            return right is not None
        left = self.history(before)
        i = j = 0
        while True:
            across = self.score.get(left[i][2] + right[j][1], -np.inf)
            a = left[i + 1][0] if i + 1 < len(left) else -np.inf
            b = right[j + 1][0] if j + 1 < len(right) else -np.inf
            if across > a and across >= b:
                return False
            if a == b == -np.inf:
                return True
            if a >= b:
                i += 1
            else:
                j += 1

    def _fits(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """:meth:`fit` for arrays, through a table of known pairs."""
        key = (before.astype(np.int64) + 3) * (1 << 32) + piece + 1
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        held = self.table[slot]
        good = (held & 1).astype(bool)
        miss = np.flatnonzero(held >> 1 != key)
        if len(miss):
            _, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            at = miss[first]
            value = np.fromiter((self.fit(x, y) for x, y in zip(before[at].tolist(), piece[at].tolist(), strict=True)), bool, len(at))
            self.table[slot[at]] = key[at] * 2 + value
            good[miss] = value[back]
        return good

    def _learn(self, words: list[str]) -> None:
        """Encode new words: match all pieces in their concatenation, sort the edges by position, relax all words at once."""
        size = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(size + 1) - 1
        codes = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.int32).copy()
        codes[ends] = SEPARATOR
        start, which = occurrences(codes, self.patterns)
        length, piece = self.lengths[which], self.ids[which]
        single = np.zeros(len(codes), bool)
        single[start[length == 1]] = True
        lone = np.flatnonzero(~single & (codes != SEPARATOR)).astype(np.int32)
        start = np.concatenate([start, lone])
        end = start + np.concatenate([length, np.ones(len(lone), np.int32)])
        piece = np.concatenate([piece, np.full(len(lone), UNKNOWN, np.int32)])
        begin = ends - size
        inside = (np.arange(len(codes) + 1) - np.repeat(np.append(begin, len(codes)), np.append(size + 1, 1))).astype(np.int32)
        step = inside[end]
        if step.max(initial=0) < 1 << 15:
            step = step.astype(np.int16)
        order = np.argsort(step, kind="stable")
        start, end, piece, step = start[order], end[order], piece[order], step[order]
        cut = np.flatnonzero(np.diff(step)) + 1
        kept = np.full(len(codes) + 1, NONE, np.int32)
        came = np.zeros(len(codes) + 1, np.int32)
        kept[begin] = START
        for s, e, p in zip(np.split(start, cut), np.split(end, cut), np.split(piece, cut), strict=True):
            before = kept[s]
            open_ = before != NONE
            s, e, p, before = s[open_], e[open_], p[open_], before[open_]
            good = self._fits(np.where(before == UNKNOWN, START, before), p)
            kept[e[good]], came[e[good]] = p[good], s[good]
        at, word = ends.copy(), np.arange(len(words))
        found = []
        while len(at):
            found.append((word, at))
            more = came[at] > begin[word]
            at, word = came[at[more]], word[more]
        word = np.concatenate([w for w, _ in found])
        at = np.concatenate([x for _, x in found])
        order = np.lexsort((at, word))
        word, at = word[order], at[order]
        ids = kept[at]
        unknown = np.flatnonzero(ids == UNKNOWN)
        if len(unknown):
            spelled = [[self.bytes_at[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in codes[at[unknown] - 1]]
            width = np.ones(len(ids), np.int64)
            width[unknown] = [len(x) for x in spelled]
            ids, word = np.repeat(ids, width), np.repeat(word, width)
            ids[ids == UNKNOWN] = [b for x in spelled for b in x]
        bounds = np.searchsorted(word, np.arange(len(words) + 1)) * 4
        data = ids.astype(np.int32).tobytes()
        for w, a, b in zip(words, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            self.known[w] = data[a:b]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text. Words seen before are looked up; new ones are matched together, in bounded batches."""
        split = [self._split(t) if t else [] for t in texts]
        if len(self.known) > CACHE:  # words that aren't met again until the next time are forgotten
            self.known, self.older = {}, self.known
        new, size = [], 0
        for w in set().union(*split):
            if w in self.known:
                continue
            if w in self.older:
                self.known[w] = self.older[w]
            else:
                new.append(w)
                size += len(w)
                if size > BATCH:
                    self._learn(new)
                    new, size = [], 0
        if new:
            self._learn(new)
        find = self.known.__getitem__
        return [np.frombuffer(b"".join(map(find, words)), np.int32) for words in split]

    def _split(self, text: str) -> list[str]:
        """The text's words, each with the spaces before it, and its line ends; by plain replacements where neither repeats."""
        marked = SPACE + text.replace(" ", SPACE)
        if not self.apart or SPACE + SPACE in marked or "\n\n" in marked or "\0" in marked:
            return self.words.findall(marked)
        return list(filter(None, marked.replace(SPACE, "\0" + SPACE).replace("\n", "\0\n\0").split("\0")))

    def decode_all(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of rows of ids that stand one after the other, without the space that encoding puts first.

        Broken UTF-8 becomes U+FFFD.
        """
        size = self.text_size[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.text_start[ids] - (ends - size), size)
        data = self.text_bytes[at].tobytes()
        stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(stops[:-1], stops[1:], strict=True)]
        return [t[1:] if t[:1] == " " else t for t in texts]

    def decode(self, ids: list[int]) -> str:
        """The text of one row of ids."""
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0]


_codecs: dict[int, Codec] = {}


def codec(model: bytes) -> Codec:
    """The codec of a model, kept by the Python worker from task to task; the words it has learned are not."""
    key = hash(model)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


def model_bytes(path: str = MODEL) -> bytes:
    """The model, read once on the driver; it goes to the tasks with the job."""
    with open(path, "rb") as f:
        return f.read()


def _groups(batch: pa.RecordBatch, sizes: np.ndarray, most: int):
    """Slices of a batch of about ``most`` units."""
    at, total = 0, np.cumsum(sizes)
    while at < len(sizes):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + most)))
        yield batch.slice(at, to - at)
        at = to


def encode(docs: DataFrame, model: str = MODEL, text_col: str = "text", out_col: str = "pieces") -> DataFrame:
    """Replace the text column by ``pieces``, the ids of the whole text; the scan is not shuffled.

    Null and empty texts have no pieces. The character U+2581 counts as a space, as in the model itself. All other
    columns are handed on, but for one with the name of ``out_col``, which is replaced.
    """
    proto = model_bytes(model)
    names = [c for c in docs.columns if c.lower() not in (text_col.lower(), out_col.lower())]
    narrow = docs.select(F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)])

    def run(batches):
        tool = codec(proto)
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
            for part in _groups(batch, sizes, GROUP):
                ids = tool.encode(part.column(0).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), flat), *part.columns[1:]], names=["pieces", *part.schema.names[1:]])
        tool.known, tool.older = {}, {}
        give_back()

    schema = ", ".join(["pieces array<int>", *(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[1:])])
    out = narrow.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], F.col("pieces").alias(out_col))


def decode(encoded: DataFrame, model: str = MODEL, pieces_col: str = "pieces", out_col: str = "text") -> DataFrame:
    """Add ``text``, the decoded pieces (null for null); other columns are handed on, one of that name is replaced."""
    proto = model_bytes(model)
    names = [c for c in encoded.columns if c.lower() not in (pieces_col.lower(), out_col.lower())]
    narrow = encoded.select(F.col(pieces_col).alias("pieces"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)])

    def run(batches):
        tool = codec(proto)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
            for part in _groups(batch, sizes, IDS) if batch.num_rows else ():
                rows = part.column(0)
                own = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
                texts = tool.decode_all(rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64), own)
                there = rows.is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([rows, pa.array(texts, pa.string(), mask=~there), *part.columns[1:]], names=["pieces", "text", *part.schema.names[1:]])
        give_back()

    schema = ", ".join(["pieces array<int>, text string", *(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[1:])])
    out = narrow.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], F.col("pieces").alias(pieces_col), F.col("text").alias(out_col))
