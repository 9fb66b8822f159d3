"""Language identification of whole texts by a linear-chain CRF over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.llm.common import give_back
from taxloom.llm.crf import Model, marginals, train, words_of

TRAIN_CHARS = 1_200_000
ALL_CHARS = 12_000_000
TEXT_CHARS = 20_000
MAX_LANGS = 256
FOLDS = 5
CHUNK = 1 << 18
NONE = "und"


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_chars: int = TRAIN_CHARS) -> Model:
    """Train on a bounded sample: about ``train_chars`` characters of each language, ``ALL_CHARS`` in all.

    Only rows that aren't held out, with text and language, are used. The sample is drawn by the MD5 of the id, at a
    rate that each language's characters set, so it is the same on every run; of a text of over ``TEXT_CHARS``
    characters it has a stretch of that length from a place that the MD5 sets. Languages after the ``MAX_LANGS`` largest
    aren't learned.
    """
    mark = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    usable = docs.filter(~held_out(id_col) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    usable = usable.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), mark.alias("mark"), F.length(text_col).alias("n"))
    sizes = usable.groupBy("lang").agg(F.sum(F.least("n", F.lit(TEXT_CHARS))).alias("chars"), F.count(F.lit(1)).alias("docs"))
    counts = sizes.orderBy(F.desc("docs"), "lang").limit(MAX_LANGS).collect()
    if not counts:
        return train([], [])
    most = min(train_chars, ALL_CHARS // len(counts))
    bound = F.lit(None)
    for r in counts:
        bound = F.when(F.col("lang") == r["lang"], F.lit(min(1 << 40, (1 << 40) * most // max(1, r["chars"])))).otherwise(bound)
    place = F.expr(f"1 + pmod(cast(conv(substring(mark, 11, 8), 16, 10) as long), n - {TEXT_CHARS} + 1)").cast("int")
    stretch = F.when(F.col("n") > TEXT_CHARS, F.substring("text", place, F.lit(TEXT_CHARS))).otherwise(F.col("text"))
    drawn = usable.filter(F.conv(F.substring("mark", 1, 10), 16, 10).cast("long") < bound).select("mark", "lang", stretch.alias("text")).collect()
    drawn.sort(key=lambda r: (r["mark"], r["lang"], r["text"]))
    return train([r["text"] for r in drawn], [r["lang"] for r in drawn])


def _pieces(text: str):
    """A text in pieces that end between words."""
    at = 0
    while at < len(text):
        to = min(len(text), at + CHUNK)
        while to < len(text) and text[to].isalpha():
            to += 1
        yield text[at:to]
        at = to


NO_RUNS = np.empty((0, 3), np.int32)


def _label(model: Model, texts: list[str | None]) -> list[tuple]:
    """(language, score, words, switches, runs) for each text, in groups of about CHUNK characters.

    Runs are rows (start, end, label): stretches of words with one likeliest label, in code points.
    """
    out: list[tuple] = [(NONE, 0.0, 0, 0, NO_RUNS)] * len(texts)
    group: list[int] = []

    def flush() -> None:
        if len(group) == 1 and len(texts[group[0]]) > CHUNK:
            cuts = list(_pieces(texts[group[0]]))
            parts = [words_of(x) for x in cuts]
            emitted = np.concatenate([model.emissions(w) for w in parts])
            length = np.concatenate([w.length for w in parts])
            begin = np.cumsum([0, *map(len, cuts)])[:-1]
            place = np.concatenate([w.place + b for w, b in zip(parts, begin, strict=True)])
            sizes = np.array([len(emitted)])
        else:
            words = words_of("\0".join(texts[i] for i in group))
            emitted, length = model.emissions(words), words.length
            ends = np.cumsum([len(texts[i]) + 1 for i in group])
            sizes = np.diff(np.searchsorted(words.place, ends), prepend=0)
            place = words.place - np.repeat(np.concatenate([[0], ends[:-1]]), sizes)
        full = np.flatnonzero(sizes)
        if len(full):
            p, _ = marginals(emitted, sizes[full], model.moves)
            first = np.cumsum(sizes[full]) - sizes[full]
            mass = np.add.reduceat(p * length[:, None], first, axis=0)
            share = mass / mass.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            new = np.concatenate([[True], best[1:] != best[:-1]])
            new[first] = True
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(best)) - 1
            runs = np.stack([place[at], place[last] + length[last], best[at]], axis=1).astype(np.int32)
            bounds = np.append(np.searchsorted(at, first), len(at))
            for k, i in enumerate(full):
                top = int(share[k].argmax())
                own = runs[bounds[k] : bounds[k + 1]]
                out[group[i]] = (model.labels[top], float(share[k, top]), int(sizes[i]), len(own) - 1, own)
        group.clear()

    held = 0
    for i, t in enumerate(texts):
        if not t or not model.labels:
            continue
        if group and held + len(t) > CHUNK:
            flush()
            held = 0
        group.append(i)
        held += len(t)
    if group:
        flush()
    return out


RUNS = "array<struct<start:int,end:int,lang:string>>"


def _run_lists(model: Model, runs: list[np.ndarray]) -> pa.Array:
    """The runs of some texts as lists of structs."""
    flat = np.concatenate([NO_RUNS, *runs])
    lang = pa.array(model.labels or [NONE], pa.string()).take(pa.array(flat[:, 2]))
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in runs])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1]), lang], ["start", "end", "lang"]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), runs: bool = True) -> DataFrame:
    """Language and score of each document, from its text alone; the scan is not shuffled.

    Every word's label probabilities are weighted by its letters and added up; ``lang_pred`` is the language with the
    largest share, ``score`` that share, ``n_words`` the number of words, ``n_switches`` how often the likeliest label
    changes from word to word, ``runs`` the stretches between (start and end in code points, end exclusive, and
    language; ``runs=False`` leaves them out). A text that is null, empty or without a letter is 'und' with score 0, as is every text
    if no language could be learned. Rows with repeated or null ids are each labelled. ``keep`` names further columns
    to hand on; others are ignored, and clashing names cannot meet.
    """
    columns = [F.col(c) for c in keep]
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[c.alias(f"_k{i}") for i, c in enumerate(columns)])
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    kept = [c for c in narrow.columns if c != "_text"]
    added = ["lang_pred", "score", "n_words", "n_switches", *(["runs"] if runs else [])]

    def label(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = _label(model, part.column(1).to_pylist())
                lang, score, n, switches, own = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(c)) for c in kept] + [pa.array(lang), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(switches, pa.int64()), *([_run_lists(model, own)] if runs else [])],
                    names=[*kept, *added],
                )
        give_back()

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in kept), "lang_pred string, score double, n_words long, n_switches long", *([f"runs {RUNS}"] if runs else [])])
    out = narrow.mapInArrow(label, schema)
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *added)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows that aren't held out and label all documents: id, ``held_out``, ``lang_pred``, ``score``, ...

    See :func:`fit` and :func:`predict`. A null id is held out (the CRC of an empty text is 0).
    """
    model = fit(docs, id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col).select(F.col(id_col), held_out(id_col).alias("held_out"), "lang_pred", "score", "n_words", "n_switches", "runs")
