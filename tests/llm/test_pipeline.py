"""Each stage of the corpus pipeline against what its own input gives by brute force, by the library, or by its operator."""

from collections import Counter

import pytest
from conftest import table
from sentencepiece import SentencePieceProcessor
from test_dedup import brute_groups, brute_lines

import corpus_pipeline
from taxloom.llm import langid, mixing, pieces
from taxloom.llm.common import stored


@pytest.fixture(scope="module")
def steps(spark, sf):
    """The rows of the documents and of each stage's result."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        out.append((name, docs))
    return dict(out)


def rows(df):
    return [tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in df.collect()]


def test_language(steps):
    before = rows(steps["documents"])
    model = langid.fit(steps["documents"])
    wanted = Counter()
    for (i, text, lang, source, n), found in zip(before, langid._label(model, [r[1] for r in before]), strict=True):
        if found[0] != langid.NONE and found[1] >= corpus_pipeline.LEAST_SCORE:
            wanted[i, text, lang or found[0], source, n] += 1
    assert Counter(rows(steps["language"])) == wanted and len(wanted) > 0.9 * len(before)


def test_recurring_lines(steps):
    before = {r[0]: r for r in rows(steps["language"])}
    assert len(before) == steps["language"].count()
    wanted = Counter()
    for i, text in brute_lines([r[:2] for r in before.values()], 10):
        same = text == before[i][1]
        if same or text.split():
            wanted[(i, text, *before[i][2:4], before[i][4] if same else len(text))] += 1
    assert Counter(rows(steps["recurring_lines"])) == wanted


def test_near_duplicates(steps):
    before = rows(steps["recurring_lines"])
    kept = {i for (i, _, _, stays) in brute_groups([r[:2] for r in before], 5) if stays}
    assert Counter(rows(steps["near_duplicates"])) == Counter(r for r in before if r[0] in kept)
    assert len(kept) < len(before)


def test_mix_and_encode(steps):
    before = {r[0]: r for r in rows(steps["near_duplicates"])}
    assert Counter(rows(steps["mix_sources"])) == Counter(before.values())
    order = [r.doc_id for r in mixing.mix(steps["near_duplicates"]).orderBy("slot", "block_row").collect()]
    library = SentencePieceProcessor(model_proto=pieces.model_bytes())
    found = steps["encode_pieces"].orderBy("mix_part", "mix_row").collect()
    assert [r.doc_id for r in found] == order
    for r in found:
        assert (r.lang, r.source) == before[r.doc_id][2:4] and r.pieces == library.encode(before[r.doc_id][1]) and r.n_pieces == len(r.pieces)


def test_run(spark, sf, steps):
    found = corpus_pipeline.run(spark, sf)
    assert Counter((r.doc_id, tuple(r.pieces)) for r in found.collect()) == Counter((r.doc_id, tuple(r.pieces)) for r in steps["encode_pieces"].collect())


def test_clean_documents_stay(spark):
    """Unlike texts in known languages pass all stages."""
    words = {"en": "the and of with from that this have been were", "fr": "les des une dans pour que sur avec par est"}
    docs = [(i, " ".join(f"{w} x{chr(97 + i)}{chr(97 + k)}" for k, w in enumerate(words[lang].split() * 3)), lang, "ab"[i % 2]) for i, lang in enumerate(["en", "fr"] * 12)]
    frame = table(spark, docs).select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        frame = stored(stage(spark, frame, ""), "clean")
    assert {r.doc_id for r in frame.collect()} == {d[0] for d in docs}
