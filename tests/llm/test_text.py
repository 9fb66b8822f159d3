"""Language, pieces, archives, fingerprints, mixing, and the pipeline."""

import base64
import hashlib
import io
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from conftest import ODD, table
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

import corpus_pipeline
from taxloom.llm import archives, crf, fingerprint, langid, mixing, phrases, pieces, warc
from taxloom.llm.common import stored


def test_marginals():
    rng = np.random.default_rng(0)
    e, moves = rng.normal(size=(5, 3)).astype(np.float32), rng.normal(size=(3, 3))
    total = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        start = np.log(np.exp(moves).sum(axis=0)[path[0]])
        weight = np.exp(start + e[0, path[0]] + sum(moves[a, b] + e[i + 1, b] for i, (a, b) in enumerate(zip(path, path[1:], strict=False))))
        for i, s in enumerate(path):
            total[i, s] += weight
    wanted = total / total.sum(axis=1, keepdims=True)
    for step in (2, 3, 32):
        assert np.allclose(crf.marginals(e, np.array([5]), moves, step)[0], wanted, atol=1e-5)


def test_language(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.predict(docs, model).collect()
    held = [r for r in got if __import__("zlib").crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    found = langid.predict(odd, model, keep=("part",)).collect()
    assert len(found) == len(ODD)
    for r in found:
        assert (r.lang_pred == "und") == (r.score == 0) and 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in found if r.doc_id in (1, 5, 6, 7, 9)}
    assert [by_id[i].lang_pred for i in (1, 5, 6, 7)] == ["und", "und", "und", "fr"]
    assert by_id[7].n_words == 7 * 3000
    assert langid.identify(none).collect() == []
    switched = "the and of this with from that " * 8 + "de la les des une pour dans que " * 8
    (row,) = langid.predict(table(spark, [(1, f"\U0001f600 {switched}", "en", "a")]), model).collect()
    assert row.n_switches == len(row.runs) - 1 >= 1
    assert [r.lang for r in row.runs][:: len(row.runs) - 1] == ["en", "fr"]
    assert row.runs[0].start == 2 and row.runs[-1].end == len(switched) + 1
    assert all(a.end < b.start and a.lang != b.lang for a, b in itertools.pairwise(row.runs))


def test_long_training_texts(spark):
    """A language with long texts only is learned too."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(words) for _ in range(9000)), lang, "a") for i, (lang, words) in enumerate([("en", ["the", "and", "with"]), ("fr", ["les", "des", "une"])] * 6)]
    model = langid.fit(table(spark, rows))
    assert model.labels == ["en", "fr"]
    assert [x[0] for x in langid._label(model, ["the with and the", "une des les une"])] == ["en", "fr"]


def test_long_text_is_cut_between_words():
    rng = random.Random(1)
    text = " ".join(rng.choice(["the", "and", "of", "uno", "por"]) for _ in range(2000))
    model = crf.train([text, "de la les des"] * 3, ["en", "fr"] * 3)
    whole = langid._label(model, [text])
    langid.CHUNK, old = 1000, langid.CHUNK
    try:
        cut = langid._label(model, [text])
        assert np.allclose(cut[0][1], whole[0][1], atol=1e-4) and (cut[0][4] == whole[0][4]).all()
    finally:
        langid.CHUNK = old


@pytest.fixture(scope="module")
def tool():
    return pieces.Codec(pieces.model_bytes())


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_proto=pieces.model_bytes())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
def test_pieces_are_the_models(tool, library, texts):
    for t, ids in zip(texts, tool.encode(texts), strict=True):
        assert ids.tolist() == library.encode(t)
        if pieces.SPACE not in t:
            assert tool.decode(ids.tolist()) == t


def test_pieces(spark, sf, library, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in pieces.decode(pieces.encode(docs), out_col="back").collect():
        assert r.pieces == library.encode(text[r.doc_id]) and r.back == text[r.doc_id]
    out = pieces.encode(odd)
    assert set(out.columns) == {c for c in odd.columns if c != "text"}
    assert Counter((r.doc_id, len(r.pieces)) for r in out.collect()) == Counter((i, len(library.encode(t or ""))) for i, t, _, _ in ODD)
    assert pieces.encode(none).collect() == []


def test_archives(spark, none):
    rows = [(i, f"http://a/{i}", f"<p>{i % 7}</p>") for i in range(60)] + [(100, None, None), (101, "http://a b", ""), (102, "x", "é"), (102, "x", "é"), (None, "x", "é")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, payload string")
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    wanted = Counter()
    for i, _, h in rows:
        data, top = (h or "").encode(), best[h or ""]
        wanted[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == top else "revisit", None if i == top else top] += 1
    assert Counter(tuple(r)[:5] for r in warc.archive_pages(pages).collect()) == wanted
    assert {r.record_type for r in warc.archive_pages(pages, least_bytes=9).filter("payload_bytes < 9").collect()} == {"response"}
    assert warc.archive_pages(pages.filter("false")).collect() == []
    named = spark.createDataFrame([("a b\r\nX: y", "u", "p"), ("é", "u", "p"), ("9", "u", "p"), (None, "u", "q")], "page_id string, url string, html string")
    found = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_pages(named).collect()}
    assert found == {"a b\r\nX: y": ("revisit", "é"), "é": ("response", None), "9": ("revisit", "é"), None: ("response", None)}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines(version):
    block = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n\x00\xff payload\n\nhttp://x 1.2.3.4 2 a 5\n"
    data = archives.arc_file(version, [archives.arc_record(version, "http://a b/", block), archives.arc_record(version, "http://c/", b"")])
    found = list(archives.arc_records(data))
    assert [(r["URL"], r["block"]) for r in found] == [("http://a b/", block), ("http://c/", b"")]
    with pytest.raises(ValueError):
        list(archives.arc_records(data[:-9]))
    with pytest.raises(ValueError):
        list(archives.arc_records(b"http://a/ 1.2.3.4 2 a 0\n"))


def test_warc_lines():
    record = archives.warc_record("response", archives.record_id(1, "D"), "http://a", archives.warc_date("2024"), "0.0.0.0", b"HTTP/1.1 200 OK\r\n\r\nbody", "D")
    (head, block), = archives.warc_records(io.BytesIO(record + b"\r\n\r\n"))
    assert head["warc-date"] == "2024-01-01T00:00:00Z" and block.endswith(b"body")


M = (1 << 64) - 1


def brute_mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def brute_phrases(text):
    """Names of the phrases of each level, one text and one name at a time."""
    names, out = [ord(c) + 1 for c in text], []
    for _ in range(3):
        runs = [(k, len(list(g))) for k, g in itertools.groupby(names)]
        names = [brute_mixed(brute_mixed(k) ^ n) if n > 1 else k for k, n in runs]
        label = names
        for turn in range(4):
            before = [(~label[0] & M) if turn == 0 else label[0] ^ 1, *label[:-1]]
            low = [((a ^ b) & -(a ^ b)).bit_length() - 1 for a, b in zip(before, label, strict=True)]
            label = [2 * k + ((b >> k) & 1) for k, b in zip(low, label, strict=True)]
        ends = [-1, *label, -1]
        starts = [i for i in range(len(label)) if i == 0 or ends[i] < ends[i + 1] >= ends[i + 2]]
        grouped = []
        for a, b in itertools.pairwise([*starts, len(names)]):
            total = b - a
            for place, name in enumerate(names[a:b]):
                x = name * (place * 0x9E3779B97F4A7C16 + 0xD6E8FEB86659FD93) & M
                total += x ^ (x >> 32)
            grouped.append(brute_mixed(total & M))
        names = grouped
        out.append(set(names))
    return out


def brute_fingerprint(text):
    if not text:
        return []
    high, low = set(), set()
    for level, names in enumerate(brute_phrases(text), 1):
        for x in names:
            h = brute_mixed((x + level) & M) >> 32
            (low if level == 1 else high).add(h | 1 if level == 1 else h & ~1)
    return sorted([*sorted(high)[:64], *sorted(low)[:64]])


def test_fingerprints_by_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    texts += ["", "a", "aa", "ab", "aab" * 40, "x" * 500, "\U0001f600é" * 9, "abcabcabc"]
    for t, x in zip(texts, phrases.fingerprints(texts), strict=True):
        assert x.tolist() == brute_fingerprint(t or "")


def test_sketch_error():
    """The likeness is the share of common phrases, within the error that the sketch's size gives."""
    rng = random.Random(11)
    wrong = []
    for share in (0.2, 0.5, 0.8):
        for _ in range(20):
            base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(4000))
            cut = int(4000 * share)
            other = base[:cut] + "".join(rng.choice("abcdefghijklmnop ") for _ in range(4000 - cut))
            x, y = (set().union(*(set((n, level) for n in names) for level, names in enumerate(brute_phrases(t)) if level)) for t in (base, other))
            wrong.append(phrases.likeness(*phrases.fingerprints([base, other])) - len(x & y) / len(x | y))
    assert abs(np.mean(wrong)) < 0.03 and np.sqrt(np.mean(np.square(wrong))) < 0.075


def test_neighbours_without_ids(spark):
    """Rows without an id, or of one id, are in one order too, and each is compared with the next."""
    rows = [(None, f"text {i} " * 20) for i in range(50)] + [(7, f"other {i} " * 20) for i in range(20)]
    got = fingerprint.compare_neighbours(table(spark, [(i, t, "en", "a") for i, t in rows])).collect()
    digests = Counter(r.edited_sha256 for r in got)
    text = {phrases_hex(t): t for _, t in rows}
    assert len(got) == 70 and set(text) == {r.fingerprint for r in got}
    following = {}
    for r in got:
        t = text[r.fingerprint]
        n = len(t) // 3
        (following[t],) = {u for _, u in rows if hashlib.sha256((t[: len(t) - n] + u[:n]).encode()).hexdigest() == r.edited_sha256}
    assert len(digests) == len(set(following.values())) == 70
    at, seen = rows[0][1], []
    while at not in seen:
        seen.append(at)
        at = following[at]
    assert len(seen) == 70 and sum(t.startswith("other") != following[t].startswith("other") for t in seen) == 2


def phrases_hex(text):
    return fingerprint._hex(np.array(brute_fingerprint(text), np.uint32))


def test_neighbours(spark, none):
    rows = [(i, t) for i, t, _, _ in ODD if i not in (2, 3)] + [(i, f"text number {i} " * (i % 30)) for i in range(20, 120)]
    got = {r.doc_id: r for r in fingerprint.compare_neighbours(table(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        changed = t[: len(t) - n] + following[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        own, other, after = (np.array(brute_fingerprint(x) if len(x) < 9000 else phrases.fingerprints([x])[0], np.uint32) for x in (t, changed, following))
        assert r.fingerprint == fingerprint._hex(own) and r.edited_fingerprint == fingerprint._hex(other)
        assert r.near_edited == phrases.likeness(own, other) and r.near_next == phrases.likeness(own, after)
    assert fingerprint.compare_neighbours(none).collect() == []
    plain = fingerprint.fingerprint(table(spark, [(i, t, "en", "a") for i, t in rows]))
    assert {r.doc_id: r.fingerprint for r in plain.collect()} == {i: r.fingerprint for i, r in got.items()}


def test_phrases_are_local():
    """What two texts have in common has the same phrases, wherever it stands."""
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    a = "".join(rng.choice("abcdefgh ") for _ in range(137)) + shared
    b = "".join(rng.choice("abcdefgh ") for _ in range(311)) + shared
    x, y = phrases.fingerprints([a, b])
    assert phrases.likeness(x, y) > 0.8
    assert phrases.likeness(*phrases.fingerprints(["aaaabb" * 50, "zzzzyx" * 50])) < 0.2
    assert phrases.likeness(*phrases.fingerprints(["", ""])) == 1.0


def test_phrases_know_no_length():
    """A text and its shortened form are as alike at 256 characters as elsewhere."""
    rng = random.Random(6)
    found = {}
    for size in (200, 260, 400):
        texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(size)) for _ in range(30)]
        found[size] = np.mean([phrases.likeness(*phrases.fingerprints([t, t[:-10]])) for t in texts])
    assert min(found.values()) > 0.8


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.text(max_size=3), st.integers(0, 10**6), min_size=1, max_size=20))
def test_pfair(weights):
    slots = mixing.shares(weights, 200)
    period = sum(slots.values())
    assert set(slots) == {s for s, w in weights.items() if w}
    total = sum(weights.values())
    if total and total // math.gcd(*weights.values()) <= 200:
        assert all(c * total == weights[s] * period for s, c in slots.items())
    done = dict.fromkeys(slots, 0)
    for s, k, slot, release, deadline in sorted(mixing.pfair(slots), key=lambda x: x[2]):
        assert release <= slot < deadline and k == done[s]
        done[s] += 1
        for name, c in slots.items():
            assert abs(done[name] - (slot + 1) * c / period) < 1
    assert done == slots


def test_weights_are_kept():
    assert mixing.shares({"a": 4, "b": 2, "c": 1, "d": 1}) == {"a": 4, "b": 2, "c": 1, "d": 1}
    assert mixing.shares({"a": 500, "b": 250, "c": 0}) == {"a": 2, "b": 1}
    assert mixing.shares({"a": 0, "b": 0}) == {} == mixing.shares({})
    many = mixing.shares({i: 10**9 + i for i in range(300)}, 1000)
    assert sum(many.values()) == 1000 and min(many.values()) >= 1


def test_sources_without_weight_follow(spark):
    docs = table(spark, [(i, "t", "en", "abcde"[i % 5]) for i in range(500)])
    got = mixing.mix(docs, weights={"a": 4, "b": 2, "c": 1}, block_rows=4).collect()
    assert {r.source: r.target for r in got} == {"a": 4 / 7, "b": 2 / 7, "c": 1 / 7, "d": 0, "e": 0}
    first = max(r.slot for r in got if r.target)
    assert min(r.slot for r in got if not r.target) == first + 1 and len({(r.slot, r.block_row) for r in got}) == 500
    for t in range(40):  # while all have rows, each is within a block of its weight
        for s, w in (("a", 4), ("b", 2), ("c", 1)):
            assert abs(len({r.block for r in got if r.source == s and r.slot <= t}) - (t + 1) * w / 7) < 1
    equal = mixing.mix(docs, weights={}, block_rows=4).collect()
    assert len({(r.slot, r.block_row) for r in equal}) == 500 and max(r.slot for r in equal) == 124


def test_mixing(spark, none):
    rng = random.Random(3)
    rows = [(i, "t", "en", rng.choice(["a", "a", "a", "b", None, ""])) for i in range(3000)] + [(None, "t", "en", "a"), (5, "t", "en", "a"), (5, "t", "en", "a")]
    got = mixing.mix(table(spark, rows), weights={"a": 1, "b": 2, None: 1, "": 4}, block_rows=4, keep=("part",)).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((i, s) for i, _, _, s in rows)
    for s in ("a", "b", None, ""):
        own = sorted((r for r in got if r.source == s), key=lambda r: (r.block, r.block_row))
        assert [(r.block, r.block_row) for r in own] == [divmod(i, 4) for i in range(len(own))]
        marks = [hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest() for r in own]
        assert marks == sorted(marks)
        assert all(r.release <= r.slot < r.deadline for r in own)
    assert len({(r.slot, r.block_row) for r in got}) == len(got)
    assert mixing.mix(none).collect() == []


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        if name != "encode_pieces":
            assert docs.columns == corpus_pipeline.COLUMNS
        assert 0 < docs.count() <= before
        before = docs.count()
    assert before == corpus_pipeline.run(spark, sf).count()


def test_pipeline_on_odd_rows(spark, odd, none):
    for docs in (odd, none):
        docs = docs.select(*corpus_pipeline.COLUMNS)
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, ""), name)
            docs.collect()


def test_near_duplicates_by_row(spark):
    """No text is lost because its row's id stands for other rows too, and of equal rows one stays."""
    words = [f"w{i}" for i in range(40)]
    a, b, c = " ".join(words[:20]), " ".join(words[20:]), " ".join(reversed(words))
    rows = [(1, a), (2, a), (2, b), (3, b), (3, b), (None, a), (None, c), (None, c), (-4, c), (5, None), (6, "")]
    docs = table(spark, [(i, t, "en", "a") for i, t in rows])
    found = corpus_pipeline.near_duplicates(spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in found.collect()) == Counter([(1, a), (2, b), (-4, c), (5, None), (6, "")])


def test_pipeline_keeps_the_mixed_order(spark):
    """The result's order columns give the order that mixing gave."""
    docs = table(spark, [(i, f"text {i}", "en", "abc"[i % 3] if i % 7 else "d") for i in range(400)]).select(*corpus_pipeline.COLUMNS)
    wanted = [r.doc_id for r in mixing.mix(docs).orderBy("slot", "block_row").collect()]
    found = corpus_pipeline.encode_pieces(spark, stored(corpus_pipeline.mix_sources(spark, docs, ""), "mixed"), "")
    assert [r.doc_id for r in found.orderBy("mix_part", "mix_row").collect()] == wanted
    assert corpus_pipeline.encode_pieces(spark, docs, "").filter("mix_part is null and mix_row is null").count() == 400
