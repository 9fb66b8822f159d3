"""Sharding, exact dedup and personal data, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from conftest import ODD, table

from taxloom.llm import exact, pii, sharding


def test_shards(spark, odd, none):
    got = sharding.shard_by_bytes(odd, shards=4).collect()
    assert len(got) == len(ODD)
    wanted = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in ODD)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == wanted
    rows = sorted(got, key=lambda r: r.byte_offset)
    at = 0
    for r in rows:
        assert r.byte_offset == at
        at += r["size"]
    start, size = {}, Counter()
    text = {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())): t or "" for i, t, _, _ in ODD}
    for r in rows:
        t = text[r.doc_id, r["size"], r.text_crc32]
        start.setdefault(t, r.byte_offset)
        size[t] += r["size"]
    for r in rows:
        t = text[r.doc_id, r["size"], r.text_crc32]
        assert r.shard == (start[t] if size[t] * 400 <= at else r.byte_offset) * 4 // at
    for s in {r.shard for r in rows}:
        assert [r.slot for r in rows if r.shard == s] == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard_by_bytes(none).collect() == []


def test_shards_are_even(spark, sf):
    got = sharding.shard_by_bytes(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert len(sizes) == 16 and all(abs(v - total / 16) <= most + total / 1600 for v in sizes.values())


def test_groups_stay_whole(spark):
    """Small groups of equal texts are in one shard each; a large one is divided evenly."""
    rows = [f"text {i // 3}" for i in range(6000)] + ["copy"] * 3000
    got = sharding.shard_by_bytes(table(spark, [(i, t, "en", "a") for i, t in enumerate(rows)]).repartition(5)).collect()
    where = {}
    for r in got:
        where.setdefault(rows[r.doc_id], set()).add(r.shard)
    assert all(len(v) == 1 for t, v in where.items() if t != "copy") and len(where["copy"]) > 4
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 16 + 40
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact(spark, odd, none, keep):
    got = exact.exact_dedup(odd, keep).collect()
    best = {}
    for i, t, _, _ in ODD:
        if i is not None:
            best[t or ""] = i if t is not None and (t or "") not in best else (max if keep == "max" else min)(best.get(t or "", i), i)
    n = Counter(t or "" for _, t, _, _ in ODD)
    wanted = Counter((i, best[t or ""], n[t or ""], i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _, _ in ODD)
    assert Counter(map(tuple, got)) == wanted
    assert exact.exact_dedup(none).collect() == []


def test_rounds_merge_sorted_runs(spark):
    """The plan that runs has, for each round, one exchange by run, a sort by digest, and a window over the sorted rows."""
    digested = exact.digests(table(spark, [(i, str(i % 50), "en", "a") for i in range(500)]).repartition(5), "doc_id", "text")
    final = exact.merged_runs(digested, runs=64)
    assert final.count() == 50
    plan = final._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") >= 3 and plan.count("RepartitionByExpression") == 3
    executed = final._jdf.queryExecution().executedPlan().toString()
    executed = executed.split("== Initial Plan ==")[-1]
    assert executed.count("Exchange") == 4 and executed.count("Aggregate") == 0  # one exchange is the test's own
    steps = [line.strip(" :+-").split(" ")[0] for line in executed.splitlines()]
    sorts = [i for i, step in enumerate(steps) if step == "Sort"]
    assert len(sorts) >= 3 and all("run#" in executed.splitlines()[i] and "text_sha256#" in executed.splitlines()[i] for i in sorts)


@pytest.mark.parametrize("runs,rounds", [(1, 3), (7, 1), (64, 3), (64, 6)])
def test_runs(spark, runs, rounds):
    """However many runs there are, every digest ends in one row."""
    texts = [str(i * i % 97) for i in range(1500)]
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).repartition(9)
    found = exact.merged_runs(exact.digests(docs, "doc_id", "text"), runs=runs, rounds=rounds).collect()
    best = {hashlib.sha256(t.encode()).hexdigest(): i for i, t in enumerate(texts)}
    n = Counter(hashlib.sha256(t.encode()).hexdigest() for t in texts)
    assert {(r.text_sha256, r.keep_id, r.copies) for r in found} == {(d, i, n[d]) for d, i in best.items()} and len(found) == len(n)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    cards = [(m, re.sub("[^0-9]", "", m.group())) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)]
    out += [("card", *m.span()) for m, d in cards if 16 <= len(d) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_personal_data(spark, odd, none, sf):
    r = random.Random(3)
    texts = ["".join(r.choice("0123456789.@-+ a() 19éb\U0001f600%") for _ in range(r.randrange(80))) for _ in range(400)]
    texts += ["9" * 30000, "1." * 5000, "a" * 100000, "a@b." * 2000, "+1 " * 5000, "x.y@a.bc+d@e.f@g.h 4111 1111 1111 1111 10.0.0.256 10.0.0.1 +1 (555) 123-4567"]
    rows = [*ODD, *[(1000 + i, t, "en", "a") for i, t in enumerate(texts)]]
    docs = table(spark, rows)
    model = pii.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    got = Counter(tuple(x)[:6] for x in pii.find_personal_data(docs, model).collect())
    wanted = Counter()
    for i, t, _, _ in rows:
        spans = base(t or "")
        n = Counter(k for k, _, _ in spans)
        wanted[i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()] += 1
    assert got == wanted
    by_id = {r.doc_id: r.spans for r in pii.find_personal_data(docs, model).collect()}
    for i, t, _, _ in rows[len(ODD) :]:
        assert {f"{k}:{a}:{b}" for k, a, b in base(t)} <= set(by_id[i].split(",")) | {""}
    shown = {r.doc_id: r.text for r in pii.redact(docs, model).filter("doc_id is not null").collect()}
    assert shown[1] is None and "4111" not in shown[1000 + len(texts) - 1]
    assert pii.find_personal_data(none).collect() == []


def test_added_spans(spark):
    """A candidate that the base patterns miss is added when its score reaches the threshold."""
    model = pii.Model(trees=[(1.0, (0, 0.5, -2.0, 2.0))], names=["is_email"], thresholds={"email": 0.9})
    docs = table(spark, [(1, "write to ann (at) mail (dot) org or bob@mail.org", "en", "a")])
    assert pii.find_personal_data(docs, model).first().spans == "email:9:32,email:36:48"


PLANTED = {
    "email": ["jane.doe (at) example (dot) org", "bob[at]site.net", "m.lee {at} corp {dot} com", "x_y (AT) some-host (DOT) ec", "kim [at] uni [dot] edu", "a.b (at) mail.example.org"],
    "ip": ["192 . 168 . 0 . 12", "10,20,30,40", "172. 16. 254. 1", "8, 8, 8, 8", "203 .0 .113 .9"],
    "card": ["4111.1111.1111.1111", "5500-0000-0000-0004", "378282246310005", "3782 822463 10005", "6011.0009.9013.9424"],
    "phone": ["(555) 123-4567", "020 555 0199", "593 2 255 1234", "555-867-5309", "044 668 18 00", "01 23 45 67 89"],
}
FRAMES = {"email": "Please contact {} today", "ip": "The server at {} is down", "card": "Paid by visa {} yesterday", "phone": "In a hurry call {} at once"}


@pytest.mark.parametrize("rows", [None, 0, 300])
def test_all_kinds_on_any_table(spark, sf, rows):
    """On a table with few or no examples, or none at all, all kinds have thresholds, and planted data of other forms is found."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = pii.fit(docs if rows is None else docs.limit(rows))
    assert set(model.thresholds) == set(pii.KINDS)
    texts = [(k, FRAMES[k].format(x), x) for k, many in PLANTED.items() for x in many]
    found = {r.doc_id: r.spans or "" for r in pii.find_personal_data(table(spark, [(i, t, "en", "a") for i, (_, t, _) in enumerate(texts)]), model).collect()}
    caught, missed = Counter(), []
    for i, (k, t, x) in enumerate(texts):
        at = t.index(x)
        spans = [s.split(":") for s in found[i].split(",") if s]
        hit = any(kind == k and int(a) <= at + 1 and int(b) >= at + len(x) - 1 for kind, a, b in spans)
        caught[k] += hit
        missed += [] if hit else [(t, found[i])]
    assert all(caught[k] >= 0.9 * len(PLANTED[k]) - 0.5 for k in PLANTED), missed
    clean = ["It was 1994 and 2003 again", "pages 12 13 14 15 16 17", "order 020 555 0199 now", "version 2, 3, 4, 5 of it", "meet ann (at) noon today", "total 1234567890123456 units", "No digits here at all"]
    assert [r.spans for r in pii.find_personal_data(table(spark, [(i, t, "en", "a") for i, t in enumerate(clean)]), model).collect()] == [""] * len(clean)


def test_fit_learns_what_base_misses(spark):
    """Addresses with marks and hinted numbers in other forms than the base patterns' are selected, bare numbers are not."""
    r = random.Random(4)

    def digits(n):
        return "".join(r.choice("0123456789") for _ in range(n))

    def card(n):
        body = digits(n - 1)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def wrong(n):
        good = card(n)
        return good[:-1] + str((int(good[-1]) + 1) % 10)

    rows = []
    for i in range(600):
        rows += [f"credit card {card(15)} now", f"credit card {wrong(15)} now", f"number {card(15)} now", f"number {digits(15)} now"]
        name = "".join(r.choice("abcdefgh") for _ in range(6))
        rows += [f"reach {name} (at) host{i} (dot) org now", f"see {name} (at) noon today", f"mail {name}@host.org", f"phone 0{digits(2)} {digits(3)} {digits(4)} now", f"order 0{digits(2)} {digits(3)} {digits(4)} now"]
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(rows)])
    model = pii.fit(docs)
    texts = ["reach ann (at) mail (dot) org now", "phone 020 555 0199 now", "order 020 555 0199 now", "see ann (at) noon today", "credit card 378282246310005 now", "credit card 378282246310006 now", "number 378282246310005 now"]
    found = {x.doc_id: x.spans for x in pii.find_personal_data(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), model).collect()}
    assert found == {0: "email:6:29", 1: "phone:6:18", 2: "", 3: "", 4: "card:12:27", 5: "", 6: ""}


def test_fit_sees_every_candidate(spark, monkeypatch):
    """The trees' rows weigh as much as there are candidates, however many a document has."""
    seen = []

    class Seen(Exception):
        pass

    def fit(self, rows):
        seen.append(rows.groupBy().sum("count").first()[0])
        raise Seen

    monkeypatch.setattr(pii.GBTClassifier, "fit", fit)
    i = next(i for i in range(100) if int(hashlib.md5(str(i).encode()).hexdigest()[10:18], 16) % 5)
    for text in (None, "call 555-867-5309; " * 200):
        with pytest.raises(Seen):
            pii.fit(table(spark, [(i, text, "en", "a")]))
    assert seen[1] - seen[0] == 200
