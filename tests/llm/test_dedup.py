"""Line templates, MinHash groups, components."""

import random
import re
from collections import Counter, defaultdict

from conftest import ODD, table
from pyspark.sql import functions as F

from taxloom.llm import components, lines, minhash


def masked(line):
    return " ".join("<*>" if re.search("[0-9]", t) else t for t in line.split())


def brute_templates(lines):
    """The number of each line's template, token by token."""
    known, out = [], []
    for i, line in enumerate(lines):
        tokens = line.split(" ")
        same = [sum(x == y != "<*>" for x, y in zip(tokens, t, strict=True)) for _, t in known]
        best = max(range(len(known)), key=lambda k: (same[k], -k), default=None)
        if best is None or same[best] < 0.7 * len(tokens):
            known.append((i, tokens))
            out.append(i)
        else:
            head, t = known[best]
            known[best] = head, [x if x == y else "<*>" for x, y in zip(tokens, t, strict=True)]
            out.append(head)
    return out


def brute_lines(rows, least):
    leaf, uses, full = defaultdict(set), defaultdict(set), defaultdict(set)
    key = lambda m: (m.count(" "), tuple(m.split(" ")[:3]))
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and line.split():
                m = masked(line)
                leaf[key(m)].add(m)
                uses[m].add(i)
                full[" ".join(line.split())].add(i)
    of, docs = {}, defaultdict(set)
    for ms in leaf.values():
        ms = sorted(ms, key=str.encode)
        for m, j in zip(ms, brute_templates(ms), strict=True):
            of[m] = ms[j]
            docs[ms[j]] |= uses[m]

    def stays(i, line):
        if i is None or not line.split():
            return True
        own, same = docs[of[masked(line)]], full[" ".join(line.split())]
        long = len(line.split()) >= 50 and len(same) >= 2 and min(same) != i
        return not long and (len(own) < least or min(own) == i)

    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if stays(i, x))) for i, t in rows]


def test_lines(spark, none):
    rows = [(i, f"Page {i} of {i + 3}\n\nonly here {chr(97 + i)} body\n  footer text  stays here now friend x{chr(97 + i)}y end of it") for i in range(12)]
    rows += [(50, None), (None, "Page 1 of 2"), (51, ""), (5, "Page 9 of 9\nq"), (5, "Page 9 of 9\nq"), (52, "z" * 50000)]
    docs = table(spark, [(i, t, "en", "a") for i, t in rows])
    got = lines.drop_recurring_lines(docs, min_docs=10)
    assert set(got.columns) >= {"mark", "key", "part", "n_lines", "n_dropped"}
    found = got.collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(brute_lines(rows, 10))
    assert {r.n_dropped for r in found if r.doc_id == 0} == {0} and {r.n_dropped for r in found if r.doc_id == 7} == {2}
    assert lines.drop_recurring_lines(none).collect() == []


def test_whole_leaves(spark, monkeypatch):
    """The similarity rule holds in a leaf of any size."""
    monkeypatch.setattr(lines, "HELD_LINES", 5)
    rows = [(i, f"same three words {chr(97 + i % 20)}{chr(97 + i // 20)} rest of it all") for i in range(60)]
    docs = table(spark, [(i, t, "en", "a") for i, t in [*rows, *[(100 + i, t) for i, t in rows]]])
    got = lines.drop_recurring_lines(docs, min_docs=2)
    assert got.agg(F.sum("n_dropped")).first()[0] == 119


def test_long_lines(spark):
    """A long line goes from the second document on if it is the same in full; a short one stays."""
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(49))
    rows = [(i, f"{long}  {end}\nshort line of both\n{long} {i}7") for i, end in ((1, "1"), (2, "1"), (3, "2"))]
    found = {r.doc_id: r for r in lines.drop_recurring_lines(table(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    assert {i: r.n_dropped for i, r in found.items()} == {1: 0, 2: 1, 3: 0}
    assert found[2].text == f"short line of both\n{long} 27"


def test_lines_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for least in (2, 10):
        got = lines.drop_recurring_lines(docs, min_docs=least)
        assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(brute_lines(rows, least))


def test_parser_gives_templates():
    r = random.Random(8)
    for width in (1, 2, 3, 4, 5, 8, 10, 23):
        for n in (2, 5, 60):
            found = sorted({" ".join(r.choice([lines.WILD, *map(chr, range(97, 97 + n))]) if r.random() < 0.4 else "abc"[i % 3] for i in range(width)) for _ in range(400)})
            parser, heads, got = lines.Parser(width, 0.7), {}, []
            for i, x in enumerate(found):
                got.append(heads.setdefault(parser.add(x), i))
            assert got == lines.templates(found) == brute_templates(found)


def brute_groups(rows, k):
    sets = {}
    for n, (i, t) in enumerate(rows):
        w = (t or "").encode().lower().split()
        width = min(k, len(w))
        sets[n] = (i, frozenset(tuple(w[j : j + width]) for j in range(len(w) - width + 1)) if w else frozenset())
    up = {n: n for n in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in sets.items():
        for b, (j, y) in sets.items():
            if a < b and x and y and i is not None and j is not None and 100 * len(x & y) >= 80 * len(x | y):
                up[find(b)] = find(a)
    least = {}
    for n, (i, _) in sets.items():
        if i is not None:
            least[find(n)] = min(least.get(find(n), i), i)
    return Counter((i, len(s), None if i is None else least[find(n)], i is None or least[find(n)] == i) for n, (i, s) in sets.items())


def test_groups(spark, none):
    r = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    rows = [(i, t) for i, t, _, _ in ODD if i not in (2,)]
    at = 100
    for size in (60, 200):
        for _ in range(6):
            w = [r.choice(words) for _ in range(size)]
            for _ in range(12):  # a drift: the ends of a chain are unlike, its neighbours alike
                rows.append((at, " ".join(w)))
                at += 1
                w[r.randrange(size)] = r.choice(words)
    rows += [(at + 1, "One two"), (at + 2, "ONE\x0btwo"), (at + 3, "one"), (at + 4, "ONE"), (at + 5, "one two three")]
    got = minhash.near_duplicates(table(spark, [(i, t, "en", "a") for i, t in rows]), words=2)
    assert Counter(map(tuple, got.collect())) == brute_groups(rows, 2)
    assert minhash.near_duplicates(none).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (200, 201), (201, 201)]
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found == {**{i: 0 for i in range(1, 31)}, 100: 90, 95: 90, 201: 200}
