"""The prefix trie against a plain dictionary of prefixes, at every span and number of partitions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from taxloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, name string, words string, grp int, key string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def table(spark, rows):
    return spark.createDataFrame([(*r, -1, "n", "w", 5, "k") for r in rows], SCHEMA)


def sequences(rows):
    """Each conversation's (role, text) turns in order."""
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            found[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    return {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in found.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    kids, leaves, saved = Counter(), Counter(), Counter()
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, m in members.items():
        own = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            saved[path[:d]] += own
            leaves[path[:d]] += not kids[path]
    wanted = Counter()
    for path, m in members.items():
        ends = ",".join(str(c) for c in m if len(convs[c]) == len(path))
        up = members[path[:-1]][0] if path else None
        wanted[m[0], len(path), up, len(m), kids[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return wanted


def found(df):
    assert df.columns == COLUMNS
    return Counter(map(tuple, df.collect()))


def mixed(seed, convs=60, turns=7, texts=3):
    """Conversations of few different turns, so that prefixes, whole copies and conversations inside others are common."""
    draw = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(draw.choice([0, 1, 1, 2, turns])):
            rows.append((c, t, draw.choice(["user", "assistant"]), " ".join(["word"] * draw.randrange(texts))))
    rows += [(c, t, "user", f"hot {t}") for c in range(convs, 2 * convs) for t in range(5)]
    rows += [(c, t, "user", f"hot {t}") for c in range(2 * convs, 2 * convs + 3) for t in range(3 + c % 3)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("span,parts", [(256, 1), (256, 7), (2, 1), (2, 5), (1, 3), (3, 40)])
def test_trie(spark, span, parts):
    rows = mixed(span + parts)
    got = trie.prefix_trie(trie.numbered_turns(table(spark, rows).repartition(3)), span=span, parts=parts)
    assert found(got) == brute(sequences(rows))


@pytest.mark.parametrize("span,parts", [(256, 3), (2, 4)])
def test_spliced(spark, span, parts):
    rows = [(c * 3 - 20, t, r, x) for c, t, r, x in mixed(11)]
    turns, convs = trie.spliced(trie.numbered_turns(table(spark, rows)))
    wanted = rebuilt({c: v for c, v in sequences(rows).items() if c >= 0})
    turns, convs = turns.filter("conv_id >= 0"), convs.filter("conv_id >= 0")
    assert any(not v for v in wanted.values())
    assert found(trie.prefix_trie(turns, convs, span=span, parts=parts)) == brute(wanted)


ODD = [
    (1, None, None, None),
    (1, 0, "user", ""),
    (1, 0, "user", "tie b"),
    (1, 0, "user", "tie a"),
    (1, 0, "user", "tie a"),
    (2, None, "", ""),
    (2, 0, "user", None),
    (None, 0, "user", "no conversation"),
    (3, 5, "a", "bc é d e\x0bf"),
    (4, 5, "ab", "c é d e\x0bf"),
    (5, -1, "user", "long " * 40000),
    (5, 3, "user", "x"),
    (6, -1, "user", "long " * 40000),
]


def test_odd_rows(spark):
    for span in (256, 1):
        assert found(trie.prefix_trie(trie.numbered_turns(table(spark, ODD)), span=span)) == brute(sequences(ODD))
    turns, convs = trie.spliced(trie.numbered_turns(table(spark, ODD)))
    assert found(trie.prefix_trie(turns, convs)) == brute(rebuilt(sequences(ODD)))
    turns, convs = trie.spliced(trie.numbered_turns(table(spark, [])))
    assert trie.prefix_trie(turns, convs).collect() == []


def test_long_copies(spark):
    """Copies of a long conversation share several levels; what only one of them has is a chain."""
    rows = [(c, t, "user", f"{t} of many") for c in (3, 4, 9) for t in range(50)] + [(4, 50 + t, "user", f"only {t}") for t in range(30)] + [(7, t, "user", f"{t} of many") for t in range(16)]
    assert found(trie.prefix_trie(trie.numbered_turns(table(spark, rows)), span=8, parts=3)) == brute(sequences(rows))
