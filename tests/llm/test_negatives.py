"""Hard negatives against scores of all pairs in plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, block int, norm string, angles string"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, "r", 3, "n", "a") for i, v, label in rows], SCHEMA)


def brute(rows, every=5, positives=5, n=3):
    """The rows' own order stands in for a row number; it only decides between rows that give the same result."""
    whole = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = Counter()
    for k, (i, v, label) in enumerate(whole):
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j or 0, other) for m, (j, w, other) in enumerate(whole) if m != k]
        scored.sort(key=lambda x: x[:3])
        for s, none, j, _ in [x for x in scored if x[3] == label][:positives]:
            inside = [x for x in scored if x[3] != label and 50 * -s <= 100 * -x[0] and 100 * -x[0] <= 95 * -s]
            for rank, x in enumerate(inside[:n], 1):
                out[i, None if none else j, rank, None if x[1] else x[2], -s, -x[0]] += 1
    return out


def mined(df, every=5, **options):
    got = negatives.mine_hard_negatives(negatives.quantised(df), F.col("vec_id") % every == 0, **options)
    assert got.columns == COLUMNS
    return Counter(map(tuple, got.collect()))


def clustered(seed, n, dims=6, labels=4, spread=0.3):
    draw = random.Random(seed)
    centers = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(9)]
    return [(i, [x * draw.choice([0.5, 1, 2]) + draw.gauss(0, spread) for x in draw.choice(centers)], draw.randrange(labels) if draw.random() < 0.6 else 0) for i in range(n)]


@pytest.mark.parametrize("block_rows,references", [(8192, 8), (40, 4), (16, 12), (64, 1)])
def test_all_pairs(spark, block_rows, references):
    rows = clustered(block_rows, 400)
    got = mined(table(spark, rows).repartition(4), block_rows=block_rows, references=references)
    assert got == brute(rows) and len(got) > 300


def test_teams(spark):
    """More blocks than anchors of one team come from."""
    rows = clustered(5, 300, spread=0.05)
    assert mined(table(spark, rows), every=3, block_rows=4) == brute(rows, every=3)


def test_most_of_one_label(spark):
    """Copies of one vector and one label for nearly all rows; ties go by id."""
    rows = [(i, [0.5, 0.25, -0.125], 1) for i in range(300)] + [(300 + i, [0.5 - i / 100, 0.2, 0.01 * i], 2) for i in range(50)]
    assert mined(table(spark, rows).repartition(3), block_rows=20) == brute(rows)


ODD = [
    (0, [1.0, 0.5], 1),
    (0, [1.0, 0.5], 1),
    (5, [1.0, 0.5], 2),
    (10, None, 1),
    (15, [1.0, None], 1),
    (20, [math.nan, 1.0], 1),
    (25, [math.inf, 1.0], 2),
    (30, [1.0, 0.5], None),
    (35, [], 1),
    (40, [0.0, 0.0], 1),
    (45, [1.0], 2),
    (50, [1.0, 0.5, 3.0], 1),
    (None, [0.75, 0.5], 2),
    (None, [0.9, 0.5], 1),
    (1, [0.7, 0.5], 2),
    (2, [0.7, 0.5], 2),
    (2, [0.7, 0.5], 3),
    (3, [-1.0, -0.5], 1),
    (55, [-1.0, -0.5], 3),
    (4, [-0.001, 0.001], 3),
    (60, [1000.0, -2000.0], 4),
    (6, [900.0, -1500.0], 4),
    (7, [700.0, -1000.0], 5),
    (65, [3e6, 3e6], 6),
    (8, [3e6, 2e6], 6),
    (9, [2e6, 2e6], 7),
]


def test_odd_rows(spark):
    assert mined(table(spark, ODD)) == brute(ODD)
    assert mined(table(spark, ODD), block_rows=2, references=3) == brute(ODD)
    assert mined(table(spark, [])) == Counter()
    assert mined(table(spark, [(1, [0.5], 1), (2, [0.5], 1)])) == Counter()


def test_bounds_leave_rows_out(spark):
    """In tight clusters far apart, windows hold few of a block's rows, and all that score enough."""
    draw = random.Random(3)
    centers = np.linalg.qr(np.random.default_rng(1).normal(size=(16, 16)))[0]
    rows = [(i, (centers[i % 16] + [draw.gauss(0, 0.01) for _ in range(16)]).tolist(), 0) for i in range(1600)]
    whole = negatives.quantised(table(spark, rows))
    directions = negatives._references(whole, 16, 8)
    angled = whole.withColumn("anchor", F.lit(True)).mapInArrow(negatives._angles(16, directions), negatives.VECTOR)
    block = negatives._Block(angled.toArrow(), 8)
    norms = float(block.norm.min()), float(block.norm.max())
    seen = 0
    for k in range(0, 1600, 20):
        scores = block.scores(block.x[k], slice(None))
        least = int(np.sort(scores)[-6])
        low, high = block.window(float(block.angle[k]), float(block.norm[k]), norms, least, math.inf)
        assert set(np.flatnonzero(scores >= least)) <= set(range(low, high))
        low2, high2 = block.window(float(block.angle[k]), float(block.norm[k]), norms, 5, least)
        assert set(np.flatnonzero((scores >= 5) & (scores <= least))) <= set(range(low2, high2))
        seen += high - low
    assert seen < 0.95 * 80 * 1600
