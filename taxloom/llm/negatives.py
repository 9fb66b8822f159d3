"""Hard negatives by angular triangle filtering: stored angles bound scores, and only rows within the bounds are scored."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxloom.llm.common import BROADCAST_ROWS, cut, shuffle_partitions

SCALE = 256
REFERENCES, SAMPLE = 8, 1000
BLOCK_ROWS, ANCHOR_BLOCKS = 8192, 50
NEAREST = 64
#: Radians and shares by which bounds are loosened, far more than what rounding can take from them.
SLACK, LOOSE = 1e-6, 1e-9
#: Sums of products below this are exact in double precision.
EXACT = 1 << 53

VECTOR = "row long, vec_id long, label long, anchor boolean, vec binary, norm double, near int, angle double, angles array<double>"
SCORED = "anchor long, goal long, row long, vec_id long, score long"
ARROW_SCORED = pa.schema([(c.split()[0], pa.int64()) for c in SCORED.split(", ")])


def quantised(embeddings: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(row, vec_id, label, components): whole-number vectors, ``floor(scale * x)`` of each component.

    Rows with a null label, a null vector, or a null or non-finite component are left out. ``row`` tells rows with the
    same id apart. The result is checkpointed, which is what fixes the row numbers.
    """
    usable = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(math.inf)))
    rows = embeddings.filter(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).filter(usable)
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), whole.alias("components")))


def _padded(lists: pa.Array, width: int) -> np.ndarray:
    """A matrix of the lists, the shorter ones filled up with zeros."""
    sizes = np.asarray(lists.value_lengths())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _references(rows: DataFrame, width: int, n: int) -> np.ndarray:
    """Unit vectors of rows far from each other, from a sample of ``SAMPLE`` rows; axes where there are not enough."""
    sample = rows.orderBy(F.xxhash64("vec_id", "row")).limit(SAMPLE).select("components").toArrow().column("components").combine_chunks()
    x = _padded(sample, width).astype(float)
    x = x[np.linalg.norm(x, axis=1) > 0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chosen: list[np.ndarray] = []
    near = np.full(len(x), -2.0)
    while len(chosen) < n and len(x) and near.min() < 1 - LOOSE:
        chosen.append(x[near.argmin()])
        near = np.maximum(near, x @ chosen[-1])
    axes = np.eye(max(width, 1))[: n - len(chosen), :width]
    return np.vstack([*chosen, axes]) if len(chosen) or len(axes) else axes


def _angles(width: int, references: np.ndarray):
    def run(batches):
        """Norms and the angles to each reference; a vector of zeros is at right angles to all, and its bounds are 0."""
        for b in batches:
            x = _padded(b.column("components"), width)
            norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))
            cosine = (x @ references.T) / np.where(norm > 0, norm, 1)[:, None]
            angles = np.arccos(np.clip(cosine, -1, 1))
            near = angles.argmin(axis=1)
            vectors = [r.tobytes() for r in x]
            at = [b.column(c) for c in ("row", "vec_id", "label", "anchor")]
            yield pa.RecordBatch.from_arrays(
                [*at, pa.array(vectors, pa.binary()), pa.array(norm), pa.array(near.astype(np.int32)), pa.array(angles[np.arange(len(x)), near]), pa.array(list(angles), pa.list_(pa.float64()))],
                names=[c.split()[0] for c in VECTOR.split(", ")],
            )

    return run


class _Block:
    """Rows of one block, or those of one label in it, in order of their angle to one reference."""

    def __init__(self, table: pa.Table, references: int) -> None:
        self.row, self.label = (table.column(c).to_numpy() for c in ("row", "label"))
        self.no_id = np.asarray(table.column("vec_id").is_null())
        self.vec_id = table.column("vec_id").fill_null(0).to_numpy()
        self.x = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.int64).reshape(len(self.row), -1)
        self.norm = table.column("norm").to_numpy()
        angles = table.column("angles").combine_chunks().flatten().to_numpy().reshape(len(self.row), references)
        self.by = int(table.column("near")[0].as_py())
        self.order_by_angle(angles[:, self.by])
        self.most = float(np.abs(self.x).max(initial=0))
        self.real = self.x.astype(float)

    def order_by_angle(self, angle: np.ndarray) -> None:
        order = np.argsort(angle, kind="stable")
        self.angle = angle[order]
        for name in ("row", "label", "no_id", "vec_id", "x", "norm"):
            setattr(self, name, getattr(self, name)[order])

    def scores(self, vector: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        """Exact inner products with some rows, in double precision where that is exact."""
        if float(np.abs(vector).max(initial=0)) * self.most * max(1, len(vector)) < EXACT:
            return (self.real[at] @ vector.astype(float)).astype(np.int64)
        return self.x[at] @ vector

    def window(self, angle: float, norm: float, norms: tuple[float, float], least: float, most: float) -> tuple[int, int]:
        """First and last (exclusive) row whose score can be from ``least`` to ``most``, as the angles have it.

        The angle between two vectors is at least the difference of their angles to a reference, and at most their sum.
        """
        low, high = 0.0, math.pi
        least, most = least - abs(least) * LOOSE - 1, most + abs(most) * LOOSE + 1
        top = norm * (norms[1] if least > 0 else norms[0])
        if least > 0 and least > top:
            return 0, 0
        if top > 0:
            apart = math.acos(max(-1.0, min(1.0, least / top))) + SLACK
            low, high = max(low, angle - apart), min(high, angle + apart)
        bottom = norm * (norms[0] if most > 0 else norms[1])
        if bottom > 0 and most < bottom:  # below this sum of angles every score is above most
            low = max(low, math.acos(max(-1.0, most / bottom)) - angle - SLACK)
        return int(np.searchsorted(self.angle, low)), int(np.searchsorted(self.angle, high, "right"))

    def best(self, scores: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """The first n of some rows: by score, then smaller id, rows without one last."""
        return np.lexsort((self.row[at], self.vec_id[at], self.no_id[at], -scores))[:n]


def _batch(out: list[tuple]) -> pa.Table:
    columns = list(zip(*out, strict=True)) or [[]] * len(ARROW_SCORED)
    return pa.table([pa.array(c, pa.int64()) for c in columns], schema=ARROW_SCORED)


def _nearest(references: int, n: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        """For each anchor the first n other rows of its label in the block, but for those that can't reach its ``least``."""
        out: list[tuple] = []
        if not len(anchors) or not len(rows):
            return _batch(out)
        block = _Block(rows, references)
        of = {label: np.flatnonzero(block.label == label) for label in np.unique(block.label)}
        angles = block.angle
        for a in anchors.to_pylist():
            at = of.get(a["label"])
            if at is None:
                continue
            vector, angle = np.frombuffer(a["vec"], np.int64), a["angles"][block.by]
            norms = float(block.norm[at].min()), float(block.norm[at].max())
            least = a["least"] if a["least"] is not None else -math.inf
            center = int(np.searchsorted(angles[at], angle))
            first, last = max(0, center - NEAREST // 2), min(len(at), center + NEAREST // 2)
            near = at[first:last]
            near = near[block.row[near] != a["row"]]
            scores = block.scores(vector, near)
            if len(scores) >= n:
                least = max(least, int(np.partition(scores, len(scores) - n)[len(scores) - n]))
            if least > -math.inf:
                low, high = block.window(angle, a["norm"], norms, least, math.inf)
                inside = at[np.searchsorted(at, low) : np.searchsorted(at, high)]
            else:
                inside = at
            inside = inside[block.row[inside] != a["row"]]
            scores = block.scores(vector, inside)
            for i in block.best(scores, inside, n):
                k = inside[i]
                out.append((a["row"], None, int(block.row[k]), None if block.no_id[k] else int(block.vec_id[k]), int(scores[i])))
        return _batch(out)

    return run


def _within(references: int, n: int, low: int, high: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        """For each anchor and goal the first n rows of other labels with ``low`` to ``high`` percent of the goal's score."""
        out: list[tuple] = []
        if not len(anchors) or not len(rows):
            return _batch(out)
        block = _Block(rows, references)
        norms = float(block.norm.min()), float(block.norm.max())
        for a in anchors.to_pylist():
            goals = [(g, -(-low * g // 100), high * g // 100) for g in a["goals"]]
            least, most = min(x for _, x, _ in goals), max(y for _, _, y in goals)
            first, last = block.window(a["angles"][block.by], a["norm"], norms, least, most)
            if first >= last:
                continue
            scores = block.scores(np.frombuffer(a["vec"], np.int64), slice(first, last))
            at = np.flatnonzero((scores >= least) & (scores <= most) & (block.label[first:last] != a["label"]))
            scores, at = scores[at], at + first
            order = block.best(scores, at, len(at))
            scores, at = scores[order], at[order]
            for goal, x, y in goals:
                begin, end = np.searchsorted(-scores, -y), np.searchsorted(-scores, -x, "right")
                for i in range(begin, min(end, begin + n)):
                    k = at[i]
                    out.append((a["row"], goal, int(block.row[k]), None if block.no_id[k] else int(block.vec_id[k]), int(scores[i])))
        return _batch(out)

    return run


def _reach() -> tuple[Column, Column]:
    """Lower and upper bound of an anchor's scores with a block's rows, from the block's ranges of angles and norms."""
    gap = F.array_max(F.transform("angles", lambda t, i: F.greatest(F.get("lows", i) - t, t - F.get("highs", i), F.lit(0.0))))
    turn = F.lit(math.pi)

    def widest(t: Column, i: Column) -> Column:
        low, high = F.get("lows", i), F.get("highs", i)
        return F.when(t + high <= turn, t + high).when(t + low >= turn, 2 * turn - t - low).otherwise(turn)

    near, far = F.cos(F.greatest(F.coalesce(gap, F.lit(0.0)) - SLACK, F.lit(0.0))), F.cos(F.least(F.coalesce(F.array_min(F.transform("angles", widest)), turn) + SLACK, turn))
    at = lambda c, norm: c * F.col("norm") * norm
    upper = F.greatest(at(near, F.col("longest")), at(near, F.col("shortest")))
    lower = F.least(at(far, F.col("longest")), at(far, F.col("shortest")))
    return lower - F.abs(lower) * LOOSE - 1, upper + F.abs(upper) * LOOSE + 1


def mine_hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, references: int = REFERENCES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For every anchor and each of its positives, the hard negatives.

    ``rows`` comes from :func:`quantised`; ``anchors`` is a condition over its columns. A row's score is its integer inner
    product with the anchor; higher scores come first, ties by smaller id (rows without an id last). An anchor's
    positives are its first other rows of the same label; a positive's negatives are the first rows of other labels whose
    scores are ``low`` to ``high`` percent of the positive's. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    Every row stores its angles to a few reference directions. By the triangle inequality these bound the angle between
    an anchor and a row, and with the norms the score. Rows are range partitioned by their nearest reference and
    their angle to it into blocks, each with its range of angles and norms. An anchor first meets its own block, which tells
    what its positives score at least; then it goes to the blocks whose bounds reach that, and there to the window of rows that do. Positives
    fix the range of its negatives' scores; again only blocks and windows that overlap it are scored. Bounds are loosened
    by more than rounding can take, so nothing is lost; on data without any direction they leave most rows to be scored.

    Anchors are a stated query set that meets all rows in blocks of ``block_rows`` rows; a task holds one block and the
    anchors of ``ANCHOR_BLOCKS`` blocks. Each task hands on a few rows for an anchor. Labels are looked up inside a block, so
    a label with most rows is cut like any other. Shorter vectors count as filled up with zeros. Rows with a repeated id are
    rows of their own, and an anchor with a repeated id has rows for each. Scores must fit in 64 bits. An empty table, or
    one without anchors, gives an empty result.
    """
    spark = rows.sparkSession
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("components")).alias("width")).first()
    width = facts["width"] or 0
    directions = _references(rows, width, references)
    k = len(directions)
    blocks = max(shuffle_partitions(spark), -(-facts["n"] // block_rows))
    angled = rows.withColumn("anchor", F.coalesce(anchors, F.lit(False))).mapInArrow(_angles(width, directions), VECTOR)
    order = ["near", "angle", "row"]
    placed = cut(angled.repartitionByRange(blocks, *order).withColumn("block", F.spark_partition_id()).withColumn("team", F.expr(f"block div {ANCHOR_BLOCKS}")))
    ranges = [F.array(*[f(F.get("angles", F.lit(i))) for i in range(k)]).alias(c) for f, c in ((F.min, "lows"), (F.max, "highs"))]
    known = cut(placed.groupBy("block").agg(*ranges, F.min("norm").alias("shortest"), F.max("norm").alias("longest")))  # a row for each block
    few = blocks <= BROADCAST_ROWS
    asked = placed.filter("anchor").select("row", "vec_id", "label", "vec", "norm", "angles", "team", F.col("block").alias("own"))
    side = ["row", "vec_id", "label", "vec", "norm", "near", "angles"]

    def meet(who: DataFrame, whom: DataFrame, how) -> DataFrame:
        whom = whom.select([F.col(c).alias(c) for c in whom.columns])  # both come from the same rows
        return who.groupBy("team", "block").cogroup(whom.groupBy("team", "block")).applyInArrow(how, SCORED)

    def sent(who: DataFrame, need: Column) -> tuple[DataFrame, DataFrame]:
        """Anchors with each block whose bounds meet the need, and the rows of those blocks for each team of anchors."""
        lower, upper = _reach()
        copies = who.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(F.broadcast(known) if few else known, "block")
        copies = copies.withColumn("lower", lower).withColumn("upper", upper).filter(need).drop("lower", "upper", "lows", "highs", "shortest", "longest")
        wanted = copies.select("team", "block").distinct()  # teams times blocks at most
        few_pairs = blocks * (blocks // ANCHOR_BLOCKS + 1) <= BROADCAST_ROWS
        return copies, placed.select("block", *side).join(F.broadcast(wanted) if few_pairs else wanted, "block")

    nearest = _nearest(k, positives)
    home = meet(asked.withColumn("block", F.col("own")).withColumn("least", F.lit(None).cast("long")), placed.select("team", "block", *side), nearest)
    home = cut(home)
    least = home.groupBy(F.col("anchor").alias("row")).agg(F.when(F.count(F.lit(1)) >= positives, F.min("score")).alias("least"))
    away = meet(*sent(asked.join(least, "row", "left"), F.expr("block <> own and (least is null or upper >= least)")), nearest)
    by_anchor = Window.partitionBy("anchor").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    first = home.unionByName(away).withColumn("place", F.row_number().over(by_anchor)).filter(F.col("place") <= positives)
    first = cut(first.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "place"))
    goals = first.filter("positive_score >= 0").groupBy(F.col("anchor").alias("row")).agg(F.collect_set("positive_score").alias("goals"))  # of so many positives
    goals = goals.withColumn("from", F.array_min("goals") * (low / 100) - 1).withColumn("to", F.array_max("goals") * (high / 100) + 1)
    found = meet(*sent(asked.join(goals, "row"), F.expr("upper >= from and lower <= to")), _within(k, negatives, low, high))
    by_goal = Window.partitionBy("anchor", "goal").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    found = found.withColumn("rank", F.row_number().over(by_goal)).filter(F.col("rank") <= negatives)
    found = found.select("anchor", F.col("goal").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return first.join(found, ["anchor", "positive_score"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
