"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16
PARTS = 1000
PERIOD = 1 << 17
CELL_ROWS = 2000


def shares(weights: dict, most: int = PERIOD) -> dict:
    """Whole slots of a period for each source of positive weight, in proportion to the weights.

    Weights are non-negative whole numbers. Divided by their greatest common divisor they are the slots of the shortest
    period that is exactly fair. Only where that has more than ``most`` slots (or twice the number of sources) are they
    rounded to so many, by largest remainders and with one slot at least.
    """
    if any(w < 0 or w != int(w) for w in weights.values()):
        raise ValueError("weights are whole numbers, 0 or more")
    wanted = {s: int(w) for s, w in weights.items() if w}
    if not wanted:
        return {}
    common = math.gcd(*wanted.values())
    total, n = sum(wanted.values()) // common, len(wanted)
    most = max(most, 2 * n)
    if total <= most:
        return {s: w // common for s, w in wanted.items()}
    rest = most - n  # each has one slot
    slots = {s: 1 + rest * (w // common) // total for s, w in wanted.items()}
    left = most - sum(slots.values())
    for s in sorted(wanted, key=lambda s: (-(rest * (wanted[s] // common) % total), s))[:left]:
        slots[s] += 1
    return slots


def pfair(slots: dict) -> list[tuple]:
    """One period of the schedule: (source, k, slot, release, deadline) for each source's k-th block.

    With c of D slots, block k has release floor(k D / c) and deadline ceil((k + 1) D / c). In each slot the released
    block with the earliest deadline runs (ties: by name). The slots of a period are all taken and every deadline is
    met, so that at any time a source is within one block of its share, and the next period repeats this one.
    """
    period = sum(slots.values())
    waiting = [(0, s, 0) for s in sorted(slots)]
    heapq.heapify(waiting)
    ready: list[tuple] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // slots[s]), s, k, release))
        deadline, s, k, release = heapq.heappop(ready)
        out.append((s, k, slot, release, deadline))
        if k + 1 < slots[s]:
            heapq.heappush(waiting, ((k + 1) * period // slots[s], s, k + 1))
    return out


def source_key(source_col: str):
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))


def root_weights(counts: dict, parts: int = PARTS) -> dict:
    """Target weights, in parts of about ``parts``, that rise with the square root of the rows; one part at least.

    Large sources are damped and small ones lifted.
    """
    roots = {s: math.isqrt(n * 1_000_000) for s, n in counts.items()}
    total = sum(roots.values())
    return {s: max(1, (2 * parts * r + total) // (2 * total)) for s, r in roots.items()}


def _last_slots(counts: dict, slots: dict, plan: list[tuple], block_rows: int) -> int:
    """The first slot after all blocks of the sources with slots."""
    length = sum(slots.values())
    ends = {s: divmod(-(-counts[s] // block_rows) - 1, c) for s, c in slots.items()}
    return max((ends[s][0] * length + slot + 1 for s, k, slot, _, _ in plan if ends[s][1] == k), default=0)


def mix(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS, period: int = PERIOD, id_col: str = "doc_id", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Interleave the sources' blocks to target weights; every row gets its place.

    ``weights`` maps source names (None for null) to whole numbers. Without weights they follow the square roots of the
    sources' rows, in parts of a thousand. A source's rows are ordered by the MD5 of their id and cut into blocks of
    ``block_rows``. With weight w of W in all, block k is released at slot floor(k W / w) and due by ceil((k + 1) W / w),
    and runs in the slot that :func:`pfair` gives it. While no source has run out, the rows of the slots before any
    slot hold each source to less than one block of its weight. When a source has run out its slots stay empty, the
    others go on, and no row is dropped. The schedule repeats after W / gcd slots; only if those are more than
    ``period`` are the weights rounded to that many slots (:func:`shares`), and it is fair to the rounded ones.

    Sources without a weight, or with weight 0, have no share: their blocks follow after all others', in equal turns.

    One count and one period of slots for each source pass through the driver. A row's number in its source is the
    number of rows in earlier cells of the source plus its number in its cell; cells are hash ranges of the order, of
    about ``CELL_ROWS`` rows, so that a source with a third of all rows is many cells.

    Returns id, source, ``target`` (its weight's share of all weights), ``block``, ``block_row``, ``release``,
    ``deadline``, ``slot``; (slot, block_row) is the mixed order. Null sources are a source of their own. Repeated rows
    each have a place; a null id orders as an empty text. ``keep`` names further columns to hand on; others are ignored.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    keyed = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        source_key(source_col).alias("key"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("mark"),
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
    )
    counts = {r["key"]: r["count"] for r in keyed.groupBy("key").count().collect()}  # a row for each source
    if weights is None:
        wanted = root_weights(counts)
    else:
        named = {"null" if s is None else f"s{s}": w for s, w in weights.items()}
        wanted = {s: named.get(s, 0) for s in counts}
    slots = shares(wanted, period)
    plan = pfair(slots)
    after = _last_slots(counts, slots, plan, block_rows)
    last = shares({s: 1 for s in counts if s not in slots})
    total = sum(wanted.values())
    turns = [(slots, plan, 0), (last, pfair(last), after)]
    schedule = spark.createDataFrame(
        [(s, k, at + slot, at + release, at + deadline, own[s], sum(own.values()), wanted[s] / total if total else 0.0) for own, found, at in turns for s, k, slot, release, deadline in found],
        "key string, turn long, slot0 long, release0 long, deadline0 long, slots long, length long, target double",
    )  # a period of rows
    bits = max(0, min(28, math.ceil(math.log2(max(1, max(counts.values(), default=1)) / CELL_ROWS))))
    celled = keyed.withColumn("cell", F.expr(f"shiftright(cast(conv(substr(mark, 1, 7), 16, 10) as bigint), {28 - bits})"))
    sizes = celled.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("key", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("key", "cell").orderBy("mark", "id")
    numbered = celled.withColumn("number", F.row_number().over(within) - 1).join(offsets, ["key", "cell"])
    blocked = numbered.withColumns(
        {"block": F.expr(f"(offset + number) div {block_rows}"), "block_row": F.expr(f"cast((offset + number) % {block_rows} as int)")}
    )
    shares_ = F.broadcast(schedule.select("key", "slots", "length").distinct())
    turned = blocked.join(shares_, "key").withColumns({"turn": F.expr("block % slots"), "start": F.expr("(block div slots) * length")})
    return turned.drop("slots", "length").join(F.broadcast(schedule), ["key", "turn"]).select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "target",
        "block",
        "block_row",
        (F.col("start") + F.col("release0")).alias("release"),
        (F.col("start") + F.col("deadline0")).alias("deadline"),
        (F.col("start") + F.col("slot0")).alias("slot"),
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
    )
