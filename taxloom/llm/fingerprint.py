"""Document fingerprints by locally consistent parsing, and their likeness to edited texts and neighbours."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxloom.llm.common import shuffle_partitions
from taxloom.llm.phrases import fingerprints, likeness

CHUNK = 1 << 19
SLICES = 4


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_chars`` and ``fingerprint`` of each whole text, without a shuffle.

    The fingerprint is the hexadecimal form of the smallest hashes of the phrase names: those of the two upper levels of
    the parse (even) and those of the lowest (odd). It depends on the text alone. Null counts as empty, whose fingerprint is empty; rows with repeated or null
    ids each have theirs; other columns are ignored.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def name(batches):
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts, held, to = [], 0, at
                while to < batch.num_rows and (held < CHUNK or to == at):
                    texts.append(batch.column(1)[to].as_py())
                    held += len(texts[-1])
                    to += 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at:to], pa.array([len(t) for t in texts], pa.int64()), pa.array([_hex(x) for x in fingerprints(texts)], pa.string())],
                    names=["id", "n_chars", "fingerprint"],
                )
                at = to

    return narrow.mapInArrow(name, f"id {kind}, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


def _hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the first as many code points of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _compared(rows: list[tuple], n: int) -> dict:
    """Columns for the first n of rows (id, text), each with the row after it."""
    texts = [t for _, t in rows]
    changed = [edited(texts[i], texts[i + 1]) for i in range(n)]
    own, other = fingerprints(texts), fingerprints(changed)
    return {
        "n_chars": [len(t) for t in texts[:n]],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
        "fingerprint": [_hex(x) for x in own[:n]],
        "edited_fingerprint": [_hex(x) for x in other],
        "near_edited": [likeness(own[i], other[i]) for i in range(n)],
        "near_next": [likeness(own[i], own[i + 1]) for i in range(n)],
    }


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text, its edited form and its successor, and say how alike they are.

    Documents follow each other by descending id (null ids last; of one id, or of none, by descending hash of the text),
    and the first follows the last. Ids are cut at quantiles into slices, rows without id by their hash; each slice
    gets, as a guest, the first document of the slice after it, so one shuffle puts every text beside its successor and a
    task streams through its slices. Ids are numbers.

    Returns id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.
    Null counts as empty; an empty text is like another empty one (1) and unlike all others (0). A single document
    follows itself. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    kind = narrow.schema["id"].dataType.simpleString()
    n = shuffle_partitions(spark)
    cuts = narrow.select(F.percentile_approx("id", [i / (SLICES * n) for i in range(1, SLICES * n)], F.lit(10_000)).alias("q")).first()["q"] or []
    bounds = F.array(*[F.lit(x) for x in sorted(set(cuts))]).cast(f"array<{kind}>")
    null_slice = F.expr(f"int(({2**63 - 1} - cast(tie as decimal(20))) * {SLICES * n} / {2**64})")
    sliced = narrow.withColumn("part", F.when(F.col("id").isNull(), F.size(bounds) + null_slice).otherwise(F.size(F.filter(bounds, lambda b: b > F.col("id")))))
    heads = sliced.groupBy("part").agg(F.max(F.struct("id", "tie", "text")).alias("head"))
    order = Window.orderBy("part")  # of one row for each slice
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    guests = heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(everything)).alias("head"))
    rows = sliced.select("part", F.lit(False).alias("guest"), "id", "tie", "text").unionByName(guests.select("part", F.lit(True).alias("guest"), "head.id", "head.tie", "head.text"))
    placed = rows.repartition(n, "part").sortWithinPartitions("part", "guest", F.desc_nulls_last("id"), F.desc("tie"), F.desc("text")).drop("tie")

    def compare(batches):
        held: list[tuple] = []
        size = 0

        def flush(last: bool):
            n = len(held) if last else len(held) - 1
            rows = [(i, t) for _, i, t in held]
            wanted = [k for k in range(n) if not held[k][0]]
            if wanted:  # a guest is the last of its slice
                found = _compared(rows, len(rows) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows[k][0] for k in wanted], own_kind)] + [pa.array([v[k] for k in wanted], pa.float64() if c[:4] == "near" else pa.int64() if c == "n_chars" else pa.string()) for c, v in found.items()],
                    names=["id", *found],
                )
            held[:] = held[n:]

        own_kind = None
        for batch in batches:
            own_kind = batch.schema.field(2).type
            for at in range(0, batch.num_rows, 256):
                guest, ids, texts = (batch.column(i)[at : at + 256].to_pylist() for i in (1, 2, 3))
                for row in zip(guest, ids, texts, strict=True):
                    held.append(row)
                    size += len(row[2])
                    if size > CHUNK and len(held) > 1:
                        yield from flush(False)
                        size = len(held[0][2])
        if held:
            yield from flush(True)

    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return placed.mapInArrow(compare, schema).withColumnRenamed("id", id_col)
