"""Exact deduplication by a tree-merge of sorted digest runs, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxloom.llm.common import shuffle_partitions

ROUNDS = 3
DIGEST = ["text_sha256", "text_check", "text_bytes"]


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, SHA-256 of the text, and what verifies it: a second hash and the length in bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        F.sha2(text, 256).alias("text_sha256"),
        F.xxhash64(text).alias("text_check"),
        F.octet_length(text).alias("text_bytes"),
    )


def merged_runs(digested: DataFrame, keep: str = "max", runs: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row for each digest, with the identifier to keep and the number of copies, merged level by level.

    There are as many runs as shuffle partitions, rounded up to a power of two, and each is one partition. Input
    partitions are dealt to runs as they come. In each round, runs whose numbers differ in the next few bits only exchange
    their parts: a row moves to the run that has its digest's bits there. That run sorts what it gets by digest and identifier
    and merges it in one pass over the sorted rows: a window of one digest's rows, of which the first stays, verified by the second
    hash and the length, with the sum of the copies. After ``rounds`` rounds a run holds a slice of the digests, sorted, and
    no digest is in two runs. A large group of copies is spread over all runs but for the first round's bits when it is first merged; from
    then on it has one row for each run at most.
    """
    order = {"max": F.desc_nulls_last("keep_id"), "min": F.asc_nulls_last("keep_id")}[keep]
    bits = max(1, ((runs or shuffle_partitions(digested.sparkSession)) - 1).bit_length())
    fan = -(-bits // rounds)
    runs = 1 << bits
    slice_ = F.expr(f"cast(conv(substr(text_sha256, 1, 7), 16, 10) as int) % {runs}")
    alike = Window.partitionBy("run", *DIGEST)
    level = digested.select(F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"), *DIGEST, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("copies"))
    for low in range(0, bits, fan):
        mask = ((1 << min(fan, bits - low)) - 1) << low
        to = F.col("run").bitwiseAND(runs - 1 - mask).bitwiseOR(slice_.bitwiseAND(mask))
        dealt = level.withColumn("run", to).repartitionById(runs, F.col("run"))
        merged = dealt.withColumn("place", F.row_number().over(alike.orderBy(order))).withColumn("copies", F.sum("copies").over(alike))
        level = merged.filter("place = 1").drop("place")
    return level.drop("run")


def exact_dedup(docs: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Mark for every document the copy that stays.

    Texts are equal when they are identical: no normalisation is done. Of equal texts the row with the largest id
    stays (``keep='min'``: the smallest). Returns id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Null text counts as empty, so nulls and empty texts are one group. If a row with a repeated id and text stays, all
    rows with that id and text are marked as kept. A row with a null id counts in its group's size; it stays only if
    no copy has an id (``keep_id`` is then null). Other columns are ignored; an empty table gives an empty result.
    """
    digested = digests(docs, id_col, text_col)
    final = merged_runs(digested, keep)
    return digested.join(final, DIGEST).select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("copies").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
