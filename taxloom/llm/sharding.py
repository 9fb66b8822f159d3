"""Sharding by global byte-size prefix sums, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxloom.llm.common import cut, prefix_sums

SHARDS = 16
WHOLE = 100


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut the documents, in one global order, into contiguous shards of equal bytes.

    The order is (MD5 of the text, id): equal texts are neighbours, and the sources mix. A document's size is its UTF-8
    bytes plus 1; it goes to the shard in which its first byte falls when all bytes are cut at equal targets. A group of
    equal texts that a cut would divide goes whole to the shard of its first byte, if it has no more than one part in
    ``WHOLE`` of a shard's bytes; larger ones are divided. Shards therefore differ from equal ones by less than one document and
    one such part.

    Returns id, ``size``, ``text_crc32``, ``law`` ('bytes'), ``shard``, ``slot`` (0, 1, ... within the shard),
    ``grown_shard`` (null: adding a shard moves every cut), ``byte_offset`` (its first byte in the global order).

    Null text has size 1 and the CRC of an empty text. Null and repeated ids keep all their rows. An empty table gives
    an empty result; with fewer documents than shards some shards are empty. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("text_md5"),
    )
    summed = cut(prefix_sums(narrow, ["text_md5", "id"], "size"))
    own = F.expr(f"int(before * {shards} div total)")
    borders = summed.withColumn("shard", own).groupBy("shard").agg(F.min_by("text_md5", "index").alias("text_md5")).select("text_md5").distinct()  # a row for each shard
    groups = summed.join(F.broadcast(borders), "text_md5").groupBy("text_md5").agg(F.min("before").alias("start"), F.sum("size").alias("bytes"), F.max("total").alias("all"))
    whole = groups.filter(f"bytes * {shards * WHOLE} <= all").select("text_md5", "start")
    placed = summed.join(F.broadcast(whole), "text_md5", "left").withColumn("shard", F.expr(f"int(coalesce(start, before) * {shards} div total)"))
    firsts = placed.groupBy("shard").agg(F.min("index").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("index") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("before").alias("byte_offset"),
    )
