"""A training corpus from ``documents``: five operators, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxloom.llm import langid, lines, minhash, mixing, pieces
from taxloom.llm.common import cut, discard, shuffle_partitions, stored

LEAST_SCORE = 0.5
BROADCAST_ROWS = 100_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without a letter and those of which no language has half the letters; name null languages.

    Null and empty texts go, as they have no letter. Each row is judged alone, by its text, so repeated and null ids
    don't matter; an empty table gives an empty result. Where no row has both text and language nothing can be learned
    and all rows go. Other columns than a document's go no further.
    """
    model = langid.fit(docs)
    found = langid.predict(docs, model, keep=("text", "lang", "source", "n_chars"), runs=False).filter((F.col("lang_pred") != langid.NONE) & (F.col("score") >= LEAST_SCORE))
    return found.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines of templates that ten documents share, but in the first of them; documents of nothing else go.

    Long lines go from the second document on. Rows with one id are one document as to recurrence; rows with a null id
    keep their lines. Texts that lose nothing stay as they are, null and empty ones included; ``n_chars`` is counted
    anew where lines went. Other columns than a document's go no further.
    """
    found = lines.drop_recurring_lines(docs)
    kept = found.filter((F.col("n_dropped") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose five-word shingles are similar by 0.8 or more: that with the smallest id.

    Where an id is null or stands for several rows, each different (id, text) is a document: of rows that are the same in
    both one stays, ids order as numbers, null ids come last, and of one id the texts order by hash. Documents without
    words are like no other. An empty table gives an empty result; other columns than a document's go no further.
    """
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows, key = docs.select(*COLUMNS), F.col("doc_id")
    if not ids.filter("n > 1 or doc_id is null").isEmpty():
        rows = rows.dropDuplicates(["doc_id", "text"])
        number = F.lpad((F.col("doc_id").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 21, "0")
        key = F.concat(F.coalesce(number, F.lit("null")), F.lit(":"), F.hex(F.xxhash64("text")))
    rows = rows.withColumn("key", key)
    gone = cut(minhash.near_duplicates(rows, words=5, percent=80, id_col="key").filter("not kept").select("key").distinct())
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, "key", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the rows in the order in which the sources' blocks take turns by weight; no row is dropped.

    A null source is a source of its own; rows with null or repeated ids each have a place. An empty table gives an
    empty result. Other columns than a document's go no further.
    """
    placed = mixing.mix(docs, keep=("text", "lang", "n_chars"))
    order = ["slot", "block_row"]
    return placed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text: id, language, source, number of pieces, pieces, and the mixed order as ``mix_part``, ``mix_row``.

    A reader deals files by size, so the order of the rows that mix_sources wrote is kept as the number of a row's part
    file and its row there. Rows that come from no file have nulls. Null and empty texts have no pieces.
    """
    at = ["mix_part", "mix_row"]
    try:
        placed = docs.withColumns({"mix_part": F.regexp_extract("_metadata.file_name", r"^part-([0-9]+)", 1).try_cast("int"), "mix_row": F.col("_metadata.row_index")})
        placed.schema  # resolves the columns
    except AnalysisException:
        placed = docs.withColumns({"mix_part": F.lit(None).cast("int"), "mix_row": F.lit(None).cast("long")})
    return pieces.encode(placed).select("doc_id", "lang", "source", F.size("pieces").alias("n_pieces"), "pieces", *at)


STAGES = [
    ("language", language),
    ("recurring_lines", recurring_lines),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: The first and the second stage, a trained model and an order-dependent template tree, are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written to the shared folder and read again.

    A stage's result is deleted once the next one is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
