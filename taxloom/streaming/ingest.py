"""Streams: incremental ingest of documents, duplicates within a run, daily counters."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxloom.sources import reports, xml

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


STORED = "clave string, path string, value string"
MANIFEST = "lote long, carpeta string, tablas map<string,long>, documentos long, errores long, momento timestamp"


def _first_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a partition, which has all rows of its keys in one batch of the stream, the first of each key by path."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    names = pa.Table.from_batches([b.select(["_key", "path"]) for b in rows])
    order = pc.sort_indices(names, sort_keys=[("_key", "ascending"), ("path", "ascending")])  # nulls come last
    keys = names["_key"].take(order).combine_chunks()
    new = np.ones(len(keys), bool)
    new[1:] = pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), False).to_numpy(zero_copy_only=False)
    if keys.null_count:
        new[len(keys) - keys.null_count] = True
    kept = np.zeros(len(keys), bool)
    kept[order.to_numpy()[new]] = True
    at = 0
    for b in rows:
        yield b.filter(pa.array(kept[at : at + b.num_rows]))
        at += b.num_rows


def stored_once(stream: DataFrame) -> DataFrame:
    """Of a stream of documents (clave, path, value) each key once: the first that arrives, whatever comes later.

    Among rows of one batch the smallest path is first: a batch's rows are dealt by key, and each partition's copies leave before
    Spark's own deduplication, which remembers the keys and asks no Python for them. Keys that were stored are its state, kept by the
    checkpoint, so a restarted run skips them too; a document without a key is told apart by its path. The state has a row for each
    key and needs the RocksDB state store, which keeps it on disk. A task holds a batch's share of one shuffle partition.
    """
    if "RocksDB" not in stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass"):
        raise RuntimeError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    keyed = stream.select(F.coalesce("clave", "path").alias("_key"), "clave", "path", "value")
    return keyed.repartition("_key").mapInArrow(_first_paths, f"_key string, {STORED}").dropDuplicates(["_key"]).drop("_key")


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, now: bool = True, files_per_batch: int = 10_000, once: bool = False):
    """Parse the XML files of a folder as they arrive, ``files_per_batch`` at a time; see :func:`ingest_stream`."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").format("text").option("wholetext", True).load(folder)
    return ingest_stream(files.select(xml.file_path().alias("path"), "value"), out, checkpoint, now, once)


def ingest_stream(source: DataFrame, out: str, checkpoint: str, now: bool = True, once: bool = False):
    """Parse documents (path, value) as they arrive and add every report table under out; ``once``: each access key once.

    A batch writes its tables into a folder of its own and then commits them all together, by one row in the manifest.
    Readers (:func:`committed`) go by the manifest, so the tables of a batch that dies on the way are never seen, whichever of
    them it had written. The stream's checkpoint makes a restarted run go on where it stopped; a batch that is tried again writes a
    new folder and takes the place of its earlier try in the manifest.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark, folder = batch.sparkSession, f"{out}/datos/lote={number}-{uuid.uuid4().hex}"
        counts = reports.write_parsed(xml.parse(batch), folder)
        row = [(number, folder, counts, counts["cabecera"] + counts["errores"], counts["errores"], datetime.datetime.now(datetime.UTC))]
        commit(spark.createDataFrame(row, MANIFEST), f"{out}/manifiesto/lote={number}")

    documents = stored_once(source.select(xml.quick_key(F.col("value")).alias("clave"), "path", "value")) if once else source
    writer = documents.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if now else writer).start()


def commit(row: DataFrame, path: str) -> None:
    """Write a row as one file, which is there as a whole once Spark's committer has renamed it."""
    row.coalesce(1).write.mode("overwrite").json(path)


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """A row for each batch that was committed: its folder, the rows of each table, when."""
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{out}/manifiesto")


def committed(spark: SparkSession, out: str, table: str) -> DataFrame:
    """A report table of all committed batches, read by the folders that the manifest names."""
    folders = manifest(spark, out).filter(F.coalesce(F.try_element_at("tablas", F.lit(table)), F.lit(0)) > 0).select("carpeta").orderBy("lote").collect()  # a row for each batch
    if not folders:
        raise ValueError(f"no committed batch has {table}")
    return spark.read.parquet(*[f"{f.carpeta}/{table}" for f in folders])


def first_seen(stream: DataFrame, key: str = "clave", time: str = "ts") -> DataFrame:
    """Each key and its earliest time, in whatever order the rows arrive."""
    return stream.groupBy(key).agg(F.min(time).alias(time))


def daily_counters(stream: DataFrame, by: list[str], sums: list[str], time: str = "ts", delay: str = "1 day") -> DataFrame:
    """Counts and sums by day and the given columns."""
    day = F.window(time, "1 day")
    out = stream.withWatermark(time, delay).groupBy(day, *by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
    return out.select(F.col("window.start").alias("dia"), *by, "n", *sums)


def drained(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """Run a stream over all that is there and read what it says in the end; path has its checkpoint and its output."""
    spark = stream.sparkSession

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/{'all' if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{path}/out")
