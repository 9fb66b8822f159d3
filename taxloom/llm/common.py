"""Helpers shared by the operators: lineage cuts in the shared folder, and exact global prefix sums."""

from __future__ import annotations

import atexit
import ctypes
import ctypes.util
import gc
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables of so many rows or fewer, once counted, are broadcast.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, for what jobs leave for later jobs.

    Where the session names none, a local session gets a folder of its own, which goes when Python ends; on a cluster
    that is an error, as a machine's own folder wouldn't be seen by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(named or own)
    return named or context.getCheckpointDir()


def own_dir(spark: SparkSession) -> str:
    """The application's folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/taxloom-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow frame by a reliable checkpoint; its columns are new ones, free for self-joins."""
    shared_dir(df.sparkSession)
    return df.checkpoint().select([F.col(c).alias(c) for c in df.columns])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a wide frame as Parquet into the shared folder and read it again.

    It goes to the application's own folder there, ``taxloom-`` and its id, which can be removed once the application
    has ended.
    """
    path = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`stored` wrote, once all that was made of it is stored or checkpointed."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files, and where it is set so the checkpoints, of frames that are gone.

    It drops them once the driver's collectors have found the frames, which a driver with little to do may put off for long.
    """
    gc.collect()
    spark._jvm.System.gc()


def new_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of df has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prefix_sums(df: DataFrame, order: list[str], size: str) -> DataFrame:
    """Add ``before`` (sum of size of all earlier rows), ``index`` (number of earlier rows) in the total order.

    One range partitioning puts the rows in order; it is pinned by a checkpoint, because range bounds come from a
    sample and must be the same for the totals and for the rows. Each partition's total is a row, those few rows are
    summed up, and every row adds its partition's offset to the sum within its partition. No task ever sees more than
    one partition; a key with many rows is cut wherever the later order columns allow. Adds ``total`` too.
    """
    n = shuffle_partitions(df.sparkSession)
    placed = cut(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy("part").agg(F.sum(size).alias("part_size"), F.count(F.lit(1)).alias("part_rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(  # as many rows as there are shuffle partitions
        "part",
        F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("size_offset"),
        F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("row_offset"),
        F.sum("part_size").over(everything).alias("total"),
    )
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumn("upto", F.sum(size).over(within)).withColumn("rank", F.count(F.lit(1)).over(within))
    return summed.join(F.broadcast(offsets), "part").select(
        *df.columns,
        (F.col("size_offset") + F.col("upto") - F.col(size)).alias("before"),
        (F.col("row_offset") + F.col("rank") - 1).alias("index"),
        "total",
    )


def give_back() -> None:
    """Return what a task has freed to the system: Spark keeps Python workers for later tasks, and with them their memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(ctypes.util.find_library("c") or None), "malloc_trim", None)
    if trim:
        trim(0)
