"""Shared helpers: scratch tables, worker set-up, ordered prefix sums."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from inspect import isgeneratorfunction
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROOT = str(Path(__file__).resolve().parents[2])


#: Bytes in a batch that goes to a Python worker, where the session has Spark's default of 64 MB: rows may be very long.
BATCH_BYTES, SPARK_DEFAULT = "8m", "67108864b"


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package when it isn't installed, and bound
    their batches by bytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == SPARK_DEFAULT:
        spark.conf.set(name, BATCH_BYTES)
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


#: What a Python worker keeps from task to task, by name.
KEPT: dict[str, object] = {}


def forget() -> None:
    """Drop the tables that this worker keeps for other operators."""
    KEPT.clear()


def give_back() -> None:
    """Let go of freed memory that the C library still holds for this process."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """A function for Arrow batches or groups, for operators that keep no tables: its
    worker drops those of others before it, and gives freed memory back after it."""
    if isgeneratorfunction(run):

        @wraps(run)
        def task(batches: Iterator):
            forget()
            try:
                yield from run(batches)
            finally:
                give_back()

    else:

        @wraps(run)
        def task(table):
            forget()
            try:
                return run(table)
            finally:
                give_back()

    return task


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a
    temporary one where that is unset and the session runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-palimpsest-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, a query's shuffle files go when the query ends: its result is a
    table, which nothing computes again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: How scratch files are created on a local disk: without checksum files, each of which would
#: start a process of its own for its permissions, as files do. Other file systems don't look at this.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

#: Bytes of input for a partition of a table, and partitions for each core of the session, at least.
PART_BYTES, CORE_PARTS = 16 << 20, 4


def merged(df: DataFrame, core_parts: int = CORE_PARTS) -> DataFrame:
    """df in no more partitions than the size of what it reads asks for, so that a small
    table isn't written as very many files: a file costs about 30 ms of its own. Tasks
    read neighbouring partitions one after another; nothing is shuffled."""
    spark, leaves = df.sparkSession, df._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.coalesce(min(1 << 30, max(core_parts * spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))))


def written(df: DataFrame, name: str, core_parts: int = CORE_PARTS) -> DataFrame:
    """Cut the lineage: write to a Parquet table in the shared folder and read it.
    core_parts: 1 where rows are few numbers, so that a task of each core is enough."""
    spark = df.sparkSession
    on_workers(spark)
    path = scratch(spark, name)
    with shuffles_dropped(spark):
        merged(df, core_parts).write.options(**PLAIN_FILES).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def heaps_returned(spark: SparkSession) -> None:
    """Let executors collect their garbage and give what is free of their heaps back to
    the system, which they don't do by themselves: between steps of a long session, whose
    garbage otherwise stays until a heap is at its limit. A small task for each core."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """docs with a long column that numbers its rows, written so that it stays."""
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_written(*frames: DataFrame) -> None:
    """Delete the files of written() tables whose readers have ended."""
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            drop_scratch(df.sparkSession, folder)


def text_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text with null as empty, and the columns named."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def longs(values: list[int]) -> Column:
    """A constant array of longs, given as text: quick to send and folded once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.expr("cast(array() as array<bigint>)")


def range_of(n: int, reached) -> Column:
    """How many of n sorted cuts a row has reached, by halving an interval.
    reached(i): whether the row is at or beyond the i-th cut."""
    if not n:
        return F.lit(0)
    middle = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(
        F.when(reached(middle(s)), F.struct((middle(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle(s).alias("hi")))
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), step, lambda s: s["lo"])


def with_range(df: DataFrame, key: str, ranges: int, name: str = "range_id") -> tuple[DataFrame, int]:
    """Add an int column that splits the rows into ordered ranges of the long
    column `key`, by quantiles of it. At most 4096 splitters reach the driver;
    equal keys share a range, so that callers order within a range."""
    ranges = max(1, min(ranges, 4096))
    cuts = [] if ranges == 1 else df.approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    cuts = sorted({int(x) for x in cuts if x is not None})
    array = longs(cuts)
    return df.withColumn(name, range_of(len(cuts), lambda i: F.get(array, i) <= F.col(key))), len(cuts) + 1


#: A key is frequent beyond this part of the rows, and beyond so many of them.
OFTEN_PART, OFTEN_ROWS = 1024, 2000


def joined_evenly(rows: DataFrame, unique: DataFrame, key: str) -> DataFrame:
    """rows (a written table) with the one row of `unique` that has their key. Rows of
    frequent keys stay where they are: there are at most 1024 such keys, whose rows of
    `unique` are broadcast; the others meet in a shuffle."""
    often = rows.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > max(OFTEN_ROWS, rows.count() // OFTEN_PART)).select(key)
    often = written(often, "frequent")
    if often.isEmpty():
        return rows.join(unique, key)
    hot = F.broadcast(often)
    return rows.join(hot, key, "left_semi").join(F.broadcast(unique.join(hot, key, "left_semi")), key).unionByName(rows.join(hot, key, "left_anti").join(unique, key))
