"""Exact dedup by stateful streaming.

The rows' digests are a stream. Its keyed state is kept on disk by RocksDB, never
expires, and retains for each digest the stable identifier of the row that stays,
the place of that row's content, and how many rows had the digest. Rows whose
digest had a hit are then compared with the full bytes of the row that stays.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import CORE_PARTS, PLAIN_FILES, keyed, lean, on_workers, scratch, written

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",  # of an executor; the state is on disk
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no preallocated logs
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",  # one more file, and a process, for each of the state's files
    "fs.AbstractFileSystem.file.impl": "org.apache.hadoop.fs.local.RawLocalFs",  # as PLAIN_FILES, for the state's files
    "spark.sql.streaming.stateStore.maintenanceInterval": "15s",  # executors close the stores of an ended query then
}
#: Rows for each partition of the state, about, so that an executor doesn't hold many small stores.
STATE_ROWS = 20_000
#: Rows of a group that one copy of the kept text is compared with.
SALT_ROWS = 4096


def normal(text: Column) -> Column:
    """Lower case for A-Z only; null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def locator(docs: DataFrame) -> Column:
    """The file and the row in it, of a table that is read from files of rows."""
    where = docs.metadataColumn("_metadata")
    return F.concat_ws("#", where.getField("file_path"), where.getField("row_index"))


def located(docs: DataFrame) -> bool:
    try:
        docs.select(locator(docs)).schema
    except AnalysisException:
        return False
    return True


def digests(docs: DataFrame, digest_bytes: int = 32, key: str | None = None) -> DataFrame:
    """doc_id, row_id, digest of the normalised text, text_sha256, n_bytes, place.

    place is the locator of the content: the file and the row in it. Where docs isn't
    read from files of rows, `key` names a column that locates a row; it is then the
    row_id. digest_bytes is below 32 only to force collisions in tests.
    """
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            full = [hashlib.sha256((x or b"").lower()).digest() for x in raw]  # bytes.lower() changes A-Z only
            columns = [batch.column("doc_id"), pa.array([x[:digest_bytes] for x in full], pa.binary()), pa.array([x.hex() for x in full]), pa.array([len(x or b"") for x in raw], pa.int64()), batch.column("place"), batch.column("row_id")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "text_sha256", "n_bytes", "place", "row_id"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.col(key).cast("string") if key else locator(docs)).alias("place"), (F.col(key) if key else F.lit(None)).cast("long").alias("row_id"))
    x = x.mapInArrow(lean(run), "doc_id long, digest binary, text_sha256 string, n_bytes long, place string, row_id long")
    return x if key else x.withColumn("row_id", F.monotonically_increasing_id())


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def retain(stream: DataFrame, checkpoint: str, out: str, files: int = 1 << 20) -> None:
    """Run what the stream has now through the keyed state at `checkpoint`. A later
    call with the same checkpoint goes on from there. Changed groups go to `out`, in at
    most so many files for each batch."""
    row = F.struct("doc_id", "row_id", "place", "n_bytes")
    groups = stream.groupBy("digest").agg(F.max(row).alias("keeper"), F.count("*").alias("group_size"))

    def save(batch: DataFrame, number: int) -> None:
        batch.coalesce(files).write.options(**PLAIN_FILES).mode("overwrite").parquet(f"{out}/batch={number}")

    query = groups.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()


def groups_of(rows: DataFrame, batches: int = 4) -> DataFrame:
    """digest, keep_row, keep_id, group_size of written rows, read as a stream."""
    spark = rows.sparkSession
    files = rows.inputFiles()
    path, state, out = files[0].rpartition("/")[0], scratch(spark, "state"), scratch(spark, "groups")
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(8, rows.count() // STATE_ROWS))
    written_files = max(CORE_PARTS * spark.sparkContext.defaultParallelism, len(files))
    with settings(spark, STATE | {"spark.sql.shuffle.partitions": str(partitions)}):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-len(files) // batches))).parquet(path)
        retain(stream, state, out, written_files)
    # a group that changed again stands in several batches; its keeper and size only grow
    seen = spark.read.parquet(out).groupBy("digest").agg(F.max("keeper").alias("keeper"), F.max("group_size").alias("group_size"))
    return seen.select("digest", F.col("keeper.row_id").alias("keep_row"), F.col("keeper.doc_id").alias("keep_id"), "group_size")


def texts_of(docs: DataFrame, members: DataFrame, key: str | None = None) -> DataFrame:
    """The members (place and more) with the normalised texts at their places. A place
    is one row, so that rows which repeat a doc_id meet their own text only."""
    text = docs.select((F.col(key).cast("string") if key else locator(docs)).alias("place"), normal(F.col("text")).alias("text"))
    return text.join(members.hint("shuffle_hash"), "place")


def differing(docs: DataFrame, members: DataFrame, key: str | None = None) -> DataFrame:
    """row_id of the members whose normalised bytes are not those of the row that
    stays. members: rows of groups with hits. Copies of the kept text are dealt to
    parts of a large group."""
    texts = texts_of(docs, members, key)
    parts = F.ceil(F.col("group_size") / SALT_ROWS).cast("int")
    kept = texts.filter("row_id = keep_row").select("digest", F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    others = texts.filter("row_id <> keep_row").withColumn("part", F.pmod(F.xxhash64("row_id"), parts).cast("int"))
    return others.join(kept, ["digest", "part"]).filter("text <> kept_text").select("row_id")


def exact_dedup(docs: DataFrame, digest_bytes: int = 32, batches: int = 4, key: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; a null text is
    empty. Of equal texts the row with the largest doc_id stays; of repeated rows
    with one doc_id, one. A null doc_id is smaller than any other. Other columns
    are ignored; an empty table gives no rows. `key` names a long column that tells
    rows apart and comes along.
    """
    along = [F.col("row_id").alias(key)] if key else []
    if not key and not located(docs):
        docs, key = keyed(docs.select("doc_id", "text"), "_row"), "_row"
    rows = written(digests(docs, digest_bytes, key), "digests")
    if rows.isEmpty():
        return rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", *along)
    joined = written(rows.join(groups_of(rows, batches), "digest"), "members")
    members = joined.filter("group_size > 1").select("digest", "place", "row_id", "keep_row", "group_size")
    unequal = written(differing(docs, members, key), "unequal")
    if not unequal.isEmpty():  # digests that collide: group these rows by the whole texts
        hit = joined.join(unequal, "row_id", "left_semi").select("digest").distinct()
        again = Window.partitionBy("digest", "text")
        mended = texts_of(docs, joined.join(hit, "digest"), key).withColumn("_keep", F.max(F.struct("doc_id", "row_id")).over(again))
        mended = mended.withColumns({"keep_row": F.col("_keep.row_id"), "keep_id": F.col("_keep.doc_id"), "group_size": F.count("*").over(again)}).select(*joined.columns)
        joined = joined.join(hit, "digest", "left_anti").unionByName(mended)
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256", *along)
