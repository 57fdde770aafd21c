"""Streams: incremental ingestion with a checkpoint, windowed counts, keep-latest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append what is new since the checkpoint and end; a rerun adds nothing twice."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def windowed(stream: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each key in tumbling windows; rows later than `late` behind
    the newest go, and closed windows leave the state."""
    x = stream.withWatermark(ts, late).groupBy(F.window(ts, width), key)
    return x.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def keep_latest(stream: DataFrame, key: str, by: str) -> DataFrame:
    """The newest row of each key: later ones supersede; a keyed state of one row."""
    return stream.groupBy(key).agg(F.max_by(F.struct(*stream.columns), by).alias("_r")).select("_r.*")
