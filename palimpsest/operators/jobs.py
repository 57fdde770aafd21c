"""State of a job over files: what is pending, sessions, history, better results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(queued: DataFrame, done: DataFrame, failed: DataFrame, key: str = "file") -> DataFrame:
    """Queued files that neither ended nor failed."""
    return queued.join(done.select(key), key, "left_anti").join(failed.select(key), key, "left_anti")


def sessions(files: DataFrame) -> DataFrame:
    """files (session, file, state): counts and whether the session may be closed."""
    x = files.groupBy("session").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state") == "failed").alias("failed"))
    return x.withColumn("pending", F.col("n") - F.col("done") - F.col("failed")).withColumn("complete", F.col("n") == F.col("done") + F.col("failed"))


def latest(entries: DataFrame, by: str, tie: str, most: int = 100) -> DataFrame:
    """The most recent entries first: the driver keeps `most` rows of each task."""
    return entries.orderBy(F.desc(by), F.desc(tie)).limit(most)


def first_of(rows: DataFrame, identity: str, by: str) -> DataFrame:
    """Order-preserving distinct. The first row of an identity is found by an
    aggregate with map-side combine, so that common identities do no harm."""
    return rows.groupBy(identity).agg(F.min_by(F.struct(*rows.columns), by).alias("_r")).select("_r.*")


def better(first, second, text: str = "text", score: str = "score"):
    """Of two readings (structs), the one with more characters, then with the higher
    score; the first on ties."""
    a, b = F.length(first[text]), F.length(second[text])
    return F.when((b > a) | ((b == a) & (second[score] > first[score])), second).otherwise(first)


def changed(events: DataFrame, key: str, by: str, value: str, least: float) -> DataFrame:
    """Progress events worth telling: the first of a key, and each change that reaches
    an end (0 or 1) or is at least `least` away from the last one told. Events stream
    through a task in the order of their key, `by` (nulls last) and value; the value told
    last is all that is kept of a key. A null or
    NaN value (null in the result) is told only while nothing else was."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, last = object(), None
        for batch in batches:
            tell = []
            for k, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != of:
                    of, last = k, None
                far = last is None or (v is not None and v != last and (v in (0.0, 1.0) or not abs(v - last) < least))
                if far:
                    last = v
                tell.append(far)
            yield batch.filter(pa.array(tell, pa.bool_()))

    x = events.select(key, F.col(by).cast("bigint").alias(by), F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias(value))
    x = x.repartition(key).sortWithinPartitions(F.asc(key), F.asc_nulls_last(by), F.asc_nulls_last(value))
    return x.mapInArrow(told, x.schema)


def batch_stats(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """Totals of a batch of size pairs, in one aggregate."""
    change = F.when(F.sum(before) > 0, (F.sum(after) - F.sum(before)) * 100.0 / F.sum(before)).otherwise(0.0)
    return pairs.agg(
        F.count("*").alias("n"),
        F.sum(before).alias("before_bytes"),
        F.sum(after).alias("after_bytes"),
        F.round(change, 2).alias("change_percent"),
        F.count_if(F.col(after) > F.col(before)).alias("larger"),
        F.count_if(F.col(after) < F.col(before)).alias("smaller"),
        F.count_if(F.col(after) == F.col(before)).alias("same"),
    )
