"""Quality by importance resampling (Xie et al., arXiv 2302.03169).

Two generative models of hashed word n-grams, one of target text (documents labelled
good) and one of all raw text, give each document a log importance weight: the mean
log ratio of its n-grams under the two, times a fixed number of n-grams, so that long
documents aren't favoured for their length. Adding Gumbel noise and keeping the k
highest samples without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import longs, on_workers, with_range, written
from palimpsest.llm.neardup import Words

#: Buckets of n-grams, and up to how many words a gram has.
BUCKETS, GRAMS = 1 << 16, 2
#: Labelled good documents that the target model is fitted on, at most.
TARGET_DOCS = 20_000
#: n-grams that a document's mean counts for.
LENGTH = 100
RAW, TARGET = 0, 1


def grams(text: str, words: Words) -> np.ndarray:
    """Buckets of the text's words and pairs of neighbours, in lower case."""
    tokens = text.lower().split()
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    out, now = [h], h
    with np.errstate(over="ignore"):
        for n in range(1, GRAMS):
            now = now[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[n:]
            out.append(now ^ (now >> np.uint64(31)))
        return ((np.concatenate(out) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """Tables of n-gram counts, two a task: model, counts, part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tables = Words(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for text, good in zip(batch.column("text").to_pylist(), batch.column("good").to_pylist()):
                n = np.bincount(grams(text, words), minlength=BUCKETS)
                tables[RAW] += n
                if good:
                    tables[TARGET] += n
        yield pa.RecordBatch.from_arrays([pa.array([RAW, TARGET], pa.int32()), pa.array([x.astype("<i8").tobytes() for x in tables], pa.binary())], ["model", "counts"])

    return docs.mapInArrow(run, "model int, counts binary").withColumn("part", F.monotonically_increasing_id())


def summed(tables: DataFrame, fan: int = 32) -> np.ndarray:
    """The two tables over all tasks, added in groups of about `fan`."""

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist()], 0)
        return pa.table({"model": table.column("model")[:1], "counts": pa.array([total.astype("<i8").tobytes()], pa.binary()), "part": table.column("part")[:1]})

    n = tables.count() // 2
    while n > 1:
        n = -(-n // fan)
        tables = written(tables.groupBy("model", F.pmod(F.xxhash64("part"), F.lit(n)).alias("_g")).applyInArrow(add, "model int, counts binary, part long"), "counts")
    out = np.zeros((2, BUCKETS), np.int64)
    for r in tables.collect():  # two tables of fixed size
        out[r.model] += np.frombuffer(r.counts, "<i8")
    return out


def fit(docs: DataFrame, labels: DataFrame, target_docs: int = TARGET_DOCS) -> np.ndarray:
    """Log ratio of each bucket, target over raw. The raw model counts all rows; the
    target model those labelled good, at most target_docs of them, chosen by a hash;
    rows whose crc32(doc_id as text) mod 4 is 2 are held out of it."""
    on_workers(docs.sparkSession)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("doc_id").isNotNull() & ~held)
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_docs).select("doc_id", F.lit(True).alias("good"))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id", "left")
    counts = summed(written(counted(x.select("text", F.coalesce("good", F.lit(False)).alias("good"))), "counts"))
    if not counts[TARGET].sum():
        return np.zeros(BUCKETS, np.float32)
    p = (counts + 1) / (counts.sum(1, keepdims=True) + BUCKETS)
    return (np.log(p[TARGET]) - np.log(p[RAW])).astype(np.float32)


def weights(docs: DataFrame, ratio: np.ndarray, length: int = LENGTH) -> DataFrame:
    """doc_id and log_weight of each row; a text without words has weight 0."""
    on_workers(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(ratio)  # one table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                g = grams(text, words)
                found.append(float(told.value[g].mean(dtype=np.float64)) * length if len(g) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "log_weight"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return x.mapInArrow(run, "doc_id long, log_weight double")


def resample(docs: DataFrame, labels: DataFrame, share: float = 0.5, seed: int = 17, rows_per_range: int = 100_000) -> DataFrame:
    """One row per row of docs: doc_id, log_weight, key (weight with Gumbel noise),
    selected. The rows with the ceil(share * n) highest keys are selected, by exact
    ranks: ranges of keys are counted, and ranked inside.

    The noise is a hash of doc_id and seed, so that a repeated task draws alike, and
    rows that repeat a doc_id draw the same. A null text is empty; a null doc_id is
    drawn like any other; other columns are ignored; an empty table gives no rows.
    Without labelled good documents all weights are 0 and the sample is uniform.
    """
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = weights(docs, fit(docs, labels)).withColumn("key", F.col("log_weight") - F.log(-F.log(u)))
    rows = written(keyed.withColumn("row_id", F.monotonically_increasing_id()).withColumn("_order", (-F.col("key") * 1e9).cast("long")), "weights")
    n = rows.count()
    k = int(np.ceil(share * n))
    ranged, ranges = with_range(rows, "_order", max(8, n // rows_per_range))
    counts = {r.range_id: r["count"] for r in ranged.groupBy("range_id").count().collect()}  # a few thousand rows at most
    before = longs([0, *accumulate(counts.get(i, 0) for i in range(ranges))])
    inside = Window.partitionBy("range_id").orderBy("_order", "row_id")
    rank = F.get(before, F.col("range_id")) + F.row_number().over(inside)
    return ranged.withColumn("rank", rank).select("doc_id", "log_weight", "key", (F.col("rank") <= k).alias("selected"))
