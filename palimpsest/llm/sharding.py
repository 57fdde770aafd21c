"""Sharding by sampled splitters, with shards of near equal size in bytes.

Records are ordered by (hash of the text, doc_id, row), so that equal texts stand side
by side. Size-weighted samples of these keys give quantile boundaries of ranges;
ranges that turn out too full, such as one with a text that very many rows share,
are sampled again and subdivided. Exact sums over ranges and a window within each
range then give every record its place in the whole order, which is cut into
shards of equal bytes.
"""

from __future__ import annotations

from itertools import accumulate, count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import longs, range_of, written

SHARDS = 24
#: Samples a range, and the most ranges: what reaches the driver is at most about their product.
SAMPLES, MOST_RANGES = 64, 4096
LEAST_ID = -(2**63)


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key and id (doc_id for comparison) of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("id"),
        F.monotonically_increasing_id().alias("row"),
    )


def sampled(rows: DataFrame, per_byte: float, salt: int) -> list[tuple[int, int, int, int]]:
    """(key, id, row, times) of size-weighted samples: a row is drawn size * per_byte
    times, rounded up or down by a hash of it, so that a repeated task draws alike."""
    u = (F.xxhash64("key", "id", "row", F.lit(salt)).bitwiseAND((1 << 52) - 1)) / float(1 << 52)
    times = F.floor(F.col("size") * per_byte + u).alias("times")
    return sorted(map(tuple, rows.select("key", "id", "row", times).filter("times > 0").collect()))


def boundaries(samples: list[tuple[int, int, int, int]], ranges: int) -> list[tuple[int, int, int]]:
    """Keys at the quantiles of the samples."""
    total, seen, out = sum(t for *_, t in samples), 0, []
    for *place, times in samples:
        if seen * ranges // max(total, 1) != (seen + times) * ranges // max(total, 1) and seen:
            out.append(tuple(place))
        seen += times
    return sorted(set(out))


def in_ranges(rows: DataFrame, cuts: list[tuple[int, int, int]]) -> DataFrame:
    keys, ids, nth = (longs([c[i] for c in cuts]) for i in range(3))
    reached = lambda i: F.struct(F.get(keys, i).alias("a"), F.get(ids, i).alias("b"), F.get(nth, i).alias("c")) <= F.struct(F.col("key").alias("a"), F.col("id").alias("b"), F.col("row").alias("c"))
    return rows.withColumn("range_id", range_of(len(cuts), reached))


def shard(docs: DataFrame, shards: int = SHARDS, rows_per_range: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    size is the text's bytes in UTF-8 plus 8; a null text has none. The law is
    `bytes`: every shard ends within one record of an equal share. Equal texts stand
    side by side, so that at most shards - 1 groups are cut. A null doc_id comes
    before all others; equal rows take neighbouring slots. Other columns are
    ignored; an empty table gives no rows; with fewer rows than shards some stay
    empty.
    """
    rows = written(records(docs), "records")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(1, min(MOST_RANGES, n, max(shards, n // rows_per_range)))
    cuts: list[tuple[int, int, int]] = []
    if ranges > 1:
        cuts = boundaries(sampled(rows, ranges * SAMPLES / total, 0), ranges)
    share = total / ranges
    for again in count(1):  # until no range is overfull: rows differ in their keys, so that each can be cut
        counted = in_ranges(rows, cuts).groupBy("range_id").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        full = {r.range_id: (r.size, r.n) for r in counted.collect()}  # at most a few thousand rows
        over = [k for k, (size, m) in full.items() if size > 1.5 * share and m > SAMPLES]
        if not over:
            break
        drawn = sampled(in_ranges(rows, cuts).filter(F.col("range_id").isin(over)), SAMPLES / share, again)
        before = len(cuts)
        more = {c for c in boundaries(drawn, max(2, round(sum(full[k][0] for k in over) / share)))}
        cuts = sorted({*cuts, *more})
        if len(cuts) == before:  # one row fills what is left
            break
    ids = range(len(cuts) + 1)
    size_before = longs([0, *accumulate(full.get(k, (0, 0))[0] for k in ids)])
    rows_before = longs([0, *accumulate(full.get(k, (0, 0))[1] for k in ids)])
    order = Window.partitionBy("range_id").orderBy("key", "id", "row")
    inside = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = F.get(size_before, F.col("range_id")) * 2 + inside * 2 + F.col("size")
    placed = written(
        in_ranges(rows, cuts).select(
            "doc_id",
            "size",
            "text_crc32",
            F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / (2 * max(total, 1)))).cast("int").alias("shard"),
            (F.get(rows_before, F.col("range_id")) + F.row_number().over(order) - 1).alias("rank"),
        ),
        "placed",
    )
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
