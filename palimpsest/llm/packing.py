"""Packing of documents into fixed-length sequences: shortest-pack-first over the
histogram of lengths (Krell et al., arXiv 2107.02027).

Documents are encoded once; every document is cut into pieces of `length` ids and
a rest. Only the histogram of lengths (at most `length` counts) reaches the driver,
which places lengths longest first and keeps counts of packing patterns, not of
packs. Patterns and pieces then meet by rank: the r-th piece of a length takes the
r-th place that the patterns have for it.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import on_workers, text_of, written
from palimpsest.llm.tokens import encoder

LENGTH = 1024


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens
    and, if asked for, ids (little-endian unsigned 32-bit integers)."""
    on_workers(docs.sparkSession)
    schema = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            out: list[tuple] = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                raw += end
                n = len(raw) // 4
                for at in range(0, n, length):
                    x = raw[4 * at : 4 * (at + length)]
                    out.append((doc, at, len(x) // 4, zlib.crc32(x), n, x)[: 5 + with_ids])
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + with_ids]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * len(names), types)], names)

    return text_of(docs).mapInArrow(cut, schema)


def patterns_of(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[list[int], int]]:
    """Patterns (lengths in their order) and how many sequences follow each.

    Longest length first; a piece goes to the pack with the most room. Where no
    pack has room, each new one takes as many pieces of that length as it can hold.
    """
    done: list[tuple[list[int], int]] = []
    open_: list[tuple[int, int, list[int], int]] = []  # used, order, lengths, count
    order = 0

    def put(lengths: list[int], used: int, count: int) -> None:
        nonlocal order
        if used == length:
            done.append((lengths, count))
        else:
            order += 1
            heapq.heappush(open_, (used, order, lengths, count))

    for size in sorted((k for k, n in histogram.items() if n), reverse=True):
        left, grown = histogram[size], []
        while left and open_ and open_[0][0] + size <= length:
            used, _, lengths, count = heapq.heappop(open_)
            took = min(left, count)
            left -= took
            grown.append((lengths + [size], used + size, took))
            if count > took:
                put(lengths, used, count - took)
        fits = length // size
        if left >= fits:
            grown.append(([size] * fits, size * fits, left // fits))
        if left % fits:
            grown.append(([size] * (left % fits), size * (left % fits), 1))
        for x in grown:
            put(*x)
    return done + [(lengths, count) for _, _, lengths, count in sorted(open_)]


def places_of(patterns: Iterable[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, sorted: the first rank of each run of places, and that
    run's first sequence and its offset there."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for lengths, count in patterns:
        offset = 0
        for x in lengths:
            rank = taken.get(x, 0)
            runs.setdefault(x, []).append((rank, first, offset))
            taken[x] = rank + count
            offset += x
        first += count
    return {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in runs.items()}


def ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """Add rank, from 0, among the pieces of a length. A length that most pieces
    share is numbered in `buckets` parts, whose counts are summed before them."""
    x = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = x.groupBy("length", "_part").count().select("length", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_part").orderBy("doc_id", "start", "ids_crc32")
    return x.withColumn("_rank", F.row_number().over(inside) - 1).join(counts, ["length", "_part"]).withColumn("rank", F.col("_before") + F.col("_rank")).drop("_part", "_before", "_rank")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = LENGTH, with_ids: bool = False, buckets: int | None = None) -> DataFrame:
    """Pack all documents; one row a piece: the columns of token_pieces() and
    sequence_id, offset.

    A null text is empty and has the end id alone; equal rows are packed one by
    one; a null doc_id stays null; other columns are ignored. An empty table gives
    no rows.
    """
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, tokenizer, end_id, length, with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `length` rows
    places = spark.sparkContext.broadcast(places_of(patterns_of(histogram, length)))
    buckets = buckets or max(64, min(4096, sum(histogram.values()) // 100_000))
    x = ranked(pieces, buckets)
    columns = [c for c in pieces.columns if c != "length"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                first, seq, off = places.value[int(size)]
                run = np.searchsorted(first, ranks[at], "right") - 1
                sequence[at], offset[at] = seq[run] + ranks[at] - first[run], off[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(lengths.astype(np.int64)), pa.array(sequence), pa.array(offset)], [*columns, "length", "sequence_id", "offset"])

    kinds = dict(x.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", length long, sequence_id long, offset long"
    return x.select(*columns, "length", F.col("rank").cast("long").alias("rank")).mapInArrow(place, schema)


def sequences(packed: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """The padded ids of each sequence, from pack(..., with_ids=True): sequence_id,
    ids (binary of 4 * length bytes) and n_ids without padding. A sequence has at
    most `length` pieces, so that its group is bounded."""
    pad = bytearray(np.array([pad_id] * length, "<u4").tobytes())
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))), lambda x: x["ids"]), "")
    x = packed.groupBy("sequence_id").agg(F.unhex(joined).alias("ids"), F.sum("length").alias("n_ids"))
    return x.select("sequence_id", F.rpad("ids", 4 * length, F.lit(pad)).alias("ids"), "n_ids")
