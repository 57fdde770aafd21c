"""Token ids as raw binary files with a minimal perfect hash index.

A shard holds documents of a range of doc_ids, in ascending order, in two files:
`.ids` has their ids and nothing else (little-endian, 16 bits where the vocabulary
fits, else 32); `.mph` maps a document's key to a slot of its own, and holds for
each slot a fingerprint of the key, the offset and the number of ids. A read looks
up one slot, compares the fingerprint and reads one span of the payload.

The hash is built in levels: keys that are alone on a bit of a level get its rank,
the others go on to the next level. Slots are 0 to n - 1 without gaps.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import on_workers, scratch, with_range, written
from palimpsest.llm.tokens import encoder

#: Stands for a null doc_id, which comes first.
NULL_ID = -(2**63)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit integers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + GOLDEN * np.uint64(seed + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def keys_of(doc_ids: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """One key for each document; occurrence counts rows that repeat a doc_id."""
    first = mixed(doc_ids.astype(np.int64).view(np.uint64), 0)
    return np.where(occurrence == 0, first, mixed(first ^ occurrence.astype(np.uint64), 1))


def occurrences(doc_ids: np.ndarray) -> np.ndarray:
    """0 for the first of equal neighbours, then 1, 2, ..."""
    at = np.arange(len(doc_ids))
    starts = np.r_[True, doc_ids[1:] != doc_ids[:-1]] if len(doc_ids) else np.zeros(0, bool)
    return at - np.maximum.accumulate(np.where(starts, at, 0)) if len(doc_ids) else at


class PerfectHash:
    """Distinct 64-bit keys -> 0 .. n - 1. words: the levels' bits; before: the
    number of bits set in earlier words; sizes: each level's bits."""

    def __init__(self, words: np.ndarray, before: np.ndarray, sizes: np.ndarray) -> None:
        self.words, self.before, self.sizes = words, before, sizes

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        levels, sizes, rest = [], [], keys
        while len(rest):
            if len(sizes) > 200:
                raise ValueError("keys repeat")
            size = max(64, -(-2 * len(rest) // 64) * 64)
            at = (mixed(rest, 10 + len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, np.uint8)
            bits[at[alone]] = 1
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(size)
            rest = rest[~alone]
        words = np.concatenate(levels) if levels else np.zeros(0, "<u8")
        before = np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int64))][:-1] if len(words) else np.zeros(0, np.int64)
        return cls(words, before, np.array(sizes, np.int64))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slots; -1 for a key that no level knows (others may get any slot)."""
        slots, first = np.full(len(keys), -1, np.int64), 0
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = (mixed(keys[open_], 10 + level) % np.uint64(size)).astype(np.int64) + first
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            slots[open_[hit]] = (self.before[at >> 6] + below)[hit]
            open_ = open_[~hit]
            first += size
        return slots


def index_bytes(doc_ids: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    keys = keys_of(doc_ids, occurrences(doc_ids))
    mph = PerfectHash.build(keys)
    slots = mph(keys)
    prints, offsets, lengths = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u8"), np.zeros(len(keys), "<u4")
    prints[slots] = mixed(keys, 2).astype("<u4")
    offsets[slots] = np.r_[0, np.cumsum(counts)][:-1]
    lengths[slots] = counts
    out = io.BytesIO()
    np.savez(out, words=mph.words, before=mph.before, sizes=mph.sizes, prints=prints, offsets=offsets, lengths=lengths, width=np.array([width]))
    return out.getvalue()


class Shard:
    """Keyed access to one shard's files."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(path)
        with system.open_input_stream(f"{place}.mph") as f:
            x = np.load(io.BytesIO(f.read()))
            self.prints, self.offsets, self.lengths = x["prints"], x["offsets"], x["lengths"]
            self.mph, self.width = PerfectHash(x["words"], x["before"], x["sizes"]), int(x["width"][0])
        self.payload = system.open_input_file(f"{place}.ids")

    def find(self, doc_ids: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
        """Slots of documents, -1 for those that the shard doesn't have."""
        keys = keys_of(doc_ids, occurrence)
        slots = self.mph(keys)
        ok = slots >= 0
        ok[ok] = self.prints[slots[ok]] == mixed(keys[ok], 2).astype("<u4")
        return np.where(ok, slots, -1)

    def ids(self, slot: int) -> np.ndarray:
        raw = self.payload.read_at(int(self.lengths[slot]) * self.width, int(self.offsets[slot]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")


def encoded(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """doc_key, range_id and ids in the payload's width, with the end id."""
    kind = f"<u{width}"
    end = np.array([end_id], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            ids = [np.frombuffer(x, "<u4").astype(kind).tobytes() + end for x in encode(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_key"), batch.column("range_id"), pa.array(ids, pa.binary())], ["doc_key", "range_id", "ids"])

    return docs.select("doc_key", "range_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_key long, range_id int, ids binary")


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """The runs of equal range_id in a sorted partition, cut at batches."""
    for batch in batches:
        ranges = batch.column("range_id").to_numpy()
        cuts = [0, *(np.flatnonzero(ranges[1:] != ranges[:-1]) + 1).tolist(), len(ranges)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield int(ranges[a]), batch.slice(a, b - a)


def write(keyed: DataFrame, ranges: int, folder: str, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """Write the shards; a row each: range_id, path, n_docs, n_ids. A repeated
    task writes files of other names, and its own rows name them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(folder)
        system.create_dir(place, recursive=True)
        now, out, name, ids, counts = None, None, "", [], []

        def closed() -> Iterator[pa.RecordBatch]:
            if out is None:
                return
            out.close()
            n = np.concatenate(counts)
            with system.open_output_stream(f"{place}/{name}.mph") as f:
                f.write(index_bytes(np.concatenate(ids), n, width))
            yield pa.RecordBatch.from_pylist([{"range_id": now, "path": f"{folder}/{name}", "n_docs": len(n), "n_ids": int(n.sum())}], schema)

        schema = pa.schema({"range_id": pa.int32(), "path": pa.string(), "n_docs": pa.int64(), "n_ids": pa.int64()})
        for range_id, part in by_range(batches):
            if range_id != now:
                yield from closed()
                now, name, ids, counts = range_id, f"shard-{range_id:05d}-{uuid.uuid4().hex[:8]}", [], []
                out = system.open_output_stream(f"{place}/{name}.ids")
            raw = part.column("ids").to_pylist()
            out.write(b"".join(raw))
            ids.append(part.column("doc_key").to_numpy())
            counts.append(np.array([len(x) // width for x in raw], np.int64))
        yield from closed()

    rows = encoded(keyed, tokenizer, end_id, width).repartition(ranges, "range_id").sortWithinPartitions("range_id", "doc_key", "ids")
    return rows.mapInArrow(run, "range_id int, path string, n_docs long, n_ids long")


def read(keys: DataFrame, ranges: int, shards: dict[int, tuple[str, int]]) -> DataFrame:
    """Look up keys (doc_key, range_id) in the files: doc_id, start, n_tokens,
    ids_crc32. shards: path and number of ids before each range, one entry a shard."""
    told = keys.sparkSession.sparkContext.broadcast(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, last, repeat = None, None, None, 0
        for range_id, part in by_range(batches):
            path, first = told.value[range_id]
            if range_id != now:
                now, shard, last = range_id, Shard(path), None
            docs = part.column("doc_key").to_numpy()
            nth = occurrences(docs)
            if last == docs[0]:  # the run of equal doc_ids goes on from the batch before
                nth = np.where(docs == last, nth + repeat + 1, nth)
            last, repeat = docs[-1], int(nth[-1])
            slots = shard.find(docs, nth)
            if (slots < 0).any():
                raise KeyError(f"{path} lacks a document")
            crc = [zlib.crc32(shard.ids(s).astype("<u4").tobytes()) for s in slots.tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, mask=docs == NULL_ID), pa.array(shard.offsets[slots].astype(np.int64) + first), pa.array(shard.lengths[slots].astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    rows = keys.select("doc_key", "range_id").repartition(ranges, "range_id").sortWithinPartitions("range_id", "doc_key")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, docs_per_shard: int = 8192) -> DataFrame:
    """Write all documents' ids to `folder` (by default in the shared one), read
    them back by key, and return doc_id, start, n_tokens, ids_crc32.

    A null text is empty and has the end id alone. Rows that repeat a doc_id are
    all kept, in the order of their ids; a null doc_id comes first. Other columns
    are ignored; an empty table gives no rows and no files.
    """
    spark = docs.sparkSession
    on_workers(spark)
    folder = folder or scratch(spark, "token-files")
    width = 2 if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_key"), "text")
    n = keyed.count()
    keyed, ranges = with_range(keyed, "doc_key", n // docs_per_shard)
    made = written(write(keyed, ranges, folder, tokenizer, end_id, width), "shards").orderBy("range_id").collect()  # one row a shard, 4096 at most
    before = [0, *accumulate(r.n_ids for r in made)]
    return read(keyed, ranges, {r.range_id: (r.path, b) for r, b in zip(made, before)})
