"""Removal of repeated passages by a logarithmic family of suffix arrays.

Documents are ordered by doc_id and dealt to partitions of a bucketed table, so that
what is found comes back to the texts without moving them again. A partition's
documents come in batches. Suffixes are sampled where a k-gram has the least hash
among those of a window of `length` bytes, so that equal windows sample equal places
wherever they stand. The windows that share a sampled place make one passage: the
suffix at the place, then what precedes it there.

1. Fingerprints of the places' k-grams tell which occur again at all; only those go on.
   This only chooses candidates: a collision costs work and removes nothing.
2. Each batch's passages, sorted by their bytes, are its (sparse) suffix array. Key
   ranges of fingerprints deal them to tasks. There the batches come in order: a
   batch's array is scanned against each level of the family, passages that a level
   has repeat, the others are a new level, and levels of like size merge. Where one
   k-gram has several passages, the windows of each go, again sorted by their bytes,
   through a second family, which finds those that an earlier passage holds. Bytes
   are compared everywhere, so the result is exact.
3. The repeated windows come back to the texts, whose bytes they cover are cut.

A k-gram with very many different passages, such as a line that a large part of the
documents hold, is split: its windows are dealt one by one by their own fingerprints.
With `index`, the first family's levels are kept in that folder for later batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import PLAIN_FILES, lean, longs, on_workers, scratch, shuffles_dropped, written

LENGTH, KGRAM = 100, 36
#: Bytes of text that are looked at together, and of a batch.
BLOCK_BYTES, BATCH_BYTES = 1 << 20, 8 << 20
#: Bytes of text for each partition of texts and of the key space. Beyond MOST_PARTS, partitions of texts grow: a
#: task streams its batches, so that its memory stays.
TEXT_BYTES, PARTITION_BYTES, MOST_PARTS = 32 << 20, 8 << 20, 100_000
#: More different passages than this within batches, summed over them, and a k-gram's windows are dealt one by one.
HOT = 1000
NULL_ID = -(2**63)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Characters of a text that order rows of one doc_id.
PREFIX = 64
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2**64 to the powers 0 to n; kept in the worker."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, BLOCK_BYTES + (1 << 18))
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, x, np.uint64)]) for x in (BASE, INVERSE)]
    return _powers[0], _powers[1]


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (x ^ np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(29))


class Prints:
    """Fingerprints of any span of a block's bytes."""

    def __init__(self, raw: np.ndarray) -> None:
        up, self.down = powers(len(raw))
        table = mixed(np.arange(1, 257, dtype=np.uint64), 0x51ED)
        with np.errstate(over="ignore"):
            self.sums = np.r_[np.uint64(0), np.cumsum(table[raw] * up[: len(raw)])]

    def __call__(self, start: np.ndarray, size, seed: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[start + size] - self.sums[start]) * self.down[start], seed)


def samples(prints: Prints, sizes: np.ndarray, length: int = LENGTH, k: int = KGRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows that share their sampled place: key of the place's k-gram, the
    place, first window, number of windows. Windows never cross texts."""
    ends = np.cumsum(sizes)
    windows = np.maximum(sizes - length + 1, 0)
    total = int(windows.sum())
    if not total:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    at = np.repeat(ends - sizes - (np.cumsum(windows) - windows), windows) + np.arange(total)
    n = int(ends[-1])
    kgrams = n - k + 1
    grams = prints(np.arange(kgrams), k, 0xA11C)
    bits = np.uint64((1 << n.bit_length()) - 1)
    low = (grams & ~bits) | np.arange(kgrams, dtype=np.uint64)
    span, width = 1, length - k + 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    place = (low[at] & bits).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
    return grams[place[first]], place[first], at[first], np.diff(np.r_[first, total])


def dealt(keys: np.ndarray, partitions: int) -> np.ndarray:
    """The partition of each key. Sampled keys are the least of many, so they are mixed first."""
    return (((mixed(keys, 0xDEA1) >> np.uint64(40)) * np.uint64(partitions)) >> np.uint64(24)).astype(np.int64)


def groups(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each of x is in the sorted array `known`."""
    if not len(known):
        return np.zeros(len(x), bool)
    i = np.searchsorted(known, x)
    i[i == len(known)] = 0
    return known[i] == x


class Family:
    """Levels of suffix arrays in the order of their bytes."""

    def __init__(self, levels: list[np.ndarray] | None = None) -> None:
        self.levels = list(levels or [])

    def known(self, batch: np.ndarray) -> np.ndarray:
        """Whether a level holds each suffix of the sorted batch."""
        found = np.zeros(len(batch), bool)
        for level in self.levels:
            found |= among(batch, level)
        return found

    def add(self, batch: np.ndarray) -> None:
        """A new level; levels merge while the one before is at most twice as long."""
        if len(batch):
            self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            self._merge_last()

    def _merge_last(self) -> None:
        b, a = self.levels.pop(), self.levels.pop()
        self.levels.append(np.sort(np.concatenate([a, b]), kind="stable"))  # two sorted runs: one merge

    def whole(self) -> np.ndarray:
        while len(self.levels) > 1:
            self._merge_last()
        return self.levels[0]


class Layout:
    """A passage in bytes of fixed number: the suffix at the place, what precedes it
    (at the right end of its field), the bytes before it, the number of windows."""

    def __init__(self, length: int = LENGTH, k: int = KGRAM) -> None:
        self.length, self.k, self.before = length, k, length - k
        self.width = length + self.before + 5
        self.kind = f"S{self.width}"  # ends with a byte that is not 0, so that numpy keeps all

    def cut(self, raw: np.ndarray, place: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        left, right = place - first, first + count - 1 + self.length - place
        out = np.zeros((len(place), self.width), np.uint8)
        ahead, behind = np.arange(self.length), np.arange(-self.before, 0)
        x = raw[np.minimum(place[:, None] + ahead, len(raw) - 1)]
        out[:, : self.length] = np.where(ahead < right[:, None], x, 0)
        x = raw[np.maximum(place[:, None] + behind, 0)]
        out[:, self.length : self.length + self.before] = np.where(behind >= -left[:, None], x, 0)
        out[:, -5:-3] = left.astype(">u2")[:, None].view(np.uint8)
        out[:, -3:-1] = count.astype(">u2")[:, None].view(np.uint8)
        out[:, -1] = 1
        return out.view(self.kind).ravel()

    def bytes_of(self, passages: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(passages).view(np.uint8).reshape(-1, self.width)

    def counts(self, passages: np.ndarray) -> np.ndarray:
        return self.bytes_of(passages)[:, -3:-1].copy().view(">u2").ravel().astype(np.int64)

    def several(self, whole: np.ndarray) -> np.ndarray:
        """Whether the k-gram of each of the sorted passages has another one too."""
        gram = self.bytes_of(whole)[:, : self.k]
        same = (gram[1:] == gram[:-1]).all(1)
        return np.r_[False, same] | np.r_[same, False]

    def windows(self, passages: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of `length` bytes in the passages, and where they start in
        the batch; at: where each passage's first window starts."""
        x, count = self.bytes_of(passages), self.counts(passages)
        left = x[:, -5:-3].copy().view(">u2").ravel().astype(np.int64)
        text = np.concatenate([x[:, self.length : self.length + self.before], x[:, : self.length]], 1)
        row = np.repeat(np.arange(len(x)), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        found = np.lib.stride_tricks.sliding_window_view(text, self.length, 1)[row, self.before - left[row] + nth]
        return found.view(f"S{self.length}").ravel(), at[row] + nth


def parts_of(docs: DataFrame, key: str | None, total: int) -> DataFrame:
    """A table (slot, seq, doc_key, row_key, raw), bucketed so that a slot is a bucket
    of its own; seq ascends in doc_id, over all slots."""
    spark = docs.sparkSession
    # with fewer buckets than shuffle partitions, joins would deal the texts anew
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, total // TEXT_BYTES))
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.col(key).cast("long") if key else F.monotonically_increasing_id()
    x = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_key"), F.substring(text, 1, PREFIX).alias("prefix"), row.alias("row_key"), text.cast("binary").alias("raw"))
    order = ["doc_key", "prefix", "row_key"]
    x = x.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    x = x.withColumn("slot", F.get(longs(own_buckets(spark, n)), F.spark_partition_id())).select("slot", "seq", "doc_key", "row_key", "raw")
    name = f"texts_{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        x.write.bucketBy(n, "slot").sortBy("seq").options(**PLAIN_FILES).option("compression", "zstd").option("path", scratch(spark, "texts")).saveAsTable(name)
    return spark.table(name)


def own_buckets(spark: SparkSession, n: int) -> list[int]:
    """For each of n buckets a number that Spark's hash puts there."""
    found, tried = {}, 0
    while len(found) < n:
        more = spark.range(tried, tried + 16 * n + 64).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("bucket")).agg(F.min("id").alias("id"))
        found = {r.bucket: r.id for r in more.collect()} | found  # n numbers
        tried += 16 * n + 64
    return [found[i] for i in range(n)]


class Batch:
    """Neighbouring documents of a slot; places count bytes from the first one."""

    def __init__(self, slot: int, seq: int, told) -> None:
        self.slot, self.seq, self.told, self.size = slot, seq, told, 0
        self.docs: list[tuple[int, int, bytes]] = []

    def blocks(self, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Bytes of some documents, their sizes, and where each starts in the batch. A
        very long document comes in pieces that share length - 1 bytes, so that
        each window is in one of them."""
        held, sizes, base, size, at = [], [], [], 0, 0
        for _, _, raw in self.docs:
            for a in range(0, max(len(raw) - length + 1, 1), BLOCK_BYTES):
                piece = raw if len(raw) <= BLOCK_BYTES else raw[a : a + BLOCK_BYTES + length - 1]
                if held and size + len(piece) > BLOCK_BYTES:
                    yield np.frombuffer(b"".join(held), np.uint8), np.array(sizes), np.array(base)
                    held, sizes, base, size = [], [], [], 0
                held.append(piece)
                sizes.append(len(piece))
                base.append(at + a)
                size += len(piece)
                if len(raw) <= BLOCK_BYTES:
                    break
            at += len(raw)
        if size:
            yield np.frombuffer(b"".join(held), np.uint8), np.array(sizes), np.array(base)


def batches_of(rows: Iterator[pa.RecordBatch], marked: bool) -> Iterator[Batch]:
    """Batches of about BATCH_BYTES, or as an earlier pass has marked them: what was
    told about a batch stands at its first document."""
    now = None
    for batch in rows:
        told = batch.column("told").to_pylist() if marked else [None] * batch.num_rows
        for slot, seq, doc, row, raw, mark in zip(*(batch.column(c).to_pylist() for c in ("slot", "seq", "doc_key", "row_key", "raw")), told):
            if now is None or slot != now.slot or (mark is not None if marked else now.size >= BATCH_BYTES):
                if now:
                    yield now
                now = Batch(slot, seq, mark)
            now.docs.append((doc, row, raw))
            now.size += len(raw)
    if now:
        yield now


def in_batch(x: np.ndarray, sizes: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Places in a block as places in its batch."""
    starts = np.cumsum(sizes) - sizes
    doc = np.searchsorted(starts, x, "right") - 1
    return x - starts[doc] + base[doc]


def rows_of(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))


def per_part(part: np.ndarray, partitions: int, *columns: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    """The columns' rows for each partition, in their order."""
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(partitions + 1))
    return {p: tuple(c[order[a:b]] for c in columns) for p, (a, b) in enumerate(zip(cut, cut[1:])) if b > a}


def fingerprints(texts: DataFrame, partitions: int, length: int) -> DataFrame:
    """slot, seq, part, keys, more: of each batch's places, for each partition the
    fingerprints of their k-grams; more: 128 if the batch has the k-gram again, plus
    how many other passages it has there (up to 127). A batch without places has a row too."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"slot": pa.int64(), "seq": pa.int64(), "part": pa.int32(), "keys": pa.binary(), "more": pa.binary()}
        for batch in batches_of(rows, False):
            found = [(np.zeros(0, np.uint64),) * 2]
            for raw, sizes, _ in batch.blocks(length):
                prints = Prints(raw)
                keys, _, first, count = samples(prints, sizes, length)
                found.append((keys, prints(first, count + length - 1, 0xBEEF)))
            keys, around = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((around, keys))
            keys, around = keys[order], around[order]
            at = groups(keys)
            size, kinds_of = np.diff(np.r_[at, len(keys)]), np.zeros(len(keys), np.int64)
            kinds_of[groups(keys, around)] = 1
            other = np.add.reduceat(kinds_of, at) - 1 if len(at) else size
            more = (np.minimum(other, 127) + 128 * (size > 1)).astype(np.uint8)
            keys = keys[at]
            out = [(batch.slot, batch.seq, p, k.tobytes(), m.tobytes()) for p, (k, m) in per_part(dealt(keys, partitions), partitions, keys, more).items()]
            yield rows_of(kinds, out or [(batch.slot, batch.seq, 0, b"", b"")])

    return texts.mapInArrow(lean(run), "slot long, seq long, part int, keys binary, more binary")


def occurring_again(prints: DataFrame, partitions: int, hot: int) -> DataFrame:
    """slot, seq, again, hot: of each batch's fingerprints, those that occur more than
    once; hot ones have very many different passages."""

    def run(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()]
        more = np.frombuffer(b"".join(table.column("more").to_pylist()), np.uint8)
        every = np.concatenate(keys)
        order = np.argsort(every)
        at = groups(every[order])
        again, others = [], []
        if len(at):
            more = more[order]
            size = np.diff(np.r_[at, len(order)])
            repeats = (size > 1) | (np.maximum.reduceat(more, at) >= 128)
            many = np.add.reduceat((more & 127).astype(np.int64), at) > hot
            known = every[order[at]]
            again, others = known[repeats & ~many], known[repeats & many]
        out = [[x[among(x, np.asarray(chosen, np.uint64))].tobytes() for x in keys] for chosen in (again, others)]
        return pa.table({"slot": table.column("slot"), "seq": table.column("seq"), **{c: pa.array(x, pa.binary()) for c, x in zip(("again", "hot"), out)}})

    return by_slot(to_parts(prints, partitions).applyInArrow(lean(run), "slot long, seq long, again binary, hot binary"), F.struct("again", "hot"))


def to_parts(rows: DataFrame, partitions: int):
    return rows.repartition(min(partitions, MOST_PARTS), "part").groupBy("part")


def by_slot(rows: DataFrame, what: Column) -> DataFrame:
    """slot, told: a map from the slot's batches to what was found for them."""
    x = rows.groupBy("slot", "seq").agg(F.collect_list(what).alias("x"))
    return x.groupBy("slot").agg(F.map_from_entries(F.collect_list(F.struct("seq", "x"))).alias("told"))


def with_told(texts: DataFrame, found: DataFrame) -> DataFrame:
    """The texts with what was found for a batch at its first document. One row a slot is joined."""
    x = texts.join(found.hint("shuffle_hash"), "slot", "left")
    return x.withColumn("told", F.element_at("told", F.col("seq")))


PASSAGES = {"slot": pa.int64(), "seq": pa.int64(), "part": pa.int32(), "passages": pa.binary(), "passages_at": pa.binary(), "windows": pa.binary(), "windows_at": pa.binary(), "gone": pa.binary()}


def suffix_arrays(texts: DataFrame, partitions: int, length: int, every: bool) -> DataFrame:
    """A batch's suffix array for each partition: passages and, where a k-gram is hot,
    windows, in the order of their bytes, and where they first stand; one row of a batch has the
    windows that it repeats itself, as starts and numbers. every: all passages, not only those whose k-gram
    occurs again."""
    layout = Layout(length)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows, not every):
            again, hot = (np.sort(np.frombuffer(b"".join(x[c] for x in batch.told or []), "<u8")) for c in ("again", "hot"))
            none = np.zeros(0, np.int64)
            found, windows = [(np.zeros(0, np.uint64), np.zeros(0, layout.kind), none, none)], [(np.zeros(0, np.uint64), np.zeros(0, f"S{length}"), none)]
            for raw, sizes, base in batch.blocks(length):
                prints = Prints(raw)
                keys, place, first, count = samples(prints, sizes, length)
                some = np.flatnonzero(among(keys, again)) if not every else np.arange(len(keys))
                if len(some):
                    found.append((keys[some], layout.cut(raw, place[some], first[some], count[some]), in_batch(first[some], sizes, base), count[some]))
                some = np.flatnonzero(among(keys, hot))
                if len(some):
                    start = np.repeat(first[some] - (np.cumsum(count[some]) - count[some]), count[some]) + np.arange(int(count[some].sum()))
                    windows.append((prints(start, length, 2), np.lib.stride_tricks.sliding_window_view(raw, length)[start].view(f"S{length}").ravel(), in_batch(start, sizes, base)))
            keys, passages, at, count = (np.concatenate(c) for c in zip(*found))
            own, string, start = (np.concatenate(c) for c in zip(*windows))
            passages, lead = np.unique(passages, return_index=True)  # the first of equal ones, which stand in order
            gone = np.ones(len(at), bool)
            gone[lead] = False
            string, first = np.unique(string, return_index=True)
            twice = np.ones(len(start), bool)
            twice[first] = False
            starts, counts = np.r_[at[gone], start[twice]], np.r_[count[gone], np.ones(int(twice.sum()), np.int64)]
            a = per_part(dealt(keys[lead], partitions), partitions, passages, at[lead].astype("<u4"))
            b = per_part(dealt(own[first], partitions), partitions, string, start[first].astype("<u4"))
            out = [(batch.slot, batch.seq, int(mixed(np.array([batch.seq], np.uint64), 3)[0] % np.uint64(partitions)), None, None, None, None, runs_bytes(starts, counts))]
            for p in sorted({*a, *b}):
                columns = [x.tobytes() for x in (*a.get(p, (passages[:0], start[:0])), *b.get(p, (string[:0], start[:0])))]
                out.append((batch.slot, batch.seq, p, *columns, None))
            yield rows_of(PASSAGES, out)

    return texts.mapInArrow(lean(run), "slot long, seq long, part int, passages binary, passages_at binary, windows binary, windows_at binary, gone binary")


def runs_bytes(starts: np.ndarray, counts: np.ndarray) -> bytes:
    return starts.astype("<u4").tobytes() + counts.astype("<u4").tobytes()


def repeated(arrays: DataFrame, partitions: int, length: int, keep: bool) -> DataFrame:
    """slot, seq, runs: the windows of each batch that an earlier place holds, as
    starts and numbers. Rows without a slot hold levels (`passages`, seq their order)
    from before; keep: give the levels that there are in the end (part, level)."""
    layout = Layout(length)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted((r for r in table.to_pylist()), key=lambda r: (r["slot"] is not None, r["seq"]))
        part = rows[0]["part"]
        read = lambda x, kind: np.frombuffer(x or b"", kind)
        old = [read(r["passages"], layout.kind) for r in rows if r["slot"] is None]
        family, fresh, out = Family(old), [], []
        for r in rows:
            if r["slot"] is None:
                continue
            if r["gone"] is not None:
                out.append((r["slot"], r["seq"], r["gone"], None, None))
            x, at = read(r["passages"], layout.kind), read(r["passages_at"], "<u4").astype(np.int64)
            known = family.known(x)
            family.add(x[~known])
            counts = layout.counts(x[known])
            fresh.append((r, x[~known], at[~known], at[known], counts))
        levels, seconds = list(family.levels), Family()
        whole = family.whole() if levels else np.zeros(0, layout.kind)
        several = layout.several(whole) if len(whole) else np.zeros(0, bool)
        asked = lambda x: several[np.searchsorted(whole, x)]
        for x in old:
            seconds.add(np.unique(layout.windows(x[asked(x)], np.zeros(len(x), np.int64))[0]))
        for r, x, at, starts, counts in fresh:
            ask = asked(x)
            strings, places = layout.windows(x[ask], at[ask])
            strings, places = np.concatenate([strings, read(r["windows"], f"S{length}")]), np.r_[places, read(r["windows_at"], "<u4").astype(np.int64)]
            order = np.argsort(places, kind="stable")
            strings, places = strings[order], places[order]
            strings, lead = np.unique(strings, return_index=True)
            known = seconds.known(strings)
            seconds.add(strings[~known])
            gone = np.ones(len(places), bool)
            gone[lead[~known]] = False
            gone = places[gone]
            if len(gone):  # neighbours as one run
                at = np.flatnonzero(np.r_[True, gone[1:] != gone[:-1] + 1])
                starts, counts = np.r_[starts, gone[at]], np.r_[counts, np.diff(np.r_[at, len(gone)])]
            if len(starts):
                out.append((r["slot"], r["seq"], runs_bytes(starts, counts), None, None))
        if keep:
            out += [(None, i, None, part, x.tobytes()) for i, x in enumerate(levels)]
        return pa.Table.from_batches([rows_of(FOUND, out)]) if out else pa.table({c: pa.array([], t) for c, t in FOUND.items()})

    return to_parts(arrays, partitions).applyInArrow(lean(run), "slot long, seq long, runs binary, part int, level binary")


FOUND = {"slot": pa.int64(), "seq": pa.int64(), "runs": pa.binary(), "part": pa.int32(), "level": pa.binary()}


def cleaned(told: DataFrame, length: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (start, end in bytes), kept (bytes), row_key."""
    span = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows, True):
            found = [np.frombuffer(x, "<u4").astype(np.int64) for x in batch.told or []]
            starts = np.concatenate([x[: len(x) // 2] for x in found]) if found else np.zeros(0, np.int64)
            counts = np.concatenate([x[len(x) // 2 :] for x in found]) if found else starts
            order = np.argsort(starts)
            starts, counts = starts[order], counts[order]
            at, i = 0, 0
            while i < len(batch.docs):
                j, size = i, 0
                while j < len(batch.docs) and (j == i or size + len(batch.docs[j][2]) <= BLOCK_BYTES):
                    size += len(batch.docs[j][2])
                    j += 1
                lo, hi = np.searchsorted(starts, [at, at + size])
                yield without(batch.docs[i:j], starts[lo:hi] - at, counts[lo:hi])
                at, i = at + size, j

    def without(docs: list[tuple[int, int, bytes]], starts: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        raw, sizes = b"".join(x for _, _, x in docs), np.array([len(x) for _, _, x in docs])
        mark = np.zeros(len(raw) + 1, np.int32)
        np.add.at(mark, starts, 1)
        np.add.at(mark, starts + counts - 1 + length, -1)
        covered = np.cumsum(mark[:-1]) > 0
        ends = np.cumsum(sizes)
        edge = np.zeros(len(raw) + 1, bool)  # a run of removed bytes ends with its document
        edge[ends - sizes] = True
        before = np.r_[False, covered[:-1]] if len(covered) else covered
        opens = np.flatnonzero(covered & (~before | edge[:-1]))
        after = np.r_[covered[1:], False] if len(covered) else covered
        closes = np.flatnonzero(covered & (~after | edge[1:])) + 1
        x = np.frombuffer(raw, np.uint8)
        low, high = np.searchsorted(opens, ends - sizes), np.searchsorted(opens, ends)
        out = []
        for (doc, row, own), a, b, i, j in zip(docs, (ends - sizes).tolist(), ends.tolist(), low.tolist(), high.tolist()):
            removed = int((closes[i:j] - opens[i:j]).sum())
            left = own if not removed else x[a:b][~covered[a:b]].tobytes()
            spans = [{"start": s - a, "end": e - a} for s, e in zip(opens[i:j].tolist(), closes[i:j].tolist())]
            out.append((None if doc == NULL_ID else doc, b - a, removed, spans, left, row))
        return rows_of({"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "spans": span, "kept": pa.binary(), "row_key": pa.int64()}, out)

    return told.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, row_key long")


def text_of_bytes(column: str) -> Column:
    """UTF-8 bytes as text, without the bytes of characters that a cut has halved."""

    @F.pandas_udf("string")
    def text(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: x.decode("utf-8", "ignore"))

    return text(F.col(column))


def stored_levels(spark: SparkSession, index: str) -> DataFrame | None:
    """The newest levels in the folder: part, seq, level, partitions."""
    place = spark._jvm.org.apache.hadoop.fs.Path(index)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in system.listStatus(place)] if system.exists(place) else []
    done = [int(x.removeprefix("version=")) for x in names if x.startswith("version=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{index}/{x}/_SUCCESS"))]
    return spark.read.parquet(f"{index}/version={max(done)}").withColumn("version", F.lit(max(done))) if done else None


def remove_repeats(docs: DataFrame, length: int = LENGTH, key: str | None = None, index: str | None = None, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, spans, kept.

    A byte goes if a string of `length` bytes that covers it also starts earlier:
    in a smaller doc_id, or earlier in the same document. Texts are whole, in
    UTF-8; a null text is empty; matches never cross documents and are judged on
    the input. Rows that repeat a doc_id are taken one after the other, in the order of
    their first characters; a null doc_id comes first. Texts shorter than `length` stay; a very long text
    is looked at in pieces, with one result. Other columns are
    ignored; an empty table gives no rows. `key` names a long column that tells rows
    apart and comes along.

    index: a folder that all machines share. Strings in the batches that it has seen count as
    earlier, whatever their doc_id, and this call's batch is added to it. All passages
    go to an index, not only those that occur again, as a later batch may repeat them.
    """
    if length < KGRAM:
        raise ValueError(f"length is at least {KGRAM}")
    spark = docs.sparkSession
    on_workers(spark)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    texts = parts_of(docs, key, total)
    partitions = max(8, -(-total // PARTITION_BYTES))
    if index is None:
        known = written(occurring_again(fingerprints(texts, partitions, length), partitions, hot), "again")
        found = written(repeated(suffix_arrays(with_told(texts, known), partitions, length, False), partitions, length, False), "repeated")
    else:
        before = stored_levels(spark, index)
        partitions = before.first()["partitions"] if before else partitions
        arrays = suffix_arrays(texts, partitions, length, True)
        if before:
            none = {c: F.lit(None).cast("binary").alias(c) for c in ("passages_at", "windows", "windows_at", "gone")}
            arrays = arrays.unionByName(before.select(F.lit(None).cast("long").alias("slot"), "seq", "part", F.col("level").alias("passages"), *none.values()))
        found = written(repeated(arrays, partitions, length, True), "repeated")
        version = before.first()["version"] + 1 if before else 0
        found.filter("level is not null").select("part", "seq", "level", F.lit(partitions).alias("partitions")).write.parquet(f"{index}/version={version}")
        found = found.filter("level is null")
    out = cleaned(with_told(texts, by_slot(found, F.col("runs"))), length)
    return out.withColumnRenamed("row_key", key) if key else out.drop("row_key")
