"""Near-duplicate classes: improved consistent weighted sampling (Ioffe 2010) over
TF-IDF shingles, banded, every link verified by weighted Jaccard similarity.

A shingle is five words of the text in lower case. d is the number of documents in
its bucket of a hashed table of document frequencies over all rows; the table's
size is fixed, and the share of N that a bucket gathers by chance does not depend
on N. A shingle weighs its count times 1 + ln((N + 1) / (d + 1)) / ln(N + 2), by
which a large group's own shingles keep their say against its edits. Candidates are
sampled by the weights that links are verified with, so that a pair's chance of
meeting depends on its similarity alone. Equal texts are one node from the start.

Pairs of a bucket are never listed. Its members meet in blocks of bounded size, where
an upper bound of the similarity, taken from sums of weights over slices of the
hashes, passes few pairs on to be verified. In three rounds the first members of a block,
some more, and at last all are compared with those in other components, and components
are joined before the next round, so that a large group of copies collapses after few
comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import drop_written, heaps_returned, lean, on_workers, written
from palimpsest.llm.components import components

WORDS, THRESHOLD = 5, 0.8
#: Bands and samples in each: a pair at 0.8 shares none with probability 0.0004, one at 0.3 some with 0.05.
BANDS, ROWS = 20, 5
#: Buckets of the table of document frequencies (4 MB, whatever the input).
TABLE, SLICE = 1 << 20, 1 << 16
#: Slices of the hashes for the bound, members in a block at most, and how many of them each round compares with the rest.
SLICES, BLOCK, DRAWN = 256, 2048, (2, 18, None)
#: Rows of random variates that shingles share by hash.
VARIATES = 1 << 14


class Words(dict):
    """word -> 64-bit hash; emptied when full."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, words: Words, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 32-bit hashes of the text's shingles, and their counts. A text of
    fewer words is one shingle; one without words has none."""
    tokens = text.lower().split()
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    h = np.fromiter(map(words.__getitem__, tokens), np.uint64, n)
    size = min(size, n)
    with np.errstate(over="ignore"):
        x = h[: n - size + 1].copy()
        for i in range(1, size):
            x = x * np.uint64(0x9E3779B97F4A7C15) + h[i : n - size + 1 + i]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    hashes, counts = np.unique((x >> np.uint64(32)).astype(np.uint32), return_counts=True)
    return hashes, counts.astype(np.uint32)


def packed(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Gaps between sorted hashes, then counts: both compress."""
    return np.concatenate([np.diff(hashes, prepend=np.uint32(0)), counts]).astype("<u4").tobytes()


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(raw, "<u4")
    n = len(x) // 2
    return np.cumsum(x[:n], dtype=np.uint32), x[n:]


def frequencies(table: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequency of each bucket, between 1 and 2."""
    return (1 + np.log((n + 1) / (np.minimum(table, n) + 1)) / np.log(n + 2)).astype(np.float32)


class Sampler:
    """Consistent weighted samples of a document's weighted shingles."""

    def __init__(self, idf: np.ndarray, bands: int = BANDS, rows: int = ROWS, seed: int = 20100) -> None:
        self.idf, self.bands, self.rows = idf, bands, rows
        rng, shape = np.random.default_rng(seed), (VARIATES, bands * rows)
        self.r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
        self.beta = rng.random(shape, np.float32)

    def weights(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.idf[hashes & np.uint32(TABLE - 1)] * counts

    def keys(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One 64-bit key for each band."""
        best, chosen, level = None, None, None
        at = np.arange(self.bands * self.rows)
        log_w = np.log(self.weights(hashes, counts)).astype(np.float32)
        for a in range(0, len(hashes), 2048):
            row = (hashes[a : a + 2048] >> np.uint32(18)).astype(np.int64)
            r, beta = self.r[row], self.beta[row]
            t = np.floor(log_w[a : a + 2048, None] / r + beta)
            cost = self.log_c[row] - r * (t - beta + 1)
            i = cost.argmin(0)
            low = cost[i, at]
            if best is None:
                best, chosen, level = low, hashes[a + i], t[i, at]
            else:
                less = low < best
                best = np.where(less, low, best)
                chosen = np.where(less, hashes[a + i], chosen)
                level = np.where(less, t[i, at], level)
        with np.errstate(over="ignore"):
            x = chosen.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (level.astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            x = x.reshape(self.bands, self.rows)
            key = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            for i in range(self.rows):
                key = (key ^ x[:, i]) * np.uint64(0xFF51AFD7ED558CCD)
                key ^= key >> np.uint64(32)
        return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weights: np.ndarray, others: np.ndarray) -> float:
    """Weighted Jaccard similarity of two documents' sorted shingles."""
    i = np.searchsorted(b[0], a[0])
    i[i == len(b[0])] = 0
    same = b[0][i] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    common = float(np.minimum(weights[same], others[i[same]]).sum())
    total = float(weights.sum()) + float(others.sum()) - common
    return common / total if total else 0.0


def features(docs: DataFrame, size: int = WORDS, key: str | None = None) -> tuple[DataFrame, np.ndarray, int]:
    """Written rows (row_id, doc_id, digest, shingles, key); the table of document
    frequencies, summed over all rows; the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = Words(), np.zeros(TABLE, np.int64)
        schema = pa.schema({"doc_id": pa.int64(), "digest": pa.string(), "shingles": pa.binary(), "slice": pa.int32(), "counts": pa.binary(), "key": pa.int64()})
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                out = []
                for text in batch.column("text").to_pylist():
                    hashes, counts = shingles(text, words, size)
                    table[hashes & np.uint32(TABLE - 1)] += 1  # a document counts once in a bucket
                    out.append(packed(hashes, counts))
                n = len(out)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(out, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), batch.column("key")], schema=schema)
        for i in range(TABLE // SLICE):
            yield pa.RecordBatch.from_pylist([{"slice": i, "counts": table[i * SLICE : (i + 1) * SLICE].astype("<i8").tobytes()}], schema)

    text = F.coalesce(F.col("text"), F.lit(""))
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("digest"), text.alias("text"), (F.col(key) if key else F.lit(None)).cast("long").alias("key"))
    x = written(x.mapInArrow(lean(run), "doc_id long, digest string, shingles binary, slice int, counts binary, key long").withColumn("row_id", F.monotonically_increasing_id()), "shingles")
    rows = x.filter("slice is null").select("row_id", "doc_id", "digest", "shingles", "key")
    return rows, summed(x.filter("slice is not null").select("slice", "counts", "row_id")), rows.count()


def summed(parts: DataFrame, fan: int = 32) -> np.ndarray:
    """Add up the tasks' tables, in groups of about `fan`, until one is left."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist())
        return pa.table({"slice": table.column("slice")[:1].cast(pa.int32()), "counts": pa.array([np.asarray(total, "<i8").tobytes()], pa.binary()), "row_id": table.column("row_id")[:1]})

    n = parts.count() // (TABLE // SLICE)
    while n > 1:
        n = -(-n // fan)
        parts = parts.withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(n))).groupBy("slice", "part").applyInArrow(lean(add), "slice int, counts binary, row_id long")
        parts = written(parts, "frequencies")
    rows = {r.slice: np.frombuffer(r.counts, "<i8") for r in parts.select("slice", "counts").collect()}  # one table of fixed size
    return np.concatenate([rows.get(i, np.zeros(SLICE, np.int64)) for i in range(TABLE // SLICE)])


def banded(rows: DataFrame, idf, bands: int, per_band: int) -> DataFrame:
    """row_id, digest, buckets (a key for each band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(idf.value, bands, per_band)
        for batch in batches:
            each = [unpacked(x) for x in batch.column("shingles").to_pylist()]
            keys = [sampler.keys(*x).tolist() if len(x[0]) else [] for x in each]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("digest"), pa.array(keys, pa.list_(pa.int64()))], ["row_id", "digest", "buckets"])

    return rows.select("row_id", "digest", "shingles").mapInArrow(lean(run), "row_id long, digest string, buckets array<long>")


def verified(pairs: DataFrame, shingled: DataFrame, idf) -> DataFrame:
    """a, b, sim of distinct pairs (a, b); pairs of one a stand together, so that
    its shingles are unpacked once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        weigh = lambda x: idf.value[x[0] & np.uint32(TABLE - 1)] * x[1]
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "left", "right"))):
                if a != last:
                    last, left = a, unpacked(x)
                    weights = weigh(left)
                right = unpacked(y)
                out.append(similarity(left, right, weights, weigh(right)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "sim"])

    x = pairs.join(shingled.select(F.col("row_id").alias("b"), F.col("shingles").alias("right")), "b")
    x = x.join(shingled.select(F.col("row_id").alias("a"), F.col("shingles").alias("left")), "a")
    return x.select("a", "b", "left", "right").mapInArrow(lean(run), "a long, b long, sim double")


def crowded(members: DataFrame) -> DataFrame:
    """Members (bucket, row_id, n) of buckets with at least two, n being their number."""
    groups = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    return members.join(groups, "bucket")


def sliced(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of the weights over slices of the hashes, rounded up. The sum of two texts'
    smaller ones is at least the weight that they have in common."""
    x = np.bincount(hashes >> np.uint32(24), weights, SLICES)
    low = np.minimum(x, 60000).astype(np.float16)
    return np.where(x > 60000, np.float16(np.inf), np.where(low < x, np.nextafter(low, np.float16(np.inf)), low))


def sketched(shingled: DataFrame, idf) -> DataFrame:
    """row_id, mass (the sum of the weights), buckets and slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mass, slices = [], []
            for raw in batch.column("shingles").to_pylist():
                hashes, counts = unpacked(raw)
                weights = idf.value[hashes & np.uint32(TABLE - 1)] * counts
                mass.append(float(weights.sum(dtype=np.float64)))
                slices.append(sliced(hashes, weights).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("buckets"), pa.array(mass, pa.float64()), pa.array(slices, pa.binary())], ["row_id", "buckets", "mass", "slices"])

    return shingled.select("row_id", "buckets", "shingles").mapInArrow(lean(run), "row_id long, buckets array<long>, mass double, slices binary")


def compared(block: pa.Table, done: int, drawn: int | None, threshold: float) -> list[tuple[int, int]]:
    """Pairs of a block's members that may be similar: of other components, of like
    mass, this bucket being their first common one. The members from `done` to `drawn` in
    the block's order meet all; in a block of two parts, members of one meet the other."""
    n = block.num_rows
    order = np.lexsort((block.column("row_id").to_numpy(), block.column("place").to_numpy()))
    row, root, mass, other = (block.column(c).to_numpy()[order] for c in ("row_id", "root", "mass", "other"))
    if (root == root[0]).all():
        return []
    buckets = np.stack(block.column("buckets").to_numpy())[order]
    slices = np.frombuffer(b"".join(block.column("slices").to_pylist()), np.float16).reshape(n, SLICES)[order].astype(np.float32)
    band = int(np.argmax(buckets[0] == block.column("bucket")[0].as_py()))
    whole, out = bool((other == other[0]).all()), []
    for i in range(done if whole else 0, n - 1 if drawn is None else min(drawn, n - 1)):
        j = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        j = j[np.minimum(mass[j], mass[i]) >= (threshold - 1e-6) * np.maximum(mass[j], mass[i])]
        if not whole:
            j = j[other[j] != other[i]]
        if len(j):
            j = j[np.argmax(buckets[j] == buckets[i], 1) == band]
        if len(j):
            common = np.minimum(slices[j], slices[i]).sum(1)
            j = j[common >= (threshold - 1e-4) * np.maximum(mass[j] + mass[i] - common, 1e-9)]
            out += [(min(int(row[i]), x), max(int(row[i]), x)) for x in row[j].tolist()]
    return out


def candidates(active: DataFrame, sketches: DataFrame, done: int, drawn: int | None, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) to be verified. A bucket of many members is dealt to blocks;
    at last (drawn is None) each two blocks meet too."""
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    x = active.withColumn("place", F.xxhash64("row_id")).withColumn("own", F.pmod("place", parts).cast("int"))
    others = F.sequence(F.lit(0), parts - 1) if drawn is None else F.array("own")
    x = x.withColumn("part", F.explode(others)).withColumns({"low": F.least("own", "part"), "high": F.greatest("own", "part")})
    x = x.join(sketches, "row_id").select("bucket", "low", "high", "row_id", "root", "place", F.col("own").alias("other"), "mass", "buckets", "slices")
    keys = ["bucket", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        pairs = lambda found: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), ()))], ["a", "b"])
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]).combine_chunks() if held else rows
            cuts = [0, *(groups_of(*(rows.column(c).to_numpy() for c in keys))[1:]).tolist(), rows.num_rows]
            found = []
            for a, b in zip(cuts[:-2], cuts[1:]):
                if b - a > 1:
                    found += compared(rows.slice(a, b - a), done, drawn, threshold)
            held = rows.slice(cuts[-2])
            yield pairs(found)
        if held and held.num_rows > 1:
            yield pairs(compared(held, done, drawn, threshold))

    return x.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), "a long, b long").distinct()


def groups_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def linked(members: DataFrame, shingled: DataFrame, idf, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b, sim) that join the members (bucket, row_id, n) of each
    bucket as all its links would, and the components (node, root) that they make.

    A bucket ends when it is one component or all its members have met: every pair
    of it was compared, is known to be below the threshold, or is joined by other links.
    """
    spark = members.sparkSession
    sketches = written(sketched(shingled, idf), "sketches")
    none = spark.range(0)  # of known size, unlike a table made of local rows
    roots = none.select(F.col("id").alias("node"), F.col("id").alias("root"))
    found = none.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("sim"))
    done, rows = 0, members.select("bucket", "row_id", "n")
    for drawn in DRAWN:
        heaps_returned(spark)
        rooted = rows.join(roots.withColumnRenamed("node", "row_id"), "row_id", "left").withColumn("root", F.coalesce("root", "row_id"))
        several = rooted.groupBy("bucket").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low < _high").select("bucket")
        active = rooted.join(several, "bucket").filter(F.col("n") > done)
        sims = written(verified(candidates(active, sketches, done, drawn, threshold), shingled, idf), "similarities")
        new = sims.filter(F.col("sim") >= threshold)
        found = found.unionByName(new)
        if not new.isEmpty():
            roots = joined(roots, new)
        done = drawn
    return found, roots


def joined(roots: DataFrame, new: DataFrame) -> DataFrame:
    """Components after more links: links between the roots so far are contracted."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    x = new.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = x.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")).filter("a <> b").distinct()
    moved = components(between).select(F.col("node").alias("root"), F.col("root").alias("_new"))
    kept = roots.join(moved, "root", "left").select("node", F.coalesce("_new", "root").alias("root"))
    known = roots.select("node")
    fresh = moved.select(F.col("root").alias("node"), F.col("_new").alias("root")).join(known, "node", "left_anti")
    return written(kept.unionByName(fresh), "roots", 1)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = WORDS, bands: int = BANDS, per_band: int = ROWS, key: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_size, n_links, kept.

    Classes are the connected components of links between texts whose weighted
    Jaccard similarity is at least `threshold`, equal texts being one. class_id is
    the smallest doc_id of the class; kept marks one row of it, the first with that
    doc_id. n_links counts the verified links at the row's text. A null text is
    empty; texts without words are equal to equal ones only. A null doc_id is
    smaller than any other. Repeated rows are rows of one class; other columns are
    ignored; an empty table gives no rows. `key` names a long column that tells rows
    apart and comes along.
    """
    spark = docs.sparkSession
    on_workers(spark)
    rows, table, n = features(docs, size, key)
    idf = spark.sparkContext.broadcast(frequencies(table, n))  # 4 MB
    first = rows.groupBy("digest").agg(F.min("row_id").alias("node"))
    keys = written(banded(rows, idf, bands, per_band), "bands")
    nodes = written(rows.select("row_id", "doc_id", "digest", "key").join(first, "digest").select("row_id", "doc_id", "node", "key"), "nodes")
    single = keys.join(first, keys["row_id"] == first["node"], "left_semi")
    members = single.select(F.explode("buckets").alias("bucket"), "row_id")
    several = written(crowded(members), "crowded")
    asked = several.select("row_id").distinct()
    shingled = written(rows.select("row_id", "shingles").join(keys.select("row_id", "buckets").join(asked, "row_id", "left_semi"), "row_id"), "candidates")
    found, roots = linked(several, shingled, idf, threshold)
    counts = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    placed = nodes.join(roots, "node", "left").join(counts, "node", "left")
    placed = written(placed.select("row_id", "doc_id", "key", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "placed")
    drop_written(rows, keys, nodes, several, shingled)  # only `placed` is read from here on
    groups = placed.groupBy("root").agg(F.min(F.struct("doc_id", "row_id")).alias("keeper"), F.count("*").alias("class_size"))
    return placed.join(groups, "root").select("doc_id", F.col("keeper.doc_id").alias("class_id"), "class_size", "n_links", (F.col("row_id") == F.col("keeper.row_id")).alias("kept"), *([F.col("key").alias(key)] if key else []))
