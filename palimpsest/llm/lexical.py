"""Ranked lexical search by Block-Max WAND over an index that is parted by documents.

A shard of the index holds some thousands of documents. Each of its terms is one row:
the postings in blocks of 128, compressed, and beside each block its first and last
document and the highest impact in it. A search moves over these bounds only (shallow
moves): the sum of the block maxima at a document bounds its score, the next document
whose bound reaches the threshold is the pivot, and blocks that hold no such document
are never decompressed. The threshold of a query rises within a shard and goes on from
shard to shard of a task; the tasks' lists are merged for each query.

All weights and impacts are integers, so that results don't depend on how documents
are dealt.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import lean, on_workers, text_of, written

#: Digits, A-Z, a-z and all beyond ASCII, as bytes of UTF-8.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Postings in a block; documents and bytes of text in a shard; queries that are searched together; pivots scored at once.
BLOCK, SHARD_DOCS, SHARD_BYTES, QUERIES, PIVOTS = 128, 8192, 8 << 20, 256, 1024
BOUNDS = np.dtype([("first", "<i4"), ("last", "<i4"), ("stop", "<i4"), ("peak", "<i8")])
#: A shard's documents: id, whether there is one, length factor. They stand in the row of the empty term.
DOC = np.dtype([("id", "<i8"), ("known", "?"), ("m", "<i8")])
INDEX = "shard long, term binary, df long, peak long, bounds binary, payload binary"
#: The asked terms are broadcast up to so many (each with its queries of one block, 256 at most).
SMALL = 50_000


def lengths(texts: pa.Array) -> np.ndarray:
    """Terms with repeats of each text."""
    x = texts.cast(pa.large_binary())
    at = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
    raw = np.frombuffer(x.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    inside = IS_TERM[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = at[:-1][at[:-1] < at[1:]] - at[0]  # a text's first byte begins a term, whatever stands before
    starts[edges] = inside[edges]
    seen = np.r_[0, np.cumsum(starts)]
    return np.diff(seen[at - at[0]])


def statistics(docs: DataFrame) -> tuple[int, int]:
    """N, the documents with a term, and L, all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = lengths(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["docs", "terms"])

    on_workers(docs.sparkSession)
    n, terms = text_of(docs).select("text").mapInArrow(lean(run), "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    return n, terms


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers in 7 bits a byte, the last byte of each below 128; the places where they end."""
    size = 1 + sum((values >= 1 << bits).astype(np.int64) for bits in (7, 14, 21, 28))
    stops = np.cumsum(size)
    starts, out = stops - size, np.zeros(int(stops[-1]) if len(stops) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        more = size > k
        out[starts[more] + k] = (values[more] >> 7 * k & 127) | np.where(size[more] > k + 1, 128, 0)
    return out, stops


def unpacked(raw: np.ndarray) -> np.ndarray:
    stops = np.flatnonzero(raw < 128)
    starts = np.r_[0, stops[:-1] + 1]
    out = np.zeros(len(stops), np.int64)
    for k in range(int((stops - starts).max(initial=-1)) + 1):
        more = stops - starts >= k
        out[more] |= (raw[starts[more] + k].astype(np.int64) & 127) << 7 * k
    return out


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 10**9 * tf // (1000 * tf + 8 * m)


def binaries(raw: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The spans between cuts as binary values."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def shard_rows(shard: int, ids: list[int | None], texts: list[bytes], n_docs: int, n_terms: int, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The index rows of one shard: its documents, then its terms in order."""
    vocab: dict[bytes, int] = defaultdict()
    vocab.default_factory = vocab.__len__
    flat, n = array("I"), []
    for text in texts:
        found = TERM.findall(text.lower())  # bytes.lower() changes A-Z only
        flat.extend(map(vocab.__getitem__, found))
        n.append(len(found))
    docs = np.zeros(len(ids), DOC)
    docs["id"], docs["known"], docs["m"] = [x or 0 for x in ids], [x is not None for x in ids], 25 + 75 * np.array(n, np.int64) * n_docs // max(n_terms, 1)
    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([b""], pa.binary()), pa.array([0]), pa.array([0]), pa.array([b""], pa.binary()), pa.array([docs.tobytes()], pa.binary())], [x.split()[0] for x in INDEX.split(", ")])
    if not vocab:
        return
    names = sorted(vocab)
    place = np.zeros(len(names), np.int64)
    place[[vocab[x] for x in names]] = np.arange(len(names))
    keys, tf = np.unique(place[np.frombuffer(flat, np.uint32)] * len(ids) + np.repeat(np.arange(len(ids)), n), return_counts=True)
    term, doc = np.divmod(keys, len(ids))
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    df = np.diff(np.r_[first, len(term)])
    start = np.flatnonzero((np.arange(len(term)) - first[term]) % BLOCK == 0)
    stop = np.r_[start[1:], len(term)]
    gap = np.r_[0, np.diff(doc)]
    gap[start] = 0
    impact = impacts(tf, docs["m"][doc])
    payload, ends = packed(np.stack([gap, tf - 1], 1).ravel())
    term_ends = ends[2 * np.r_[first[1:], len(term)] - 1]
    of = term[start]  # the term of each block
    bounds = np.zeros(len(start), BOUNDS)
    bounds["first"], bounds["last"], bounds["peak"] = doc[start], doc[stop - 1], np.maximum.reduceat(impact, start)
    bounds["stop"] = ends[2 * stop - 1] - np.r_[0, term_ends][of]
    peak = np.maximum.reduceat(impact, first)
    block_cuts, byte_cuts = np.searchsorted(of, np.arange(len(names) + 1)), np.r_[0, term_ends]
    for at in range(0, len(names), rows):
        to = min(at + rows, len(names))
        some, raw = bounds[block_cuts[at] : block_cuts[to]], payload[byte_cuts[at] : byte_cuts[to]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(to - at, shard)), pa.array(names[at:to], pa.binary()), pa.array(df[at:to]), pa.array(peak[at:to]), binaries(some.view(np.uint8), (block_cuts[at : to + 1] - block_cuts[at]) * BOUNDS.itemsize), binaries(raw, byte_cuts[at : to + 1] - byte_cuts[at])],
            [x.split()[0] for x in INDEX.split(", ")],
        )


def index(docs: DataFrame, n_docs: int, n_terms: int, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index of all documents, written in the shared folder. Maximum impacts hold
    for the N and L given: a table that grows by much is indexed anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, texts, size = 0, [], [], 0
        for batch in batches:
            for row, i, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                shard = shard if ids else row  # named by its first row
                ids.append(i)
                texts.append(text.as_py())
                size += len(texts[-1])
                if len(ids) >= shard_docs or size >= SHARD_BYTES:
                    yield from shard_rows(shard, ids, texts, n_docs, n_terms)
                    ids, texts, size = [], [], 0
        if ids:
            yield from shard_rows(shard, ids, texts, n_docs, n_terms)

    on_workers(docs.sparkSession)
    x = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return written(x.mapInArrow(lean(run), INDEX), "lexical-index")


class Postings:
    """One term's list in a shard; blocks are decompressed when first asked for."""

    def __init__(self, bounds: bytes, payload: bytes, df: int, m: np.ndarray) -> None:
        self.bounds, self.payload, self.df, self.m = np.frombuffer(bounds, BOUNDS), payload, df, m
        self.open = np.zeros(len(self.bounds), bool)
        self.docs, self.impacts = np.zeros(df, np.int32), np.zeros(df, np.int64)

    def decompress(self, low: int, high: int) -> None:
        """The blocks from low to before high."""
        b = self.bounds
        raw = np.frombuffer(self.payload, np.uint8)[b["stop"][low - 1] if low else 0 : b["stop"][high - 1]]
        gap, tf = unpacked(raw).reshape(-1, 2).T
        of = np.arange(len(gap)) // BLOCK
        run = np.cumsum(gap)
        docs = run - run[of * BLOCK] + b["first"][low:high][of]
        at = slice(low * BLOCK, low * BLOCK + len(gap))
        self.docs[at], self.impacts[at] = docs, impacts(tf + 1, self.m[docs])
        self.open[low:high] = True

    def of(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of the blocks, given in order."""
        new = blocks[~self.open[blocks]]
        if len(new):
            for part in np.split(new, np.flatnonzero(np.diff(new) > 1) + 1):
                self.decompress(int(part[0]), int(part[-1]) + 1)
        if len(blocks) == len(self.open):
            return self.docs, self.impacts
        at = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        at = at[at < self.df]
        return self.docs[at], self.impacts[at]


class Best:
    """The k best documents of a query so far."""

    def __init__(self, k: int) -> None:
        self.k, self.rows, self.least = k, [], 1

    def add(self, scores: np.ndarray, docs: np.ndarray, at: np.ndarray, shard: int) -> None:
        """A document with an equal score stays in the run, as its id may be smaller."""
        new = zip((-scores).tolist(), docs["known"].tolist(), docs["id"].tolist(), [shard] * len(at), at.tolist())
        self.rows = sorted([*self.rows, *new])[: self.k]
        if len(self.rows) == self.k:
            self.least = -self.rows[-1][0]


def search_shard(docs: np.ndarray, asked: list[tuple[int, int, Postings]], best: Best, shard: int, pivots: int = PIVOTS) -> None:
    """One query in one shard. asked: (weight, highest impact, postings) of its terms."""
    if sum(w * peak for w, peak, _ in asked) < best.least:
        return
    change = np.zeros(len(docs) + 1, np.int64)
    for w, _, x in asked:  # shallow: bounds of blocks only
        np.add.at(change, x.bounds["first"], w * x.bounds["peak"])
        np.subtract.at(change, x.bounds["last"] + 1, w * x.bounds["peak"])
    upper = np.cumsum(change)[:-1]
    reach = np.flatnonzero(upper >= best.least)
    for at in range(0, len(reach), pivots):
        some = reach[at : at + pivots]
        some = some[upper[some] >= best.least]  # the threshold has risen meanwhile
        if not len(some):
            continue
        seen = np.zeros(len(docs) + 1, np.int64)
        seen[some + 1] = 1
        seen = np.cumsum(seen)
        score = np.zeros(len(docs), np.int64)
        for w, _, x in asked:
            blocks = np.flatnonzero(seen[x.bounds["last"] + 1] > seen[x.bounds["first"]])
            if len(blocks):
                where, impact = x.of(blocks)
                score[where] += w * impact
        some = some[score[some] >= best.least]
        if len(some) > 4 * best.k:  # what is below the k-th here goes before rows are made
            some = some[score[some] >= np.partition(score[some], len(some) - best.k)[len(some) - best.k]]
        if len(some):
            best.add(score[some], docs[some], some, shard)


def queries_of(items: DataFrame, queries: int = QUERIES) -> tuple[DataFrame, DataFrame]:
    """The items with a query number, and their terms: block, query, term, times."""
    rows = written(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("query", F.monotonically_increasing_id()), "items")
    blocks = -(-rows.count() // queries)
    x = rows.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(max(blocks, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(b, q, t, n) for b, q, text in zip(*(batch.column(c).to_pylist() for c in ("block", "query", "text"))) for t, n in Counter(TERM.findall(text.encode().lower())).items()]
            block, query, term, times = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(query, pa.int64()), pa.array(term, pa.binary()), pa.array(times, pa.int64())], ["block", "query", "term", "times"])

    return rows.drop("text"), written(x.mapInArrow(lean(run), "block long, query long, term binary, times long"), "query-terms")


def searched(rows: DataFrame, k: int) -> DataFrame:
    """query, doc_id, score, shard, nth: each task's k best of each query. rows: those
    of one block of queries and one shard stand together, documents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(found: dict[int, Best]) -> pa.RecordBatch:
            out = [(q, i if known else None, -s, shard, at) for q, x in found.items() for s, known, i, shard, at in x.rows]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 5)], ["query", "doc_id", "score", "shard", "nth"])

        found: dict[int, Best] = {}
        now, each = None, (row for batch in batches for at in range(0, batch.num_rows, 256) for row in batch.slice(at, 256).to_pylist())
        for (block, shard), group in groupby(each, lambda r: (r["block"], r["shard"])):
            if block != now and found:
                yield result(found)
                found = {}
            now, docs, asked = block, np.zeros(0, DOC), defaultdict(list)
            for r in group:
                if r["term"] == b"":
                    docs = np.frombuffer(r["payload"], DOC)
                    m = docs["m"].copy()
                else:
                    postings = Postings(r["bounds"], r["payload"], r["df"], m)
                    for q in r["queries"]:
                        asked[q["query"]].append((r["weight"] * q["times"], r["peak"], postings))
            for q, terms in asked.items():
                search_shard(docs, terms, found.setdefault(q, Best(k)), shard)
        if found:
            yield result(found)

    near = rows.repartition("block", "shard").sortWithinPartitions("block", "shard", "term")
    return near.mapInArrow(lean(run), "query long, doc_id long, score long, shard long, nth long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """item_id, rank from 1, doc_id, score: each item's k documents of highest score above 0.

    Equal scores come by ascending doc_id, a null one first, then by the place of the
    row. A null text has no terms, an empty one neither; an item without terms, or
    whose terms no document holds, has no rows. Rows that repeat a doc_id are documents
    of their own, and rows that repeat an item_id items of their own. Other columns
    are ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    n_docs, n_terms = statistics(docs)
    rows, terms = queries_of(items)
    postings = index(docs, n_docs, n_terms, shard_docs)
    names = terms.select("term").distinct()
    df = postings.select("term", "df").join(names, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("all"))
    weight = F.floor(1000.0 * F.log((F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("all") + 1).cast("double")))).cast("long")
    asked = terms.groupBy("block", "term").agg(F.collect_list(F.struct("query", "times")).alias("queries")).join(df, "term").select("block", "term", weight.alias("weight"), "queries").filter("weight > 0")
    none = asked.select("block").distinct().select("block", F.lit(b"").alias("term"), F.lit(0).cast("long").alias("weight"), F.expr("cast(array() as array<struct<query: bigint, times: bigint>>)").alias("queries"))
    asked = written(asked.unionByName(none), "asked")
    if asked.count() <= SMALL:
        asked = F.broadcast(asked)
    found = searched(postings.join(asked, "term").select("block", "shard", "term", "df", "peak", "weight", "queries", "bounds", "payload"), k)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "shard", "nth")
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.join(rows, "query").select("item_id", "rank", "doc_id", "score")
