"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of integer weights: a component is a term, and zero
weights are not stored. Candidates and queries are packed into blocks of bounded
size; each pair of blocks is one row of work. In it, every term of the queries
scatters its weighted postings into dense score arrays, from which a partition
selects the k best; the blocks' lists are then merged for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import on_workers, written

#: Rows in a block at most, and the score array's shape (queries x candidates), which fits in a CPU's cache.
BLOCK, QUERIES, CANDIDATES = 8192, 64, 2048
#: A list of postings that holds more than this part of a block is kept with its zeros: adding a full row is cheaper than scattering.
FULL = 0.5


def weights(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (row_id, vec_id, weights) as rows (n, terms, vec_ids, row_ids, matrix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                x = batch.slice(at, block)
                lists = x.column("weights")
                sizes = np.diff(lists.offsets.to_numpy())
                flat, terms = lists.flatten().to_numpy(zero_copy_only=False), int(sizes.max(initial=0))
                matrix = np.zeros((x.num_rows, terms), np.int64)
                matrix[np.arange(terms) < sizes[:, None]] = flat
                kind = "<i2" if abs(matrix).max(initial=0) < 2**15 else "<i8"
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.num_rows]), pa.array([terms]), *(pa.array([x.column(c).to_numpy().tobytes()], pa.binary()) for c in ("vec_id", "row_id")), pa.array([matrix.astype(kind).tobytes()], pa.binary())],
                    ["n", "terms", "vec_ids", "row_ids", "matrix"],
                )

    return rows.select("vec_id", "row_id", "weights").mapInArrow(run, "n long, terms long, vec_ids binary, row_ids binary, matrix binary")


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by vec_id, so that the first of equal scores is the right one."""
    n, terms = row["n"], row["terms"]
    vec, key = np.frombuffer(row["vec_ids"], "<i8"), np.frombuffer(row["row_ids"], "<i8")
    matrix = np.frombuffer(row["matrix"], "<i2" if len(row["matrix"]) == 2 * n * terms else "<i8").reshape(n, terms)
    order = np.lexsort((key, vec))
    return vec[order], key[order], matrix[order].astype(np.int64)


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products, term at a time over the postings of each run of candidates."""
    terms = min(queries.shape[1], candidates.shape[1])
    most = int(abs(queries).max(initial=0)) * int(abs(candidates).max(initial=0)) * max(terms, 1)
    kind = np.int32 if most < 2**31 else np.int64
    queries, candidates = queries.astype(kind), candidates.astype(kind)
    out = np.zeros((len(queries), len(candidates)), kind)
    product = np.empty((len(queries), CANDIDATES), kind)
    for at in range(0, len(candidates), CANDIDATES):
        part = np.ascontiguousarray(candidates[at : at + CANDIDATES].T)
        width = part.shape[1]
        score = np.zeros((len(queries), width), kind)
        for t in range(terms):
            asked, posted = np.flatnonzero(queries[:, t]), np.flatnonzero(part[t])
            if not len(asked) or not len(posted):
                continue
            if len(posted) > FULL * width and len(asked) > FULL * len(queries):
                np.multiply(queries[:, t, None], part[t], out=product[:, :width])
                score += product[:, :width]
            else:
                score[np.ix_(asked, posted)] += queries[asked, t, None] * part[t, posted]
        out[:, at : at + width] = score
    return out


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest, earlier ones first among equals."""
    if len(score) <= k:
        return np.argsort(-score, kind="stable")
    least = np.partition(score, len(score) - k)[len(score) - k]
    above = np.flatnonzero(score > least)
    some = np.concatenate([above, np.flatnonzero(score == least)[: k - len(above)]])
    return some[np.lexsort((some, -score[some]))]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k highest integer inner products of
    each row for which is_query holds with every other row; ties to the smaller
    vec_id, then to the earlier row.

    Vectors that are null or hold null or non-finite components take no part, nor
    do rows with a null vec_id. A shorter vector has no weight in the terms it
    lacks. Rows that repeat a vec_id are rows of their own: each is a query, and
    only a query's own row is left out of its list. With fewer than k candidates
    all are returned; an empty table gives no rows. Scores must fit in 64 bits.
    """
    spark = vectors.sparkSession
    on_workers(spark)
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), is_query.alias("is_query")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = written(x.select("vec_id", "is_query", weights(F.col("embedding"), scale).alias("weights")).withColumn("row_id", F.monotonically_increasing_id()), "vectors")
    asked = written(blocks(rows.filter("is_query"), block), "query-blocks").withColumn("asked", F.monotonically_increasing_id())
    posted = written(blocks(rows, block), "candidate-blocks")
    names = [r.asked for r in asked.select("asked").collect()]  # one long for each block of queries
    if not names:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = asked.select("asked", *(F.col(c).alias(f"q_{c}") for c in ("n", "terms", "vec_ids", "row_ids", "matrix")))
    pairs = posted.withColumn("asked", F.explode(F.lit(names))).join(queries, "asked").drop("asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vec, key, matrix = unpacked(row)
                q_vec, q_key, q_matrix = unpacked({c: row[f"q_{c}"] for c in ("n", "terms", "vec_ids", "row_ids", "matrix")})
                out: list[tuple] = []
                for at in range(0, len(q_vec), QUERIES):
                    score = scores(q_matrix[at : at + QUERIES], matrix)
                    for i, s in enumerate(score, at):
                        some = best(s, k + 1)  # one more, as the query's own row may be among them
                        some = some[key[some] != q_key[i]][:k]
                        out += zip([int(q_vec[i])] * len(some), [int(q_key[i])] * len(some), vec[some].tolist(), key[some].tolist(), s[some].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * 5)], ["query_id", "query_row", "vec_id", "row_id", "score"])

    work = pairs.repartition(max(1, min(4096, posted.count() * len(names))))
    found = work.mapInArrow(run, "query_id long, query_row long, vec_id long, row_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
