"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import drop_written, written


def _least(edges: DataFrame) -> DataFrame:
    """node, least: the smallest of a node and its neighbours; combined before the shuffle."""
    return edges.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node that has a
    link. links: a, b longs. Rounds stop when the edges no longer change; each
    round's edges are a table in the shared folder."""
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other")).distinct(), "edges", 1)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = both.join(_least(both), "node").filter("other > node").select(F.col("other").alias("node"), F.col("least").alias("other")).filter("node <> other").distinct()
        up = written(large, "large", 1)
        small = up.join(_least(up), "node").select("other", "least", "node")
        small = small.select(F.explode(F.array(F.struct(F.col("other").alias("node"), F.col("least").alias("other")), F.struct(F.col("node"), F.col("least").alias("other")))).alias("e")).select("e.*")
        new = written(small.filter("node <> other").distinct(), "edges", 1)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first()
        drop_written(up, edges)
        edges = new
        if now == state:
            return edges.select("node", F.col("other").alias("root"))
        state = now
