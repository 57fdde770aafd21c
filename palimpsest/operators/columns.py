"""Columns of a page: coverage of its width by words, the valley between two columns,
and text lines. Every page is a group of its own; axes are generated, so that bins
without words count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.operators.layout import lines

# Bins and valleys in points, shares of the page, smallest pages, gap that parts a line.
BIN, LEAST_VALLEY, CENTRE, PEAK_SHARE = 10.0, 30.0, (0.25, 0.75), 0.3
LEAST_WORDS, LEAST_WIDTH, LEAST_SIDE = 20, 200, 0.30
LINE_GAP = 300.0


def extents(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """page_left, page_right, n_words and n_bins of each page."""
    x = words.groupBy(*keys).agg(F.min("x").cast("double").alias("page_left"), F.max(F.col("x") + F.col("w")).cast("double").alias("page_right"), F.count("*").alias("n_words"))
    return x.withColumn("n_bins", F.greatest(F.lit(1), F.floor((F.col("page_right") - F.col("page_left")) / BIN)).cast("int"))


def coverage(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Words over each bin of the page's width, from its left edge; words beyond the last
    bin count there. The ends of words are summed per bin before they are accumulated."""
    pages = extents(words, keys)
    at = lambda x: F.floor((x - F.col("page_left")) / BIN).cast("int")
    first, last = F.greatest(F.lit(0), at(F.col("x"))), F.least(F.col("n_bins") - 1, at(F.col("x") + F.col("w")))
    ends = words.join(pages, list(keys)).select(*keys, first.alias("a"), last.alias("b")).filter("a <= b")
    ends = ends.select(*keys, F.explode(F.array(F.struct(F.col("a").alias("bin"), F.lit(1).alias("d")), F.struct((F.col("b") + 1).alias("bin"), F.lit(-1).alias("d")))).alias("e")).select(*keys, "e.*")
    ends = ends.groupBy(*keys, "bin").agg(F.sum("d").alias("d"))
    axis = pages.select(*keys, "n_bins", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))
    n = F.sum(F.coalesce("d", F.lit(0))).over(Window.partitionBy(*keys).orderBy("bin"))
    return axis.join(ends, [*keys, "bin"], "left").withColumn("n", n).select(*keys, "bin", "n", "n_bins")


def valleys(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """first_bin and last_bin of the longest low run in the page's middle, the first of
    equals: no more than 0.3 of the mean of both sides' peaks, 30 points wide at least."""
    low, high = (F.floor(F.col("n_bins") * c).cast("int") for c in CENTRE)
    inside = (F.col("bin") >= low) & (F.col("bin") < high)
    over = Window.partitionBy(*keys)
    x = bins.withColumns({
        "_in": inside,
        "_left": F.max(F.when(F.col("bin") < low, F.col("n"))).over(over),
        "_right": F.max(F.when(F.col("bin") >= high, F.col("n"))).over(over),
        "_least": F.min(F.when(inside, F.col("n"))).over(over),
    })
    limit = (F.col("_left") + F.col("_right")) / 2 * PEAK_SHARE
    x = x.filter((F.col("_left") > 0) & (F.col("_right") > 0) & (F.col("_least") <= limit) & F.col("_in") & (F.col("n") <= limit))
    x = x.withColumn("_run", F.col("bin") - F.row_number().over(Window.partitionBy(*keys).orderBy("bin")))
    runs = x.groupBy(*keys, "_run").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"))
    best = runs.groupBy(*keys).agg(F.max(F.struct((F.col("last_bin") - F.col("first_bin")).alias("length"), (-F.col("first_bin")).alias("o"), "first_bin", "last_bin")).alias("r"))
    return best.select(*keys, "r.first_bin", "r.last_bin").filter((F.col("last_bin") - F.col("first_bin") + 1) * BIN >= LEAST_VALLEY)


def page_columns(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """page_left, split_x and page_right of pages with two columns: 20 words and 200 points
    at least, a valley, and 30 % of the words on either side."""
    pages = extents(words, keys).filter((F.col("n_words") >= LEAST_WORDS) & (F.col("page_right") - F.col("page_left") >= LEAST_WIDTH))
    found = pages.join(valleys(coverage(words.join(pages.select(*keys), list(keys), "left_semi"), keys), keys), list(keys))
    found = found.withColumn("split_x", F.col("page_left") + (F.col("first_bin") + F.col("last_bin") + 1) / 2 * BIN)
    sides = words.join(found, list(keys)).groupBy(*keys, "page_left", "split_x", "page_right").agg(F.count_if(F.col("x") + F.col("w") / 2 < F.col("split_x")).alias("left"), F.count("*").alias("n"))
    return sides.filter(F.least(F.col("left"), F.col("n") - F.col("left")) / F.col("n") >= LEAST_SIDE).select(*keys, "page_left", "split_x", "page_right")


def in_columns(words: DataFrame, columns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Words with their column: 0 up to the split, which counts to it, else 1, by their left
    edge; pages of one column have 0."""
    x = words.join(columns.select(*keys, "split_x"), list(keys), "left")
    return x.withColumn("column", F.when(F.col("x") > F.col("split_x"), 1).otherwise(0)).drop("split_x")


def text_lines(words: DataFrame, keys: Sequence[str], tie: str = "word") -> DataFrame:
    """Lines of a page: words near the running mean of y, parted again at gaps over 300;
    two spaces where a gap is over twice the width of the word before it. Columns y, min_x,
    max_x, n_words, text; part numbers the pieces of one line."""
    placed = words.join(lines(words, keys, tie=tie), [*keys, tie])
    y = placed.groupBy(*keys, "line").agg(F.avg("y").alias("y"))
    order = Window.partitionBy(*keys, "line").orderBy("x", tie)
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(order)
    x = placed.withColumn("_gap", gap).withColumn("_wide", F.lag("w").over(order) * 2)
    x = x.withColumn("part", F.coalesce(F.sum(F.when(F.col("_gap") > LINE_GAP, 1).otherwise(0)).over(order), F.lit(0)))
    space: Column = F.when(F.col("_gap").isNull() | (F.col("_gap") > LINE_GAP), "").when(F.col("_gap") > F.col("_wide"), "  ").otherwise(" ")
    item = F.struct("x", F.col(tie).alias("id"), F.concat(space, F.coalesce("text", F.lit(""))).alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["t"]), "")
    out = x.groupBy(*keys, "line", "part").agg(F.min("x").alias("min_x"), F.max(F.col("x") + F.col("w")).alias("max_x"), F.count("*").alias("n_words"), text.alias("text"))
    return out.join(y, [*keys, "line"])
