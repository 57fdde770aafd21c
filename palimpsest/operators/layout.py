"""Positioned words and intervals: lines, groups, columns, gaps. All windows are
partitioned by the page's keys, so that pages are independent units of work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Y_TOLERANCE, COLUMN_GAP, LINE_GAP, BIN = 5, 15, 300, 10


def _order(keys: Sequence[str], *by: str) -> Window:
    return Window.partitionBy(*keys).orderBy(*by)


def islands(df: DataFrame, keys: Sequence[str], by: Sequence[str], starts: Column, name: str) -> DataFrame:
    """Number the runs that begin where `starts` holds, from 0, in the given order."""
    order = _order(keys, *by)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)


def word_groups(words: DataFrame, keys: Sequence[str], gap: int = COLUMN_GAP, tie: str = "word") -> DataFrame:
    """Groups of words of a line, parted where the white space is over `gap`."""
    order = _order(keys, "x", tie)
    new = F.lag("x").over(order).isNull() | ((F.col("x") - F.lag(F.col("x") + F.col("w")).over(order)) > gap)
    x = words.withColumn("_new", new)
    return islands(x, keys, ["x", tie], F.col("_new"), "grp").groupBy(*keys, "grp").agg(F.count("*").alias("n_words"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"))


def lines(words: DataFrame, keys: Sequence[str], tolerance: int = Y_TOLERANCE, tie: str = "word") -> DataFrame:
    """Line number of each word: words by (y, x); a word joins the current line if its
    y is within `tolerance` of the running mean of that line's words, else it opens
    the next line. The state is one fold over a page's sorted words."""
    item = F.struct("y", "x", F.col(tie).alias("id"))
    page = words.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("ws"))
    zero = F.struct(F.lit(-1).cast("bigint").alias("line"), F.lit(0.0).alias("sum"), F.lit(0).cast("bigint").alias("n"), F.expr("cast(array() as array<struct<id:bigint,line:bigint>>)").alias("out"))

    def step(s: Column, w: Column) -> Column:
        joins = (s["n"] > 0) & (F.abs(w["y"] - s["sum"] / s["n"]) <= tolerance)
        line = F.when(joins, s["line"]).otherwise(s["line"] + 1)
        return F.struct(
            line.alias("line"),
            F.when(joins, s["sum"] + w["y"]).otherwise(w["y"].cast("double")).alias("sum"),
            F.when(joins, s["n"] + 1).otherwise(F.lit(1).cast("bigint")).alias("n"),
            F.concat(s["out"], F.array(F.struct(w["id"].cast("bigint").alias("id"), line.alias("line")))).alias("out"),
        )

    folded = page.select(*keys, F.explode(F.aggregate("ws", zero, step, lambda s: s["out"])).alias("o"))
    return folded.select(*keys, F.col("o.id").alias(tie), F.col("o.line").alias("line"))


def coverage(spans: DataFrame, keys: Sequence[str], bin_size: int = BIN) -> DataFrame:
    """How many intervals [x, x + w] touch each bin of the axis."""
    first, last = F.floor(F.col("x") / bin_size), F.floor((F.col("x") + F.col("w")) / bin_size)
    return spans.select(*keys, F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def valley(bins: DataFrame, keys: Sequence[str], threshold: int, least: int = 3, bin_size: int = BIN) -> DataFrame:
    """The longest run of neighbouring bins below the threshold, the first of equals."""
    low = bins.filter(F.col("n") < threshold)
    run = F.col("bin") - F.row_number().over(_order(keys, "bin"))
    runs = low.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min("bin").alias("first"), F.count("*").alias("bins"))
    best = Window.partitionBy(*keys).orderBy(F.desc("bins"), "first")
    return runs.withColumn("_r", F.row_number().over(best)).filter((F.col("_r") == 1) & (F.col("bins") >= least)).select(*keys, (F.col("first") * bin_size).alias("x0"), ((F.col("first") + F.col("bins")) * bin_size).alias("x1"))


def merged(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Intervals x0, x1 that overlap or touch, as one."""
    order = _order(keys, "x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    x = spans.withColumn("_new", reach.isNull() | (F.col("x0") > reach))
    return islands(x, keys, ["x0", "x1"], F.col("_new"), "_i").groupBy(*keys, "_i").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_i")


def spread_gap(spans: DataFrame, keys: Sequence[str], width: int, least: int, low: float = 0.35, high: float = 0.65) -> DataFrame:
    """The widest gap between intervals whose middle lies in the page's middle part,
    with two interval centres on either side at least; pages of fewer than four
    intervals have none."""
    joined = merged(spans, keys)
    gaps = joined.withColumn("next", F.lead("x0").over(_order(keys, "x0"))).filter(F.col("next").isNotNull()).select(*keys, F.col("x1").alias("gap0"), F.col("next").alias("gap1"))
    middle = (F.col("gap0") + F.col("gap1")) / 2
    gaps = gaps.filter((F.col("gap1") - F.col("gap0") >= least) & (middle >= low * width) & (middle <= high * width))
    best = Window.partitionBy(*keys).orderBy(F.desc(F.col("gap1") - F.col("gap0")), "gap0")
    gaps = gaps.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")
    centre = (F.col("x0") + F.col("x1")) / 2
    sides = spans.join(gaps, list(keys)).groupBy(*keys, "gap0", "gap1").agg(F.count_if(centre <= F.col("gap0")).alias("left"), F.count_if(centre >= F.col("gap1")).alias("right"), F.count("*").alias("n"))
    return sides.filter("left >= 2 and right >= 2 and n >= 4").select(*keys, "gap0", "gap1", "left", "right")


def logical_pages(pages: DataFrame, doc: str = "doc", page: str = "page", split: str = "split") -> DataFrame:
    """First logical number of each page: a spread counts as two."""
    order = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("logical", F.coalesce(F.sum(F.when(F.col(split), 2).otherwise(1)).over(order), F.lit(0)) + 1)


def spread_boxes(boxes: DataFrame, doc: str = "doc", page: str = "page") -> DataFrame:
    """Boxes in percent of their pages (doc, page, id, x, width and more) on logical pages: a
    page with a clear gap in its middle becomes two, and the boxes of each half, told by their
    centres, are stretched to a whole page. Adds logical and gap (null: not a spread). Only
    pages with boxes count; a box that crosses the gap goes with its centre."""
    gaps = spread_gap(boxes.select(doc, page, F.col("x").alias("x0"), (F.col("x") + F.col("width")).alias("x1")), [doc, page], 100, 4)
    gaps = gaps.select(doc, page, ((F.col("gap0") + F.col("gap1")) / 2).alias("gap"))
    pages = boxes.select(doc, page).distinct().join(gaps, [doc, page], "left").withColumn("split", F.col("gap").isNotNull())
    x = boxes.join(logical_pages(pages, doc, page).drop("split"), [doc, page])
    gap = F.col("gap")
    right = F.coalesce(F.col("x") + F.col("width") / 2 >= gap, F.lit(False))
    scale = F.when(gap.isNull(), 1.0).when(right, 100.0 / (100.0 - gap)).otherwise(100.0 / gap)
    start = F.when(right, F.col("x") - gap).otherwise(F.col("x"))
    return x.withColumns({"logical": (F.col("logical") + right.cast("int")).cast("long"), "x": start * scale, "width": F.col("width") * scale})


def spread_text(boxes: DataFrame, doc: str = "doc") -> DataFrame:
    """Texts of documents with spreads, logical page by logical page, lines by y; boxes as
    spread_boxes gives them. Documents without a spread keep the text they have: no row."""
    by_page = assembled(boxes, [doc, "logical"], ["y", "id"], "text", "\n").drop("n_parts")
    some = boxes.filter("gap IS NOT NULL").select(doc).distinct()
    return assembled(by_page.join(some, doc, "left_semi"), [doc], ["logical"], "text", "\n\n").withColumnRenamed("n_parts", "n_pages")


def assembled(parts: DataFrame, keys: Sequence[str], by: Sequence[str], text: str, separator: str) -> DataFrame:
    """Ordered text of each group; the order's last key is unique."""
    item = F.struct(*by, F.col(text).alias("_t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["_t"]), separator)
    return parts.groupBy(*keys).agg(joined.alias("text"), F.count("*").alias("n_parts"))
