"""Lines to paragraphs, tables and reflowed text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.operators.layout import islands

# Gaps between groups of a table line, and the longest usual cell.
TABLE_GAP, WIDEST_GAP, CELL_LENGTH = 100, 200, 14


def table_lines(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """groups (keys, x0, x1): lines of three groups or more, or of two that stand at
    least 100 apart; a gap over 200 makes a line no table line."""
    gap = F.col("x0") - F.lag("x1").over(Window.partitionBy(*keys).orderBy("x0"))
    x = groups.withColumn("_gap", gap).groupBy(*keys).agg(F.count("*").alias("n"), F.max("_gap").alias("widest"))
    fits = (F.coalesce("widest", F.lit(0)) <= WIDEST_GAP) & ((F.col("n") >= 3) | ((F.col("n") == 2) & (F.col("widest") >= TABLE_GAP)))
    return x.select(*keys, "n", fits.alias("is_table"))


def short_cells(cells: Column) -> Column:
    """Whether the upper median of the cells' lengths is at most 14."""
    sizes = F.array_sort(F.transform(cells, F.length))
    return F.coalesce(F.get(sizes, F.floor(F.size(sizes) / 2).cast("int")) <= CELL_LENGTH, F.lit(False))


def paragraphs(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """lines (keys, line, y, h, text): a line opens a paragraph if it stands more than
    twice the last line's height below it."""
    order = Window.partitionBy(*keys).orderBy("line")
    new = F.lag("y").over(order).isNull() | (F.col("y") - F.lag("y").over(order) > 2 * F.lag("h").over(order))
    x = islands(lines.withColumn("_new", new), keys, ["line"], F.col("_new"), "paragraph")
    item = F.struct("line", "text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["text"]), " ")
    return x.groupBy(*keys, "paragraph").agg(F.regexp_replace(F.trim(text), " {2,}", " ").alias("text"), F.min("y").alias("y"), F.count("*").alias("n_lines"))


def reflowed(text: Column) -> Column:
    """Lines joined where one ends with a hyphen between letters, or goes on without
    a full stop into a line that begins in lower case; empty lines part paragraphs.
    One fold over the lines."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))  # by itself, trim would take the index for what to cut

    def step(out: Column, line: Column) -> Column:
        hyphen = out.rlike("\\p{L}-$") & line.rlike("^\\p{Ll}")
        goes_on = out.rlike("[^.!?:\\n]$") & line.rlike("^\\p{Ll}")
        return F.when(out == "", line).when(hyphen, F.concat(F.regexp_replace(out, "-$", ""), line)).when(goes_on, F.concat(out, F.lit(" "), line)).otherwise(F.concat(out, F.lit("\n"), line))

    return F.aggregate(lines, F.lit(""), step)


def cursor(tokens: DataFrame, keys: Sequence[str], width: str = "width", gap: int = 6) -> DataFrame:
    """x of each token of a line: widths and gaps of those before it."""
    before = Window.partitionBy(*keys).orderBy("token").rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("x", F.coalesce(F.sum(F.col(width) + gap).over(before), F.lit(0)))


def cross_page(paragraphs_: DataFrame, doc: str = "doc") -> DataFrame:
    """Whether a page's last paragraph goes on on the next page: it ends with a comma
    or dash, and the next page's first paragraph begins in lower case."""
    x = paragraphs_.groupBy(doc, "page").agg(F.min_by("text", "pos").alias("first"), F.max_by("text", "pos").alias("last"))
    after = F.lead("first").over(Window.partitionBy(doc).orderBy("page"))
    return x.select(doc, "page", F.coalesce(F.col("last").rlike("[,–—-]\\s*$") & after.rlike("^\\s*\\p{Ll}"), F.lit(False)).alias("goes_on"))
