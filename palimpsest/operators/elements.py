"""Words of pages to elements: headings, fields, paragraphs, preformatted lines, tables.

Pages are dealt once and stream through their tasks; each is one walk over its words in
`walks`. A page is the unit of work. The rules in Spark's functions need its words several
times, with a join or a shuffle each, which is many times the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from palimpsest.operators.columns import page_columns as page_columns
from palimpsest.operators.walks import SPLIT_GAP, page_walk, paged

PAGE = ("doc", "page")
SLIVER, SLIVER_LENGTHS = 2.0, (2, 4)
ELEMENT = (
    StructType().add("seq", IntegerType()).add("kind", StringType()).add("text", StringType()).add("raw_lines", ArrayType(StringType()))
    .add("cells", ArrayType(ArrayType(StringType()))).add("indent", IntegerType()).add("y_top", DoubleType())
)


def clean(words: DataFrame) -> DataFrame:
    """Without slivers: boxes narrower than 2 points that hold two to four characters."""
    return words.filter(~((F.col("w") < SLIVER) & F.length("text").between(*SLIVER_LENGTHS)))


def parted(group: Column, bounds: Column) -> Column:
    """A group's words in pieces: one that crosses a boundary is parted at the gap nearest
    to the first boundary that it crosses, and its pieces again, the left one first. A
    work list, as there is no recursion: each step settles a piece or parts one."""
    x0, x1 = (lambda i: F.get(group, i)["x0"]), (lambda i: F.get(group, i)["x1"])
    span = "struct<lo: int, hi: int>"
    pair = lambda a, b: F.struct(a.cast("int").alias("lo"), b.cast("int").alias("hi"))

    def cut(p: Column) -> Column:
        """The place where a piece is parted, or null."""
        crossed = F.get(F.filter(bounds, lambda b: (x0(p["lo"]) < b) & (b < x1(p["hi"] - 1))), 0)
        inner = F.filter(F.sequence(p["lo"], p["hi"] - 2), lambda i: x0(i + 1) - x1(i) > SPLIT_GAP)
        far = lambda b: F.array_min(F.transform(inner, lambda i: F.struct(F.abs((x1(i) + x0(i + 1)) / 2 - b).alias("d"), (i + 1).alias("at"))))["at"]
        return F.when(p["hi"] - p["lo"] > 1, F.get(F.transform(F.array(crossed), lambda b: F.when(b.isNotNull(), far(b))), 0))

    def step(s: Column, _: Column) -> Column:
        p, rest = F.get(s["todo"], 0), F.slice(s["todo"], 2, 1 << 30)
        settled = F.struct(rest.alias("todo"), F.concat(s["done"], F.array(p)).alias("done"))
        deal = lambda at: F.when(at.isNull(), settled).otherwise(F.struct(F.concat(F.array(pair(p["lo"], at), pair(at, p["hi"])), rest).alias("todo"), s["done"].alias("done")))
        return F.when(F.size(s["todo"]) == 0, s).otherwise(F.get(F.transform(F.array(cut(p)), deal), 0))

    start = F.struct(F.array(pair(F.lit(0), F.size(group))).alias("todo"), F.expr(f"cast(array() as array<{span}>)").alias("done"))
    spans = F.aggregate(F.sequence(F.lit(1), 2 * F.size(group)), start, step, lambda s: s["done"])
    crosses = F.exists(bounds, lambda b: (x0(F.lit(0)) < b) & (b < F.element_at(group, -1)["x1"])) & (F.size(group) > 1)
    return F.when(crosses, F.transform(spans, lambda p: F.slice(group, p["lo"] + 1, p["hi"] - p["lo"]))).otherwise(F.array(group))


def page_elements(words: DataFrame) -> DataFrame:
    """doc, page, seq, kind, text, raw_lines, cells, indent, y_top of the pages' elements.

    words: doc, page, word (unique in its page), x, y, w, h, text. A page without words
    has no rows; rows without a doc or page are nowhere, and left out; a null text is
    empty, a null number 0. Words at one place come in order of `word`.
    """
    x = clean(words.select(*PAGE, "word", "x", "y", "w", "h", "text").dropna(subset=list(PAGE)))
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    x = x.select(*PAGE, *map(number, "xywh"), F.coalesce("text", F.lit("")).alias("text"), "word")
    return paged(x, PAGE, ["y", "x", "word"], ["x", "y", "w", "h", "text", "word"], page_walk, ELEMENT)


def table_cells(elements: DataFrame) -> DataFrame:
    """doc, page, seq, row, column, text of every cell of the tables among elements."""
    x = elements.filter("kind = 'table'").select(*PAGE, "seq", F.posexplode("cells").alias("row", "_cells"))
    return x.select(*PAGE, "seq", "row", F.posexplode("_cells").alias("column", "text"))
