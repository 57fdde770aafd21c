"""Positioned words from nested markup (pages, lines, words with boxes in points), whole
texts with form feeds, and boxes mapped to the pixels of an image."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.functions.document import WS, stripped

#: What stands in a tag behind its name: values in quotes may hold a ">".
_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Character references resolved; Spark has no function that knows the named ones."""
    return text.map(lambda t: unescape(t) if t and "&" in t else t)


def attribute(tag: Column, name: str) -> Column:
    """A number in a tag's attributes, in quotes or not; 0 where it is missing or no number."""
    found = F.regexp_extract(tag, rf"""(?i)(?:^|[\s"'/]){name}\s*=\s*["']?\s*([^"'\s>]*)""", 1)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def opened(markup: Column, tag: str) -> Column:
    """What follows each opening tag up to the next one: its attributes, ">" and the rest.
    Comments are no markup."""
    return F.slice(F.split(markup, rf"(?i)<{tag}(?=[\s>/])"), 2, 2147483647)


def head(part: Column) -> Column:
    return F.regexp_extract(part, rf"^({_ATTRIBUTES})>", 1)


def body(part: Column, tag: str) -> Column:
    """The inside of an element up to its closing tag; null where that is missing."""
    inside = F.regexp_replace(part, rf"^{_ATTRIBUTES}>", "")
    closed = F.split(inside, rf"(?i)</{tag}\s*>", 2)
    return F.when(F.size(closed) > 1, F.element_at(closed, 1))


def on_image(x0: Column, y0: Column, x1: Column, y1: Column, page_height: Column, rect: dict[str, Column], size: tuple[Column, Column]) -> Column:
    """A box in points from the top, clipped to a rectangle of the page (left, bottom, width,
    height in points, counted from the bottom) and scaled to an image of that rectangle.
    Null outside of it, or where the rectangle is empty."""
    left, top = rect["left"], page_height - rect["bottom"] - rect["height"]
    right, end = left + rect["width"], top + rect["height"]
    inside = (rect["width"] > 0) & (rect["height"] > 0) & (x1 > left) & (x0 < right) & (y1 > top) & (y0 < end)
    sx = lambda v: (v - left) * size[0] / rect["width"]
    sy = lambda v: (v - top) * size[1] / rect["height"]
    box = F.struct(sx(F.greatest(x0, left)).alias("x0"), sy(F.greatest(y0, top)).alias("y0"), sx(F.least(x1, right)).alias("x1"), sy(F.least(y1, end)).alias("y1"))
    return F.when(inside, box)


def markup_words(docs: DataFrame, markup: str = "markup") -> DataFrame:
    """One row a word: the other columns of docs, page, line and word (from 0, in order),
    text, x0, y0, x1, y1 in points, page_width, page_height.

    A line that a second opening tag breaks off, and a word or line without its end, say
    nothing. Pages end at the next one where they aren't closed. Pages without a positive
    size and words without text go, as do words outside of lines. Null markup has no rows."""
    keep = [c for c in docs.columns if c != markup]
    plain = F.regexp_replace(markup, r"(?s)<!--.*?-->", "")
    pages = docs.select(*keep, F.posexplode(opened(plain, "page")).alias("page", "_p"))
    pages = pages.select(*keep, "page", attribute(head(F.col("_p")), "width").alias("page_width"), attribute(head(F.col("_p")), "height").alias("page_height"), F.split("_p", r"(?i)</page\s*>", 2)[0].alias("_p"))
    pages = pages.filter("page_width > 0 AND page_height > 0")
    lines = pages.select(*keep, "page", "page_width", "page_height", F.posexplode(opened(F.col("_p"), "line")).alias("line", "_l"))
    lines = lines.withColumn("_l", body(F.col("_l"), "line")).filter(F.col("_l").isNotNull())
    words = lines.select(*keep, "page", "line", "page_width", "page_height", F.posexplode(opened(F.col("_l"), "word")).alias("word", "_w"))
    words = words.withColumn("text", body(F.col("_w"), "word")).filter(F.col("text").isNotNull())
    box = {b: attribute(head(F.col("_w")), a) for a, b in (("xmin", "x0"), ("ymin", "y0"), ("xmax", "x1"), ("ymax", "y1"))}
    words = words.withColumns(box).drop("_w").withColumn("text", unescaped(F.regexp_replace("text", r"<[^>]*>", "")))
    words = words.withColumn("text", stripped(F.regexp_replace("text", f"{WS}+", " "))).filter("text <> ''")
    return words.select(*keep, "page", "line", "word", "text", "x0", "y0", "x1", "y1", "page_width", "page_height")


def native_spans(words: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """Words on the images of their pages, in pixels. images: keys, width, height, and left,
    bottom, rect_width, rect_height, the rectangle of the page that it shows (nulls: all of
    it). Words beyond the rectangle go."""
    x = words.join(images, keys)
    some = F.col("rect_width").isNotNull()
    whole = {"left": F.lit(0.0), "bottom": F.lit(0.0), "width": F.col("page_width"), "height": F.col("page_height")}
    rect = {n: F.when(some, F.col(c)).otherwise(whole[n]) for n, c in (("left", "left"), ("bottom", "bottom"), ("width", "rect_width"), ("height", "rect_height"))}
    box = on_image(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), F.col("page_height"), rect, (F.col("width"), F.col("height")))
    at = [c for c in words.columns if c not in ("x0", "y0", "x1", "y1", "page_width", "page_height")]
    return x.withColumn("_b", box).filter(F.col("_b").isNotNull()).select(*at, "_b.*")


def text_pages(docs: DataFrame, text: str = "text") -> DataFrame:
    """Whole texts with form feeds -> page (from 1) and its stripped text; blank pages go but
    count. Null text has no rows."""
    keep = [c for c in docs.columns if c != text]
    x = docs.select(*keep, F.posexplode(F.split(text, "\f")).alias("_n", "_t"))
    return x.select(*keep, (F.col("_n") + 1).alias("page"), stripped(F.col("_t")).alias("text")).filter("text <> ''")
