"""Page sets: a document's pages as rows (doc, pos, ...), pos from 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def renumbered(pages: DataFrame, *by: Column | str, doc: str = "doc") -> DataFrame:
    return pages.withColumn("pos", F.row_number().over(Window.partitionBy(doc).orderBy(*by)).cast("long"))


def deleted(pages: DataFrame, gone: DataFrame, doc: str = "doc") -> DataFrame:
    """Without the listed (doc, pos); a document that would lose all its pages stays."""
    left = pages.join(gone.select(doc, "pos").distinct().withColumn("_gone", F.lit(True)), [doc, "pos"], "left")
    keeps = F.count_if(F.col("_gone").isNull()).over(Window.partitionBy(doc))
    left = left.withColumn("_keeps", keeps)
    return renumbered(left.filter(F.col("_gone").isNull() | (F.col("_keeps") == 0)).drop("_gone", "_keeps"), "pos", doc=doc)


def deletions(pages: DataFrame, gone: DataFrame, doc: str = "doc") -> DataFrame:
    """What deleting the listed (doc, pos) does to each document that is listed: ok, n_deleted
    and n_left; refused with a reason where no listed page exists or none would be left.
    A document that is listed but has no pages is refused, too."""
    at = pages.select(doc, "pos").withColumn("_there", F.lit(True))
    listed = gone.select(doc, "pos").distinct().withColumn("_listed", F.lit(True))
    x = at.join(listed, [doc, "pos"], "full").groupBy(doc).agg(F.count("_there").alias("_n"), F.count("_listed").alias("_asked"), F.count_if(F.col("_there") & F.col("_listed")).alias("_gone"))
    reason = F.when(F.col("_gone") == 0, "no valid pages").when(F.col("_gone") >= F.col("_n"), "all pages")
    x = x.filter("_asked > 0").withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return x.select(doc, ok.alias("ok"), "reason", F.when(ok, F.col("_gone")).otherwise(0).alias("n_deleted"), F.when(ok, F.col("_n") - F.col("_gone")).otherwise(F.col("_n")).alias("n_left"))


def selected(pages: DataFrame, wanted: DataFrame, doc: str = "doc") -> DataFrame:
    """Pages in the order given: wanted has (doc, turn, pos); pages may repeat or be
    left out; positions that don't exist are ignored."""
    return renumbered(wanted.join(pages, [doc, "pos"]).drop("pos"), "turn", doc=doc).drop("turn")


def inserted(pages: DataFrame, new: DataFrame, at: Column, doc: str = "doc") -> DataFrame:
    """New pages (same columns) before position `at` (a column of pages); 0 or beyond
    the end appends."""
    n = F.max("pos").over(Window.partitionBy(doc))
    old = pages.withColumn("_at", at).withColumn("_n", n)
    where = old.groupBy(doc).agg(F.first("_at").alias("_at"), F.first("_n").alias("_n")).withColumn("_at", F.when((F.col("_at") < 1) | (F.col("_at") > F.col("_n")), F.col("_n") + 1).otherwise(F.col("_at")))
    a = pages.withColumn("_key", F.col("pos") * 2.0).withColumn("_sub", F.lit(0).cast("long"))
    b = new.join(where, doc).withColumn("_key", F.col("_at") * 2.0 - 1).withColumn("_sub", F.col("pos")).drop("_at", "_n")
    return renumbered(a.unionByName(b), "_key", "_sub", doc=doc).drop("_key", "_sub")


def merged(parts: Sequence[DataFrame], doc: str = "doc") -> DataFrame:
    """All pages of the first, then of the second, and so on."""
    out = None
    for i, x in enumerate(parts):
        x = x.withColumn("_part", F.lit(i))
        out = x if out is None else out.unionByName(x)
    return renumbered(out, "_part", "pos", doc=doc).drop("_part")


def rotated(pages: DataFrame, listed: DataFrame, angle: int, doc: str = "doc") -> DataFrame:
    """Turn each listed page once, however often it is listed."""
    once = listed.select(doc, "pos").distinct().withColumn("_turn", F.lit(True))
    x = pages.join(once, [doc, "pos"], "left")
    return x.withColumn("rotation", F.when(F.col("_turn"), F.pmod(F.col("rotation") + angle, F.lit(360))).otherwise(F.col("rotation"))).drop("_turn")


def fixed_parts(pages: DataFrame, size: int) -> DataFrame:
    return pages.withColumn("part", F.floor((F.col("pos") - 1) / size).cast("long"))


def range_parts(pages: DataFrame, ranges: Sequence[tuple[int, int]], doc: str = "doc") -> DataFrame:
    """Parts by ranges that may overlap; ends are clamped, empty ranges give none."""
    given = F.array(*(F.struct(F.lit(i).alias("part"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(ranges) if a <= b))
    fits = F.filter(given, lambda r: (F.col("pos") >= r["a"]) & (F.col("pos") <= r["b"]))
    return pages.withColumn("_r", F.explode(fits)).withColumn("part", F.col("_r.part")).drop("_r")


def size_parts(pages: DataFrame, size: str, most: int, doc: str = "doc") -> DataFrame:
    """Next-fit: a part is closed when the next page would take it beyond `most`; a
    page that is larger by itself has its own. One fold over a document's sizes."""
    item = F.struct("pos", F.col(size).cast("long").alias("s"))
    zero = F.expr("named_struct('part', cast(0 as bigint), 'sum', cast(0 as bigint), 'n', 0, 'out', cast(array() as array<struct<pos:bigint,part:bigint>>))")

    def step(s: Column, p: Column) -> Column:
        full = (s["n"] > 0) & (s["sum"] + p["s"] > most)
        part = F.when(full, s["part"] + 1).otherwise(s["part"])
        return F.struct(part.alias("part"), F.when(full, p["s"]).otherwise(s["sum"] + p["s"]).alias("sum"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"), F.concat(s["out"], F.array(F.struct(p["pos"].alias("pos"), part.alias("part")))).alias("out"))

    folded = pages.groupBy(doc).agg(F.array_sort(F.collect_list(item)).alias("ps")).select(doc, F.explode(F.aggregate("ps", zero, step, lambda s: s["out"])).alias("o"))
    return folded.select(doc, F.col("o.pos").alias("pos"), F.col("o.part").alias("part"))


def modified(pages: DataFrame, changes: DataFrame, doc: str = "doc") -> DataFrame:
    """Left join with edits; the last edit of a page (by turn) holds; defaults are no
    turn, not deleted, included."""
    last = Window.partitionBy(doc, "pos").orderBy(F.desc("turn"))
    one = changes.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r", "turn")
    return pages.join(one, [doc, "pos"], "left").withColumns({"rotation": F.coalesce("rotation", F.lit(0)), "deleted": F.coalesce("deleted", F.lit(False)), "included": F.coalesce("included", F.lit(True))})


def page_list(text: Column) -> Column:
    """'1-5,7' -> sorted distinct page numbers."""
    parts = F.transform(F.split(text, ","), lambda p: F.split(F.trim(p), "-"))
    each = F.transform(parts, lambda p: F.sequence(F.get(p, 0).cast("int"), F.coalesce(F.get(p, 1), F.get(p, 0)).cast("int")))
    return F.array_sort(F.array_distinct(F.flatten(each)))
