"""Sources: tab-separated words, nested region documents, markup with positions,
records as JSON lines, binary files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.document import stripped

# Fixed value: the columns of a word table.
WORD_SCHEMA = (
    "level string, page_num string, block_num string, par_num string, line_num string, word_num string, "
    "left string, top string, width string, height string, conf string, text string"
)


def words_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Words (level 5) with numbers cast; rows with a malformed number or no text go."""
    raw = spark.read.schema(WORD_SCHEMA).option("sep", "\t").option("header", True).option("quote", "").csv(path)
    ints = {c: F.expr(f"try_cast({c} AS int)") for c in ("level", "page_num", "block_num", "par_num", "line_num", "word_num")}
    reals = {c: F.expr(f"try_cast({c} AS double)") for c in ("left", "top", "width", "height", "conf")}
    x = raw.withColumns(ints | reals).withColumn("text", stripped(F.col("text")))
    placed = reduce(lambda a, c: a & F.col(c).isNotNull(), ("left", "top", "width", "height"), F.col("page_num").isNotNull())
    return x.filter((F.col("level") == 5) & placed & (F.col("text") != ""))


def without_noise(words: DataFrame) -> DataFrame:
    """Drop slivers: narrower than 2 with two to four characters."""
    return words.filter(~((F.col("width") < 2) & F.length("text").between(2, 4)))


def region_problem() -> Column:
    """Why recognised arrays (boxes, txts, scores) are refused, or null: boxes are missing but
    not the others, or their lengths differ. Without boxes and others there are no regions."""
    sizes = [F.coalesce(F.size(c), F.lit(0)) for c in ("boxes", "txts", "scores")]
    n, rest = sizes[0], F.greatest(*sizes[1:])
    missing = F.col("txts").isNull() | F.col("scores").isNull()
    return F.when((n == 0) & (rest > 0), "unexpected values").when((n > 0) & missing | F.col("boxes").isNotNull() & (n == 0) & missing, "missing arrays").when((n != sizes[1]) | (n != sizes[2]), "different lengths")


def refused_regions(raw: DataFrame) -> DataFrame:
    """Rows whose arrays are refused, with the problem."""
    return raw.withColumn("problem", region_problem()).filter("problem IS NOT NULL").drop("boxes", "txts", "scores")


def regions(raw: DataFrame) -> DataFrame:
    """Arrays boxes, txts, scores -> one row a region, in their order; refused_regions
    tells which rows are left out."""
    raw = raw.filter(region_problem().isNull())
    return raw.select(*(c for c in raw.columns if c not in ("boxes", "txts", "scores")), F.posexplode(F.arrays_zip("boxes", "txts", "scores")).alias("idx", "r")).select("*", F.col("r.boxes").alias("box"), F.col("r.txts").alias("text"), F.col("r.scores").alias("confidence")).drop("r")


def elements(html: Column, tag: str) -> Column:
    """Inner texts of an element without attributes or nested elements of its name."""
    return F.transform(F.regexp_extract_all(html, F.lit(f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>"), 1), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), "\\s+", " ")))


def records_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records with a schema given, not inferred; malformed lines go to _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Binary files with their digest."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))
