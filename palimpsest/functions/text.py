"""Text scalars as Column expressions: quality, normal forms, classes, escapes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

# Thresholds and reasons of the text-layer classification.
GLYPH_LOSS_LIMIT = 0.03


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition, which Spark has no function for."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def metric_text(text: Column) -> Column:
    """Form in which texts are compared: NFC, no-break space as space, one space for
    runs of blanks, at most one empty line, no white space at the ends."""
    x = F.regexp_replace(nfc(text), " ", " ")
    x = F.regexp_replace(F.regexp_replace(x, "[ \\t]+", " "), "\\n{3,}", "\n\n")
    return F.regexp_replace(x, "^\\s+|\\s+$", "")


def glyph_loss(text: Column) -> Column:
    """Share of characters that stand for lost glyphs: U+FFFD, the white square, and
    three for each run of three question marks."""
    lost = F.length(text) - F.length(F.translate(text, "�□", "")) + 3 * F.regexp_count(text, F.lit("\\?\\?\\?"))
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(lost / F.length(text))


def control_ratio(text: Column) -> Column:
    """Share of control characters other than line end, return and tab."""
    n = F.regexp_count(text, F.lit("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"))
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(n / F.length(text))


def error_rate(got: Column, wanted: Column) -> Column:
    """Edits for each expected character; may exceed 1."""
    return F.levenshtein(got, wanted) / F.greatest(F.length(wanted), F.lit(1))


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def sorted_lines(text: Column) -> Column:
    """Non-blank lines, without blanks at their ends, in sorted order: errors that ignore line order."""
    bare = lambda x: F.regexp_replace(x, r"^\p{Zs}+|\p{Zs}+\z", "")
    lines = F.filter(F.transform(F.split(text, "\n"), bare), lambda x: F.length(x) > 0)
    return F.array_join(F.array_sort(lines), "\n")


@F.pandas_udf(LongType())
def token_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits between two arrays of words; Spark's levenshtein takes strings only."""

    def edits(x: list, y: list) -> int:
        row = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            above, row[0] = row[0], i
            for j, q in enumerate(y, 1):
                above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (p != q))
        return row[-1]

    return pd.Series([edits(list(x), list(y)) for x, y in zip(a, b)])


def words(text: Column) -> Column:
    return F.filter(F.split(text, "(?U)\\s+"), lambda x: F.length(x) > 0)


def comparison_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, "(?U)\\W+", ""))


def markdown(text: Column) -> Column:
    """Escape inline marks anywhere, and block marks at line starts."""
    inline = F.regexp_replace(text, r"([\\`*_\[\]<>|])", r"\\$1")
    return F.regexp_replace(inline, r"(?m)^(\s*)([#+-]|\d+\.)(?=\s)", r"$1\\$2")


def markdown_cell(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\|", r"\\|"), "\\s*\\n\\s*", " ")


def yaml_quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(text, r'([\\"])', r"\\$1"), "\\n", " "), F.lit('"'))


def key_value(line: Column) -> Column:
    return line.rlike("^[^:]{3,40}:\\s+.+$") & (F.length(line) < 120)


def preformatted(line: Column) -> Column:
    """Box drawing or code marks, three at least."""
    return F.regexp_count(line, F.lit("[─-╿{};]")) >= 3


def heading_level(line: Column) -> Column:
    """h1, h2, h3 or null, by numbering and capitals."""
    letters = F.regexp_count(line, F.lit("\\p{L}"))
    capitals = F.regexp_count(line, F.lit("\\p{Lu}"))
    short = (F.length(line) >= 3) & (F.length(line) <= 80)
    return (
        F.when(~short | line.rlike("[.;,:]$"), F.lit(None))
        .when((letters >= 3) & (capitals == letters), "h1")
        .when(line.rlike("^\\d+\\.\\s+\\p{Lu}"), "h2")
        .when(line.rlike("^\\d+(\\.\\d+)+\\.?\\s+\\p{Lu}"), "h3")
    )


def line_class(line: Column) -> Column:
    """preformatted before heading before kv before indent before paragraph."""
    return (
        F.when(preformatted(line), "preformatted")
        .when(heading_level(F.trim(line)).isNotNull(), "heading")
        .when(key_value(F.trim(line)), "kv")
        .when(line.rlike("^\\s{4,}\\S"), "indent")
        .otherwise("paragraph")
    )


def searchable(text: Column) -> Column:
    return F.when(F.trim(text) == "", "empty").when(glyph_loss(text) > GLYPH_LOSS_LIMIT, "glyph_loss").otherwise("ok")


def text_layer(df: DataFrame) -> DataFrame:
    """Trust in native text layers (columns text and area): status absent, rejected
    or trusted, and the first reason that fails. Each measure is a column of its own,
    so that none is computed once for each rule."""
    x = df.withColumn("_plain", F.trim(F.regexp_replace("text", "(?U)\\s+", " "))).withColumn("_words", F.split("_plain", " "))
    x = x.withColumns({
        "_n": F.length("_plain"),
        "_lost": glyph_loss(F.col("_plain")),
        "_control": control_ratio(F.col("text")),
        "_letters": F.length(F.regexp_replace("_plain", "[^\\p{L}\\p{N}]+", "")),
        "_all": F.size("_words"),
        "_distinct": F.size(F.array_distinct("_words")),
    })
    c = F.col
    reason = (
        F.when(c("_n") == 0, "empty")
        .when(c("_n") < 20, "too_short")
        .when(c("_lost") > GLYPH_LOSS_LIMIT, "glyph_loss")
        .when(c("_control") > 0.01, "control_characters")
        .when(c("_letters") < 0.5 * c("_n"), "few_letters")
        .when(c("_distinct") < 0.1 * c("_all"), "repetitive")
        .when((c("area") > 0) & (c("_n") / c("area") * 10000 < 0.5), "sparse")
    )
    x = x.withColumn("reason", F.coalesce(reason, F.lit("ok")))
    status = F.when(c("_n") == 0, "absent").when(c("reason") != "ok", "rejected").otherwise("trusted")
    return x.withColumn("status", status).drop("_plain", "_words", "_n", "_lost", "_control", "_letters", "_all", "_distinct")


def human_size(n: Column) -> Column:
    """Bytes with 1024-based units; one decimal above 1023 bytes, halves to even."""
    x = n.cast("double")
    step = lambda power, unit: F.format_string("%.1f " + unit, F.bround(x / 1024**power, 1))
    return F.when(x < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(x < 1024**2, step(1, "KB")).when(x < 1024**3, step(2, "MB")).otherwise(step(3, "GB"))


def elapsed(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def size_bytes(text: Column) -> Column:
    """12, 12K, 1.5M, 2GB -> bytes; null if malformed."""
    number = F.regexp_extract(F.upper(F.trim(text)), "^(\\d+(?:\\.\\d+)?)\\s*([KMG]?)B?$", 1)
    unit = F.regexp_extract(F.upper(F.trim(text)), "^(\\d+(?:\\.\\d+)?)\\s*([KMG]?)B?$", 2)
    scale = F.when(unit == "K", 1024).when(unit == "M", 1024**2).when(unit == "G", 1024**3).otherwise(1)
    return F.when(number != "", F.floor(number.cast("double") * scale).cast("long"))


def hits(text: Column, needle: Column) -> Column:
    """Occurrences that don't overlap, whatever the case; an empty needle has none."""
    gone = F.length(F.replace(F.lower(text), F.lower(needle), F.lit("")))
    return F.when(F.length(needle) == 0, F.lit(0)).otherwise(((F.length(text) - gone) / F.length(needle)).cast("long"))


def utf16_hex(text: Column) -> Column:
    return F.hex(F.encode(text, "UTF-16BE"))


def four_digits(x: Column) -> Column:
    return F.format_string("%.4g", x)
