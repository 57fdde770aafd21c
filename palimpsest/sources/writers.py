"""Sinks: text and Markdown for each document, records as JSON lines, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import markdown


def markdown_blocks(blocks: DataFrame, doc: str = "doc", order: str = "pos") -> DataFrame:
    """blocks (doc, pos, kind, text) -> one Markdown text a document."""
    mark = F.when(F.col("kind") == "h1", "# ").when(F.col("kind") == "h2", "## ").when(F.col("kind") == "h3", "### ").otherwise("")
    body = F.when(F.col("kind") == "preformatted", F.concat(F.lit("```\n"), "text", F.lit("\n```"))).otherwise(F.concat(mark, markdown(F.col("text"))))
    item = F.struct(F.col(order).alias("o"), body.alias("b"))
    return blocks.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["b"]), "\n\n").alias("markdown"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_text(df: DataFrame, path: str, by: str, text: str = "text") -> None:
    """One folder a value of `by`; rows of one value stand in one task's file only as
    far as they were so before, so that a common value is not one task's work."""
    df.select(by, text).write.mode("errorifexists").partitionBy(by).text(path)
