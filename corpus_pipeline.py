"""From raw documents to packed sequences: toxicity, exact dedup, near-duplicate
dedup, removal of repeated passages, packing. Each stage is one of the operators of
palimpsest.llm, works on all rows that its predecessor kept, and is written as
Parquet in the shared folder and read again for the next. Decisions come back to the
rows by a key of each row, as a doc_id may be null or stand in several rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import exact, neardup, packing, suffix, toxicity
from palimpsest.llm.common import heaps_returned, keyed, merged, written

#: The column of row keys within a stage.
ROW = "_row"


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return merged(toxicity.keep(docs, model))


def keep_one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id."""
    heaps_returned(spark)
    x = keyed(docs, ROW)
    chosen = exact.exact_dedup(x, key=ROW).filter("kept").select(ROW)
    return merged(x.join(chosen, ROW, "left_semi").select(*docs.columns))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    heaps_returned(spark)
    x = keyed(docs, ROW)
    chosen = neardup.near_duplicates(x, key=ROW).filter("kept").select(ROW)
    return merged(x.join(chosen, ROW, "left_semi").select(*docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 100 bytes or more that stand earlier; a
    character that a cut halves goes with the passage."""
    heaps_returned(spark)
    x = keyed(docs, ROW)
    left = suffix.remove_repeats(x, length=100, key=ROW).filter("n_removed > 0").select(ROW, suffix.text_of_bytes("kept").alias("_left"))
    x = x.join(left, ROW, "left")
    return merged(x.select(*(F.coalesce("_left", "text").alias("text") if c == "text" else F.when(F.col("_left").isNull(), F.col(c)).otherwise(F.length("_left")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns)))


def pack_all(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of 1024 tokens."""
    heaps_returned(spark)
    return merged(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, length=1024))


STAGES = [
    ("toxicity", keep_clean),
    ("exact_dedup", keep_one_of_equal),
    ("near_dedup", keep_one_of_near),
    ("suffix_dedup", cut_repeats),
    ("packing", pack_all),
]

#: No SQL for a random field, sampled near-duplicates and packing; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
