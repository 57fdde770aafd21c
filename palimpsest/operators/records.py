"""Benchmark records: summaries of sixteen and ten measures, corpus error rates, and the
comparison of two runs record by record.

Percentiles are exact, from counts of distinct values and their running sums, so that
no group's values are gathered in one row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.operators import contract as C
from palimpsest.operators.benchmarks import worsening
from palimpsest.operators.ranks import at_rank, median, nearest_rank, rounded_index, same_group

# The identity of a record, the measures it needs, and how much worse each may get.
IDENTITY = ("benchmark_profile", "dataset", "id", "page_index", "run_index")
NUMBERS = ("char_error_rate", "word_error_rate", "end_to_end_seconds", "peak_rss_mb")
POSITIVE = ("end_to_end_seconds", "peak_rss_mb")
WORSE_LIMITS = {"char_error_rate": 0.01, "word_error_rate": 0.01, "end_to_end_seconds": 0.20, "peak_rss_mb": 0.20}


def percent(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total * 100.0).otherwise(0.0)


def micro(distance: str, expected: str) -> Column:
    """All edits for each expected unit, over rows that have both; null without any."""
    both = F.col(distance).isNotNull() & F.col(expected).isNotNull()
    total = F.sum(F.when(both, F.col(expected)))
    return F.when(total > 0, F.sum(F.when(both, F.col(distance))) / total)


def ok_ratio(flag: Column) -> Column:
    """Share of all rows for which the flag holds; null counts as not."""
    return F.count_if(F.coalesce(flag, F.lit(False))) / F.count("*")


def truthy(text: Column) -> Column:
    return F.coalesce(F.length(text) > 0, F.lit(False))


def with_columns(base: DataFrame, keys: Sequence[str], more: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: same_group(a, b, keys, "left"), more, base)


def summary(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sixteen measures of each group of records."""
    x = records.groupBy(*keys).agg(
        F.count("*").alias("pages"),
        F.count_if(~truthy(F.col("failure_reason"))).alias("successful_pages"),
        F.count_if(truthy(F.col("failure_reason"))).alias("failed_pages"),
        F.count_if(F.coalesce("text_layer_ok", F.lit(False))).alias("text_layer_ok_pages"),
        F.avg("char_error_rate").alias("mean_cer"),
        micro("char_edit_distance", "expected_char_count").alias("micro_cer"),
        F.avg("word_error_rate").alias("mean_wer"),
        micro("word_edit_distance", "expected_word_count").alias("micro_wer"),
        F.avg("levenshtein_ratio").alias("mean_levenshtein_ratio"),
        F.avg("end_to_end_seconds").alias("mean_seconds_page"),
        F.max("peak_rss_mb").alias("peak_rss_mb"),
        F.avg("pdf_output_size_bytes").alias("mean_pdf_size_bytes"),
    )
    x = x.withColumn("text_layer_ok_percent", percent(F.col("text_layer_ok_pages"), F.col("pages")))
    return with_columns(x, keys, [median(records, keys, "end_to_end_seconds", "median_seconds_page"), at_rank(records, keys, "end_to_end_seconds", rounded_index(0.95), "p95_seconds_page")])


def comparison_summary(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ten measures of each run."""
    x = records.groupBy(*keys).agg(
        F.count("*").alias("pages"),
        F.avg("char_error_rate").alias("mean_cer"),
        F.avg("word_error_rate").alias("mean_wer"),
        F.avg("end_to_end_seconds").alias("mean_seconds_page"),
        F.max("peak_rss_mb").alias("peak_rss_mb"),
        ok_ratio(F.col("text_layer_ok")).alias("text_layer_ok"),
    )
    p95 = {"p95_cer": "char_error_rate", "p95_wer": "word_error_rate", "p95_seconds_page": "end_to_end_seconds"}
    return with_columns(x, keys, [*(at_rank(records, keys, c, nearest_rank(0.95), name) for name, c in p95.items()), median(records, keys, "end_to_end_seconds", "median_seconds_page")])


def identity_problem(records: DataFrame) -> Column:
    """Which part of a record's identity is malformed, or null. run_index counts as 0 where it's missing."""
    blank = lambda c: F.coalesce(F.length(F.trim(c)) == 0, F.lit(True))
    out = F.when(F.lit(False), "")
    for c in IDENTITY[:3]:
        out = out.when(blank(c), c)
    out = out.when(F.coalesce(F.col("page_index") < 0, F.lit(True)), "page_index")
    return out.when(F.col("run_index") < 0, "run_index") if "run_index" in records.columns else out


def identified(records: DataFrame) -> DataFrame:
    run = F.coalesce("run_index", F.lit(0)) if "run_index" in records.columns else F.lit(0)
    return records.withColumns({**{c: F.trim(c) for c in IDENTITY[:3]}, "run_index": run})


def refused(records: DataFrame) -> DataFrame:
    """Rows that a comparison refuses: malformed and repeated identities, with the problem and their number."""
    bad = records.withColumn("problem", identity_problem(records)).filter("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n"))
    good = identified(records.filter(identity_problem(records).isNull()))
    twice = good.groupBy(*IDENTITY).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("duplicate").alias("problem"), "n")
    return bad.unionByName(twice)


def measure(record: str, name: str) -> Column:
    """A measure if it is usable: finite, and not below what it can be."""
    v = F.col(f"{record}.{name}").cast("double")
    usable = ~F.isnan(v) & (F.abs(v) != float("inf"))
    if name in POSITIVE:
        usable = usable & (v > 0)
    elif name in NUMBERS:
        usable = usable & (v >= 0)
    return F.when(usable, v)


def missing_measures(record: str) -> Column:
    """Names of the needed measures that a record lacks."""
    return F.array_compact(F.array(*(F.when(measure(record, c).isNull(), F.lit(c)) for c in NUMBERS), F.when(F.col(f"{record}.text_layer_ok").isNull(), F.lit("text_layer_ok"))))


def regressions() -> Column:
    """What got worse between `base` and `new`: measures beyond their limits, a lost text
    layer, and, without any tolerance, outputs that became empty."""
    found = []
    for c, most in WORSE_LIMITS.items():
        a, b = measure("base", c), measure("new", c)
        found.append(F.when(a.isNotNull() & b.isNotNull() & (worsening(a, b) > most), F.lit(c)))
    found.append(F.when(F.col("base.text_layer_ok") & ~F.col("new.text_layer_ok"), F.lit("text_layer_ok")))
    found.append(F.when((measure("base", "ocr_box_count") != 0) & (measure("new", "ocr_box_count") <= 0), F.lit("ocr_box_count_zero")))
    found.append(F.when(F.col("new.pages_with_zero_boxes") - F.col("base.pages_with_zero_boxes") > 0, F.lit("pages_with_zero_boxes")))
    return F.array_compact(F.array(*found))


def compared(base: DataFrame, new: DataFrame, settings: Sequence[str] = (), contract: str | None = None) -> DataFrame:
    """One row for each identity of either run: side (both, baseline, candidate), missing
    measures of each, settings that differ, and regressions. Identities are unique, as
    refused() tells. contract: a column with the description of how a record was made, a
    VARIANT or a JSON text (equal texts are judged once); its incomplete fields are then in config_missing_base and config_missing_new, and
    what both tell differently counts as a setting that differs."""
    told = None
    if contract and base.schema[contract].dataType == StringType():
        told = C.described_texts(base.select(contract).unionByName(new.select(contract)), contract)
        base, new = (x.withColumn("_told", C.text_key(contract)).drop(contract) for x in (base, new))
    elif contract:
        base, new = (C.described(x, contract).drop(contract) for x in (base, new))
    a, b = (identified(x).select(*IDENTITY, F.struct(*(c for c in x.columns if c not in IDENTITY)).alias(n)) for x, n in ((base, "base"), (new, "new")))
    x = a.join(b, list(IDENTITY), "full")
    described = {n: F.col(n) for n in ("base", "new")}
    if told is not None:
        for n in described:
            x = x.join(told.select(F.col("_told").alias(f"_{n}_told"), F.struct("contract_missing", "contract_values").alias(f"_{n}")), F.col(f"{n}._told") == F.col(f"_{n}_told"), "left")
            described[n] = F.col(f"_{n}")
    both = F.col("base").isNotNull() & F.col("new").isNotNull()
    none = F.array().cast("array<string>")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"base.{c}").eqNullSafe(F.col(f"new.{c}")), F.lit(c)) for c in settings))) if settings else none
    more = ()
    if contract:
        apart = C.differing(described["base"]["contract_values"], described["new"]["contract_values"])
        if told is not None:
            apart = F.when(F.col("base._told") == F.col("new._told"), none).otherwise(apart)
        differ = F.concat(differ, apart)
        more = tuple((f"config_missing_{n}", v["contract_missing"]) for n, v in described.items())
    side = F.when(F.col("base").isNull(), "candidate").when(F.col("new").isNull(), "baseline").otherwise("both")
    only = lambda c: F.when(both, c).otherwise(none)
    return x.select(*IDENTITY, side.alias("side"), only(missing_measures("base")).alias("missing_base"), only(missing_measures("new")).alias("missing_new"), only(differ).alias("settings_differ"), only(regressions()).alias("regressions"), *(only(c).alias(n) for n, c in more))


def verdict(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of a comparison (or of each one of several, by keys), and whether the runs are
    comparable and pass."""
    some = lambda c: F.count_if(F.size(c) > 0)
    described = "config_missing_base" in rows.columns
    config = [(some("config_missing_base") + some("config_missing_new")).alias("configuration_missing")] if described else []
    x = rows.groupBy(*keys).agg(
        F.count_if(F.col("side") != "candidate").alias("baseline_records"),
        F.count_if(F.col("side") != "baseline").alias("candidate_records"),
        F.count_if(F.col("side") == "baseline").alias("baseline_only"),
        F.count_if(F.col("side") == "candidate").alias("candidate_only"),
        (some("missing_base") + some("missing_new")).alias("metric_missing"),
        some("settings_differ").alias("settings_mismatch"),
        some("regressions").alias("record_regressions"),
        *config,
    )
    faults = F.col("baseline_only") + F.col("candidate_only") + F.col("metric_missing") + F.col("settings_mismatch")
    whole = (faults + F.col("configuration_missing") if described else faults) == 0
    return x.withColumn("comparable", whole).withColumn("passes", whole & (F.col("record_regressions") == 0))
