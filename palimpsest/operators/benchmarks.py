"""Benchmark records: summaries, percentiles, weighted statistics, regression gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import ranks

# How much worse a candidate may be, as a share of the baseline.
ERROR_LIMIT, TIME_LIMIT = 0.01, 0.20


def nearest_rank(value: str, fraction: float) -> Column:
    """The value at rank ceil(p * n), at least 1, without interpolation; an aggregate
    for groups of few distinct values. ranks.at_ranks takes groups of any size."""
    return F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY {value})")


def round_index(value: Column, fraction: float) -> Column:
    """The value at index round((n - 1) * p), halves to even; differs from the above.
    For groups that fit in one row; ranks.at_ranks takes groups of any size."""
    sorted_ = F.array_sort(F.collect_list(value))
    return F.get(sorted_, F.rint((F.size(sorted_) - 1) * fraction).cast("int"))


def confidence(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, median, p10, least value and number of values of each group."""
    x = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.min(value).alias("min"), F.count(value).alias("n"))
    found = ranks.at_ranks(df, keys, value, {"median": ranks.nearest_rank(0.5), "p10": ranks.nearest_rank(0.1)})
    return ranks.same_group(x, found, keys, "left").select(*keys, "mean", "median", "p10", "min", "n")


def summary(df: DataFrame, keys: Sequence[str], error: str, seconds: str) -> DataFrame:
    """Eight measures of each group of records."""
    x = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(error) == 0).alias("exact"),
        F.round(F.avg(error), 6).alias("mean_error"),
        F.max(error).alias("max_error"),
        F.round(F.avg(seconds), 6).alias("mean_seconds"),
    )
    x = ranks.same_group(x, ranks.median(df, keys, error, "_m"), keys, "left")
    x = ranks.same_group(x, ranks.at_rank(df, keys, seconds, ranks.nearest_rank(0.95), "p95_seconds"), keys, "left")
    return x.select(*keys, "n", "exact", "mean_error", F.round("_m", 6).alias("median_error"), "max_error", "mean_seconds", "p95_seconds")


def memberships(dataset: Column, tags: Column) -> Column:
    """Groups that a record feeds: its dataset, and each of its tags."""
    return F.concat(F.array(F.concat(F.lit("dataset:"), dataset)), F.transform(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t != ""), lambda t: F.concat(F.lit("tag:"), t)))


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """The first value at which the weights up to it reach half."""
    return ranks.at_ranks(df, keys, value, {"weighted_median": lambda total: total / 2}, weight)


def weighted_fit(df: DataFrame, keys: Sequence[str], x: Column, y: Column, w: Column) -> DataFrame:
    """Slope and intercept of the weighted least-squares line, from five sums."""
    s = df.groupBy(*keys).agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * y).alias("wxy"))
    slope = (F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy")) / (F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx"))
    return s.select(*keys, slope.alias("slope"), ((F.col("wy") - slope * F.col("wx")) / F.col("w")).alias("intercept"))


def worsening(base: Column, new: Column) -> Column:
    """(new - base) / |base|; a missing value is infinitely worse."""
    return F.coalesce((new - base) / F.greatest(F.abs(base), F.lit(1e-9)), F.lit(float("inf")))


def compared(base: DataFrame, new: DataFrame, identity: Sequence[str], limits: Mapping[str, float]) -> DataFrame:
    """Full outer comparison of two record sets: side (both, baseline, candidate) and
    the names of the metrics that got worse than their limits."""
    a = base.select(*identity, F.struct(*limits).alias("base"))
    b = new.select(*identity, F.struct(*limits).alias("new"))
    x = a.join(b, list(identity), "full")
    side = F.when(F.col("base").isNull(), "candidate").when(F.col("new").isNull(), "baseline").otherwise("both")
    worse = F.array_compact(F.array(*(F.when((side == "both") & (worsening(F.col(f"base.{m}"), F.col(f"new.{m}")) > most), F.lit(m)) for m, most in limits.items())))
    return x.select(*identity, side.alias("side"), worse.alias("worse"))


def repeated(records: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Identities that occur more than once, which a comparison refuses."""
    return records.groupBy(*identity).count().filter("count > 1")
