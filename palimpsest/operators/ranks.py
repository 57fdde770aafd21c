"""Exact values at given ranks of groups of any size.

Values are counted first, then dealt to buckets by approximate cuts of each group's
distinct values; sums of the buckets tell which of them holds a rank, and only its
values are put in order. The cuts decide where the work goes, never the result."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Buckets of a group's distinct values, and the accuracy of the cuts between them.
BUCKETS, ACCURACY = 64, 1024


def same_group(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the key columns of `left` stay."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[f"_right_{k}"]) for k in keys), F.lit(True))
    return left.join(right, match, how).drop(*(f"_right_{k}" for k in keys))


def at_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Callable[[Column], Column]], weight: str | None = None) -> DataFrame:
    """One row a group: for each name, the first value at which the number of rows (or
    the sum of the weights, none below 0, null as 0) reaches the rank; a rank is a function of the
    group's total. Null values take no part: a group of nothing else has no row. Keys may be null."""
    one = F.lit(1) if weight is None else F.col(weight)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(F.coalesce(one, F.lit(0))).alias("_n"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, [i / BUCKETS for i in range(1, BUCKETS)], ACCURACY).alias("_cuts"))
    bucket = F.size(F.filter("_cuts", lambda c: c < F.col(value))).alias("_b")
    placed = same_group(counts, cuts, keys).select(*keys, value, "_n", bucket)
    group = Window.partitionBy(*keys)
    sums = placed.groupBy(*keys, "_b").agg(F.sum("_n").alias("_s"))
    upto, total = F.sum("_s").over(group.orderBy("_b")), F.sum("_s").over(group)
    sums = sums.select(*keys, "_b", (upto - F.col("_s")).alias("_before"), upto.alias("_upto"), total.alias("_t"))
    # a group has at most BUCKETS rows here, and one row for each rank after it
    sought = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("_t")).cast("double").alias("rank")) for name, rank in ranks.items())))
    sums = sums.select(*keys, "_b", "_before", "_upto", sought.alias("_of")).filter((F.col("_of.rank") <= F.col("_upto")) & ((F.col("_of.rank") > F.col("_before")) | (F.col("_before") == 0)))
    sums = sums.select(*keys, "_b", F.col("_of.name").alias("_name"), (F.col("_of.rank") - F.col("_before")).alias("_rank"))
    near = same_group(placed, sums, [*keys, "_b"])
    reached = F.sum("_n").over(Window.partitionBy(*keys, "_b", "_name").orderBy(value))
    near = near.withColumn("_reached", reached).filter(F.col("_reached") >= F.col("_rank"))
    return near.groupBy(*keys).agg(*(F.min(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in ranks))


def at_rank(df: DataFrame, keys: Sequence[str], value: str, rank: Callable[[Column], Column], name: str) -> DataFrame:
    return at_ranks(df, keys, value, {name: rank})


def nearest_rank(fraction: float) -> Callable[[Column], Column]:
    return lambda n: F.greatest(F.lit(1), F.ceil(n * fraction))


def rounded_index(fraction: float) -> Callable[[Column], Column]:
    """The index round((n - 1) * p), halves to even."""
    return lambda n: F.rint((n - 1) * fraction) + 1


#: Ranks of the middle two values, the same one where their number is odd.
MIDDLE = {"_low": lambda n: F.floor((n + 1) / 2), "_high": lambda n: F.floor(n / 2) + 1}


def median(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """The mean of the middle two values."""
    return at_ranks(df, keys, value, MIDDLE).select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias(name))
