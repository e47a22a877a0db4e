"""Mergeable latency sketch: counts of logarithmic bins of ratio 1.02.

The long form, one row per key and bin, is what aggregates merge: Spark adds
counts on both sides of a shuffle.  The packed form is an array of (bin, n).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATIO = 1.02
LN_RATIO = math.log(RATIO)


def bin_of(value: Column) -> Column:
    return F.greatest(F.floor(F.log(F.greatest(value, F.lit(1)).cast("double")) / LN_RATIO), F.lit(0)).cast("int")


def bin_low(b: Column) -> Column:
    """Least value of a bin."""
    return F.floor(F.exp(b * LN_RATIO)).cast("long")


def bin_value(b: Column) -> Column:
    """Midpoint of a bin."""
    return F.round(F.exp((b + 0.5) * LN_RATIO)).cast("long")


def build(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Bin counts (keys, bin, n) of the values that are not null."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, bin_of(F.col(value)).alias("bin")).agg(F.count("*").alias("n"))


def merge(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bin counts merged to coarser keys."""
    return bins.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))


def pack(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key with hist, its (bin, n) sorted by bin."""
    return bins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("hist"))


def unpack(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return packed.select(*keys, F.explode("hist").alias("h")).select(*keys, "h.bin", "h.n")


def rank(q: Column | float, total: Column) -> Column:
    """Nearest rank of a quantile; q is held to [0, 1]."""
    q = F.lit(float(q)) if not isinstance(q, Column) else q
    return F.greatest(F.ceil(F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0)) * total), F.lit(1))


def running(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bins with their running count (cum) and their key's total."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    return bins.withColumn("cum", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))


def quantiles(bins: DataFrame, keys: Sequence[str], wanted: dict[str, float]) -> DataFrame:
    """Quantiles of every key as bin midpoints, all in one pass; columns are named by ``wanted``."""
    picked = [F.min(F.when(F.col("cum") >= rank(q, F.col("total")), F.col("bin"))).alias(name) for name, q in wanted.items()]
    found = running(bins, keys).groupBy(*keys).agg(*picked)
    return found.select(*keys, *[bin_value(F.col(name)).alias(name) for name in wanted])


def top_bins(bins: DataFrame, keys: Sequence[str], threshold: Column, limit: int) -> DataFrame:
    """The ``limit`` highest bins whose midpoint reaches the threshold: bin, value, low, n, place, truncated."""
    w = Window.partitionBy(*keys)
    fit = bins.withColumn("value", bin_value(F.col("bin"))).where(F.col("value") >= threshold)
    ranked = fit.withColumn("place", F.row_number().over(w.orderBy(F.desc("bin")))).withColumn("truncated", F.count("*").over(w) > limit)
    return ranked.where(F.col("place") <= limit).withColumn("low", bin_low(F.col("bin")))
