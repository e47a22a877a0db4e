"""Stored rollup rows: the counts of a bucket with its packed sketch, so that quantiles outlive the raw rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelake.functions import sketch
from probelake.functions.scalars import epoch_bucket
from probelake.operators.probes import bins, merge_agg, raw_agg
from probelake.plans.tiers import HOUR, KEYS, MINUTE, SETTLED, minute_rollup

#: A sketch is an array of (bin, n) in order of bins; a bucket without replies has an empty one.
HIST = "array<struct<bin:int,n:bigint>>"


def fold(agg: DataFrame, hist: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Aggregates with the sketch of their bins (keys, bin, n) as the column hist."""
    packed = sketch.pack(hist.select(*keys, "bin", "n"), keys)
    return agg.join(packed, list(keys), "left").withColumn("hist", F.coalesce("hist", F.array().cast(HIST)))


def unfold(stored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Bins (keys, bin, n) of stored rows."""
    return sketch.unpack(stored, keys)


def minutes(probes: DataFrame, gaps: DataFrame, as_of_us: int = SETTLED) -> DataFrame:
    """Stored minutes, of settled probes unless an evaluation time is given."""
    return fold(minute_rollup(probes, gaps, as_of_us), bins(probes, MINUTE))


def merge(stored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Stored rows merged to coarser keys: counts are summed and bins are summed in long form, on both sides of their shuffle."""
    return fold(merge_agg(stored, keys), sketch.merge(unfold(stored, keys), keys), keys)


def widen(stored: DataFrame, width_us: int) -> DataFrame:
    """Stored rows merged to wider buckets."""
    return merge(stored.withColumn("bucket_us", epoch_bucket(F.col("bucket_us"), width_us)))


def redone(dirty: DataFrame, probes: DataFrame, gaps: DataFrame, as_of_us: int | None = None) -> DataFrame:
    """Stored minutes of the dirty ones (target_id, bucket_us) from raw rows; with an evaluation time, open probes are pending and not unanswered."""
    touched = probes.withColumn("bucket_us", epoch_bucket(F.col("scheduled_at_us"), MINUTE)).join(dirty, KEYS, "left_semi").drop("bucket_us")
    # Gaps are cut to the days that hold dirty minutes before they meet minutes.
    near = gaps_near(dirty, gaps)
    agg = minute_rollup(touched, near) if as_of_us is None else raw_agg(touched, near, MINUTE, as_of_us).drop("pending_partial")
    return fold(agg.join(dirty, KEYS, "left_semi"), bins(touched, MINUTE))


def gaps_near(dirty: DataFrame, gaps: DataFrame) -> DataFrame:
    """The parts of gap runs that lie in days with dirty minutes of their target."""
    from probelake.operators.gaps import by_day

    days = dirty.select("target_id", epoch_bucket(F.col("bucket_us"), 24 * HOUR).alias("day_us")).distinct()
    return by_day(gaps).join(days, ["target_id", "day_us"], "left_semi").drop("day_us")


def upsert(stored: DataFrame, dirty: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows with the dirty ones replaced: counts and sketch change together."""
    return stored.join(dirty, KEYS, "left_anti").unionByName(fresh)


def update(stored: DataFrame, hours: DataFrame, dirty: DataFrame, probes: DataFrame, gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(minutes, hours) after the dirty minutes were redone from raw rows, and their hours from minutes."""
    from probelake.plans.tiers import parents

    new = upsert(stored, dirty, redone(dirty, probes, gaps))
    touched = parents(dirty)
    inside = new.withColumn("hour_us", epoch_bucket(F.col("bucket_us"), HOUR)).join(touched.withColumnRenamed("bucket_us", "hour_us"), ["target_id", "hour_us"], "left_semi").drop("hour_us")
    return new, upsert(hours, touched, widen(inside, HOUR))
