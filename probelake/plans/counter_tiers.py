"""Rollups of interface counters that keep up with late samples.

Samples carry their generation (name, generation, sampled_at_us, event_id and
counters).  A sample owns the difference to the one before it, so a redone minute needs
its predecessor, however old, and a late sample changes the next sample's minute too.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probelake.functions.scalars import epoch_bucket
from probelake.operators.counters import deltas, merge_rollups, rates

MINUTE, HOUR = 60_000_000, 3_600_000_000
GENERATION = ["name", "generation"]
KEYS = [*GENERATION, "bucket_us"]


def _bucketed(samples: DataFrame, width_us: int = MINUTE) -> DataFrame:
    return samples.withColumn("bucket_us", epoch_bucket(F.col("sampled_at_us"), width_us))


def _having(rows: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left_semi") -> DataFrame:
    """Rows whose keys are in ``other`` (left_anti: are not); null keys are keys too."""
    same = [F.col(f"rows.{k}").eqNullSafe(F.col(f"other.{k}")) for k in keys]
    return rows.alias("rows").join(other.select(*keys).alias("other"), reduce(lambda a, b: a & b, same), how)


def dirty_buckets(new: DataFrame, samples: DataFrame) -> DataFrame:
    """Distinct (name, generation, bucket_us) of new samples and of the samples that follow them in ``samples``, which has them too.

    Only the last sample of a minute is followed by one of another minute, so what a
    generation's order needs is a row a minute, and the next minute is dirty only if that last sample is new.
    Samples without a time are of no minute and follow all others.
    """
    new, samples = new.where("sampled_at_us is not null"), samples.where("sampled_at_us is not null")
    last = F.max(F.struct("sampled_at_us", "event_id")).alias("last")
    mine = _bucketed(new).groupBy(*KEYS).agg(last)
    held = _bucketed(_having(samples, new.select(*GENERATION).distinct(), GENERATION)).groupBy(*KEYS).agg(last)
    after = held.withColumn("next_us", F.lead("bucket_us").over(Window.partitionBy(*GENERATION).orderBy("bucket_us")))
    following = _having(after, mine, [*KEYS, "last"]).where("next_us is not null").select(*GENERATION, F.col("next_us").alias("bucket_us"))
    return mine.select(*KEYS).union(following).distinct()


def parents(dirty: DataFrame) -> DataFrame:
    return dirty.select(*GENERATION, epoch_bucket(F.col("bucket_us"), HOUR).alias("bucket_us")).distinct()


def sealable(dirty: DataFrame, samples: DataFrame, closed: DataFrame, as_of_us: int) -> DataFrame:
    """Dirty minutes that may be rolled up: over, and followed by a sample of their generation, or the generation is closed (name, generation)."""
    last = samples.groupBy(*GENERATION).agg(F.max("sampled_at_us").alias("last_us"))
    over = dirty.where(F.col("bucket_us") + MINUTE <= as_of_us).join(last, GENERATION, "left").join(closed.select(*GENERATION, F.lit(True).alias("closed")).distinct(), GENERATION, "left")
    return over.where((F.col("last_us") >= F.col("bucket_us") + MINUTE) | F.col("closed")).select(*KEYS)


def sealable_hours(dirty: DataFrame, dirty_minutes: DataFrame, as_of_us: int | None = None) -> DataFrame:
    """Dirty hours that are over, if a time to be over at is given, and have no dirty minute."""
    over = dirty if as_of_us is None else dirty.where(F.col("bucket_us") + HOUR <= as_of_us)
    return _having(over, parents(dirty_minutes), KEYS, "left_anti")


def redone(dirty: DataFrame, samples: DataFrame, counters: Sequence[str]) -> DataFrame:
    """Minute rollups of the dirty buckets from their samples and each bucket's predecessor."""
    near = _bucketed(_having(samples, dirty.select(*GENERATION).distinct(), GENERATION))
    own = _having(near, dirty, KEYS)
    # A minute's last sample is the predecessor of the next minute that has any.
    order = F.struct("sampled_at_us", "event_id")
    last = near.groupBy(*KEYS).agg(F.max_by(F.struct("sampled_at_us", "event_id", *counters), order).alias("s"))
    carried = last.withColumn("to_us", F.lead("bucket_us").over(Window.partitionBy(*GENERATION).orderBy("bucket_us")))
    carried = _having(carried.select(*GENERATION, F.col("to_us").alias("bucket_us"), "s.*"), dirty, KEYS)
    seen = own.groupBy(*KEYS).agg(F.count("*").alias("sample_count"), F.count("reset_reason").alias("reset_count"))
    cols = [*KEYS, "sampled_at_us", "event_id", *counters]
    # Within (name, generation, bucket) the differences are those of the whole generation.
    rows = own.select(*cols).unionByName(carried.select(*cols))
    packed = rows.withColumn("generation", F.struct("generation", "bucket_us")).drop("bucket_us")
    moved = rates(deltas(packed, counters)).select("*", F.col("generation.generation").alias("_g"), F.col("generation.bucket_us").alias("bucket_us"))
    moved = moved.groupBy("name", F.col("_g").alias("generation"), "bucket_us").agg(
        F.sum("elapsed_us").alias("elapsed_us"), *[F.sum(f"{c}_delta").alias(f"{c}_delta") for c in counters], F.max("rx_bytes_per_s").alias("peak_rx_bytes_per_s"), F.max("tx_bytes_per_s").alias("peak_tx_bytes_per_s")
    )
    return seen.join(moved, KEYS, "left")


def update(minutes: DataFrame, hours: DataFrame, dirty: DataFrame, samples: DataFrame, counters: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(minutes, hours) after the dirty minutes were redone from samples, and their hours from minutes."""
    new = _having(minutes, dirty, KEYS, "left_anti").unionByName(redone(dirty, samples, counters).select(minutes.columns))
    touched = parents(dirty)
    inside = _having(new.withColumn("hour_us", epoch_bucket(F.col("bucket_us"), HOUR)), touched.withColumnRenamed("bucket_us", "hour_us"), [*GENERATION, "hour_us"]).drop("hour_us")
    return new, _having(hours, touched, KEYS, "left_anti").unionByName(merge_rollups(inside, counters, HOUR).select(hours.columns))


def overlay(minutes: DataFrame, hours: DataFrame, dirty_minutes: DataFrame, dirty_hours: DataFrame, samples: DataFrame, counters: Sequence[str]) -> DataFrame:
    """Rollup rows that hold every sample once: clean hours, minutes of hours that are not, and dirty minutes from samples.  source_us is the width of a row."""
    stale = dirty_hours.select(*KEYS).union(parents(dirty_minutes)).distinct()
    hour = _having(hours, stale, KEYS, "left_anti")
    fine = _having(minutes, dirty_minutes, KEYS, "left_anti").unionByName(redone(dirty_minutes, samples, counters).select(minutes.columns))
    inside = _having(fine.withColumn("hour_us", epoch_bucket(F.col("bucket_us"), HOUR)), stale.withColumnRenamed("bucket_us", "hour_us"), [*GENERATION, "hour_us"]).drop("hour_us")
    return hour.withColumn("source_us", F.lit(HOUR)).unionByName(inside.select(hour.columns).withColumn("source_us", F.lit(MINUTE)))


def series(rows: DataFrame, resets: DataFrame, counters: Sequence[str], width_us: int, from_us: int, to_us: int) -> DataFrame:
    """Display buckets per interface from rollup rows of any width (``overlay``): greatest peaks, sums of deltas, and resets from reset events (name, at_us) alone.

    Rows count where they begin and cover the whole rows that hold the window's ends; edge_partial marks buckets over an edge.
    """
    bucket = lambda c: epoch_bucket(F.col(c), width_us).alias("bucket_us")
    inside = rows.where((F.col("bucket_us") + F.col("source_us") > from_us) & (F.col("bucket_us") < to_us) & F.col("elapsed_us").isNotNull())
    moved = inside.groupBy("name", bucket("bucket_us")).agg(F.max("peak_rx_bytes_per_s").alias("peak_rx_bytes_per_s"), F.max("peak_tx_bytes_per_s").alias("peak_tx_bytes_per_s"), *[F.sum(f"{c}_delta").alias(c) for c in counters])
    counted = resets.where((F.col("at_us") >= from_us) & (F.col("at_us") < to_us)).groupBy("name", bucket("at_us")).agg(F.count("*").alias("reset_count"))
    out = moved.withColumn("has_deltas", F.lit(True)).join(counted, ["name", "bucket_us"], "full")
    edge = (F.col("bucket_us") < from_us) | (F.col("bucket_us") + width_us > to_us)
    return out.select("name", "bucket_us", "peak_rx_bytes_per_s", "peak_tx_bytes_per_s", *counters, F.coalesce("has_deltas", F.lit(False)).alias("has_deltas"), F.coalesce("reset_count", F.lit(0)).cast("long").alias("reset_count"), edge.alias("edge_partial"))
