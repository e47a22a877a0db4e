"""Missing slots as runs: (target_id, first_us, interval_ns, missed_count)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.functions.scalars import whole


def infer_gaps(probes: DataFrame, interval_ns: int) -> DataFrame:
    """Slots that a target skipped: a step of at least two intervals leaves whole intervals out."""
    w = Window.partitionBy("target_id").orderBy("scheduled_at_us", "sequence")
    step = interval_ns // 1000
    steps = probes.select("target_id", F.col("scheduled_at_us").alias("t"), F.lag("scheduled_at_us").over(w).alias("prev"))
    missed = whole(F.col("t") - F.col("prev"), step) - 1
    return steps.where(missed > 0).select("target_id", (F.col("prev") + step).alias("first_us"), F.lit(interval_ns).cast("long").alias("interval_ns"), missed.alias("missed_count"))


def gap_end(first: str = "first_us", interval: str = "interval_ns", count: str = "missed_count") -> Column:
    """The last missed slot."""
    return F.col(first) + (F.col(count) - 1) * whole(F.col(interval), 1000)


def coalesce_gaps(gaps: DataFrame) -> DataFrame:
    """Join a target's runs of one cadence that follow each other without a slot between."""
    w = Window.partitionBy("target_id").orderBy("first_us")
    step = whole(F.col("interval_ns"), 1000)
    after = (F.lag(gap_end()).over(w) + step == F.col("first_us")) & (F.lag("interval_ns").over(w) == F.col("interval_ns"))
    run = F.sum(F.when(F.coalesce(after, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = gaps.withColumn("run", run)
    return marked.groupBy("target_id", "run").agg(F.min("first_us").alias("first_us"), F.first("interval_ns").alias("interval_ns"), F.sum("missed_count").alias("missed_count")).drop("run")


def slots_within(a: Column, b: Column) -> Column:
    """How many slots of the run lie in [a, b), in closed form."""
    step = whole(F.col("interval_ns"), 1000)
    low = F.greatest(-whole(F.col("first_us") - a, step), F.lit(0))
    high = F.least(whole(b - 1 - F.col("first_us"), step), F.col("missed_count") - 1)
    return F.greatest(high - low + 1, F.lit(0)).cast("long")


def by_day(gaps: DataFrame) -> DataFrame:
    """Runs cut at midnights, each part with its day_us; parts without a slot are left out."""
    day = 86_400_000_000
    start = lambda t: t - F.pmod(t, F.lit(day))
    step = whole(F.col("interval_ns"), 1000)
    spread = gaps.withColumn("day_us", F.explode(F.sequence(start(F.col("first_us")), start(gap_end()), F.lit(day).cast("long"))))
    skipped = F.greatest(-whole(F.col("first_us") - F.col("day_us"), step), F.lit(0))
    parts = spread.select("target_id", (F.col("first_us") + skipped * step).alias("first_us"), "interval_ns", slots_within(F.col("day_us"), F.col("day_us") + day).alias("missed_count"), "day_us")
    return parts.where("missed_count > 0")


def gap_counts(gaps: DataFrame, width_us: int, from_us: int | None = None, to_us: int | None = None) -> DataFrame:
    """Missed slots per target and bucket; a run meets at most as many buckets as it spans and as it has slots, by an equi-key and not by a range join."""
    lo, hi = F.col("first_us"), gap_end()
    if from_us is not None:
        gaps = gaps.where(hi >= from_us)
        lo = F.greatest(lo, F.lit(from_us))
    if to_us is not None:
        gaps = gaps.where(F.col("first_us") < to_us)
        hi = F.least(hi, F.lit(to_us - 1))
    start = lambda t: t - F.pmod(t, F.lit(width_us))
    step = whole(F.col("interval_ns"), 1000)
    first = F.col("first_us") - F.least(whole(F.col("first_us") - lo, step), F.lit(0)) * step
    last = F.col("first_us") + F.least(whole(hi - F.col("first_us"), step), F.col("missed_count") - 1) * step
    none = F.array().cast("array<bigint>")
    # Of a run with fewer slots than buckets only the buckets with a slot.
    sparse = F.transform(F.when(first <= last, F.sequence(first, last, step)).otherwise(none), start)
    dense = F.sequence(start(lo), start(hi), F.lit(width_us).cast("long"))
    spread = gaps.withColumn("bucket_us", F.explode(F.when(step >= width_us, sparse).otherwise(dense)))
    a = F.col("bucket_us") if from_us is None else F.greatest(F.col("bucket_us"), F.lit(from_us))
    b = F.col("bucket_us") + width_us
    b = b if to_us is None else F.least(b, F.lit(to_us))
    counted = spread.select("target_id", "bucket_us", slots_within(a, b).alias("m")).where("m > 0")
    return counted.groupBy("target_id", "bucket_us").agg(F.sum("m").alias("missed"))


def gap_minutes(gaps: DataFrame) -> DataFrame:
    """Every minute that a run touches, from its first to its last slot."""
    minute = lambda t: t - F.pmod(t, F.lit(60_000_000))
    return gaps.select("target_id", F.explode(F.sequence(minute(F.col("first_us")), minute(gap_end()), F.lit(60_000_000).cast("long"))).alias("bucket_us")).distinct()


def slot_minutes(gaps: DataFrame) -> DataFrame:
    """The minutes that hold a missed slot: at most one for every slot and one for every minute of a run."""
    minute = 60_000_000
    step = F.greatest(whole(F.col("interval_ns"), 1000), F.lit(minute).cast("long"))
    at = F.when(whole(F.col("interval_ns"), 1000) >= minute, F.sequence(F.col("first_us"), gap_end(), step)).otherwise(F.sequence(F.col("first_us") - F.pmod("first_us", F.lit(minute)), gap_end(), F.lit(minute).cast("long")))
    return gaps.where("missed_count > 0").select("target_id", F.explode(at).alias("t")).select("target_id", (F.col("t") - F.pmod("t", F.lit(minute))).alias("bucket_us")).distinct()
