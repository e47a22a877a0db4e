"""Probe outcomes and their aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelake.functions import sketch
from probelake.functions.scalars import epoch_bucket, ms, outcome, percent
from probelake.operators.gaps import gap_counts

COUNTS = ["scheduled", "attempted", "sent", "on_time", "late", "unanswered", "send_errors", "missed", "rtt_count"]


def classified(probes: DataFrame, as_of_us: int) -> DataFrame:
    return probes.withColumn("outcome", outcome(as_of_us))


def tally() -> list:
    """Aggregates of classified probes; send errors count in the timeouts, null round trips count as replies only."""
    of = lambda kind: F.count_if(F.col("outcome") == kind)
    return [
        F.count("*").alias("attempted"),
        F.count_if(F.col("outcome") != "send_error").alias("sent"),
        of("on_time").alias("on_time"),
        of("late").alias("late"),
        of("unanswered").alias("unanswered"),
        of("send_error").alias("send_errors"),
        of("pending").alias("pending"),
        F.count("rtt_ns").alias("rtt_count"),
        F.sum("rtt_ns").alias("rtt_sum_ns"),
        F.min("rtt_ns").alias("rtt_min_ns"),
        F.max("rtt_ns").alias("rtt_max_ns"),
        F.min("timeout_ns").alias("timeout_min_ns"),
        F.max("timeout_ns").alias("timeout_max_ns"),
    ]


def raw_agg(probes: DataFrame, gaps: DataFrame, width_us: int, as_of_us: int) -> DataFrame:
    """Per target and bucket all counts; buckets with missed slots only are there too."""
    keyed = classified(probes, as_of_us).withColumn("bucket_us", epoch_bucket(F.col("scheduled_at_us"), width_us))
    agg = keyed.groupBy("target_id", "bucket_us").agg(*tally())
    both = agg.join(gap_counts(gaps, width_us), ["target_id", "bucket_us"], "full")
    counts = ["attempted", "sent", "on_time", "late", "unanswered", "send_errors", "pending", "rtt_count", "missed"]
    out = both.select("target_id", "bucket_us", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], "rtt_sum_ns", "rtt_min_ns", "rtt_max_ns", "timeout_min_ns", "timeout_max_ns")
    return out.withColumn("scheduled", F.col("attempted") + F.col("missed")).withColumn("pending_partial", F.col("pending") > 0)


def bins(probes: DataFrame, width_us: int) -> DataFrame:
    """Sketch of the round trips per target and bucket."""
    keyed = probes.withColumn("bucket_us", epoch_bucket(F.col("scheduled_at_us"), width_us))
    return sketch.build(keyed, ["target_id", "bucket_us"], "rtt_ns")


def points(agg: DataFrame, hist: DataFrame, keys: Sequence[str] = ("target_id", "bucket_us")) -> DataFrame:
    """Display points: latencies in milliseconds, losses as shares of what was sent; null where nothing was."""
    q = sketch.quantiles(hist, keys, {"p50_ns": 0.5, "p95_ns": 0.95, "p99_ns": 0.99})
    joined = agg.join(q, list(keys), "left")
    return joined.select(
        *keys,
        *COUNTS,
        F.when(F.col("rtt_count") > 0, F.col("rtt_sum_ns") / F.col("rtt_count") / 1e6).alias("avg_ms"),
        ms(F.col("rtt_min_ns")).alias("min_ms"),
        ms(F.col("rtt_max_ns")).alias("max_ms"),
        *[ms(F.col(f"{p}_ns")).alias(f"{p}_ms") for p in ("p50", "p95", "p99")],
        percent(F.col("late") + F.col("unanswered"), F.col("sent")).alias("deadline_miss_pct"),
        percent(F.col("unanswered"), F.col("sent")).alias("no_reply_pct"),
        percent(F.col("late"), F.col("sent")).alias("late_pct"),
        percent(F.col("send_errors"), F.col("attempted")).alias("send_error_pct"),
        percent(F.col("missed"), F.col("scheduled")).alias("gap_pct"),
    )


def merge_agg(agg: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Aggregates merged to coarser keys; timeouts of 0 or null are unset."""
    set_ = lambda c: F.when(F.col(c) > 0, F.col(c))
    counts = ["scheduled", "attempted", "sent", "on_time", "late", "unanswered", "send_errors", "missed", "rtt_count"]
    return agg.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in counts],
        F.sum("rtt_sum_ns").alias("rtt_sum_ns"),
        F.min("rtt_min_ns").alias("rtt_min_ns"),
        F.max("rtt_max_ns").alias("rtt_max_ns"),
        F.min(set_("timeout_min_ns")).alias("timeout_min_ns"),
        F.max(set_("timeout_max_ns")).alias("timeout_max_ns"),
    )


def grouping_agg(probes: DataFrame, width_us: int, as_of_us: int) -> DataFrame:
    """Buckets, targets and the whole in one pass of grouping sets; nulls mark the coarser rows."""
    keyed = classified(probes, as_of_us).withColumn("bucket_us", epoch_bucket(F.col("scheduled_at_us"), width_us))
    sets = [[F.col("target_id"), F.col("bucket_us")], [F.col("target_id")], []]
    return keyed.groupingSets(sets, F.col("target_id"), F.col("bucket_us")).agg(*tally())
