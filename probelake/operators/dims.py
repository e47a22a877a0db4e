"""Dimensions: endpoints, targets, their changes and settings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULTS = {"interval_ns": 1_000_000_000, "timeout_ns": 1_000_000_000, "min_interval_ns": 200_000_000, "latency_threshold": "50%", "baseline_window_ns": 60_000_000_000, "min_samples": 3, "recover_after_ns": 60_000_000_000}
#: Nanoseconds of a duration's unit.
UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}


def endpoint_dim(observed: DataFrame) -> DataFrame:
    """First and last sighting of each target's endpoints."""
    return observed.groupBy("target_id", "endpoint").agg(F.min("sent_at_us").alias("first_seen_us"), F.max("sent_at_us").alias("last_seen_us"))


def last_endpoint(dim: DataFrame) -> DataFrame:
    """Each target's endpoint seen last; the largest of those seen at once."""
    return dim.groupBy("target_id").agg(F.max_by("endpoint", F.struct("last_seen_us", "endpoint")).alias("endpoint"))


def endpoint_changes(observed: DataFrame) -> DataFrame:
    """(target_id, at_us, old, new) where a target's endpoint differs from the one before."""
    w = Window.partitionBy("target_id").orderBy("sent_at_us", "sequence")
    steps = observed.select("target_id", F.col("sent_at_us").alias("at_us"), F.lag("endpoint").over(w).alias("old"), F.col("endpoint").alias("new"))
    return steps.where("old <> new")


def sync(old: DataFrame, new: DataFrame, key: str, settings: Sequence[str]) -> DataFrame:
    """What a new configuration snapshot does to each target: added, removed, changed or same, with both settings as JSON."""
    both = old.select(key, F.struct(*settings).alias("old")).join(new.select(key, F.struct(*settings).alias("new")), key, "full")
    action = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    detail = F.when(action == "changed", F.to_json(F.struct("old", "new")))
    return both.select(key, action.alias("action"), (action != "removed").alias("active"), detail.alias("detail"))


def threshold(raw: Column) -> tuple[Column, Column]:
    """(relative percent, absolute nanoseconds) of a latency rule such as ``50%`` or ``100ms``; both null if it is none."""
    text = F.trim(raw)
    percent = F.regexp_extract(text, r"^\s*\+?(\d+(?:\.\d+)?)\s*%$", 1)
    number = F.regexp_extract(text, r"^\+?(\d+(?:\.\d+)?)(ns|us|ms|s|m|h)$", 1)
    unit = F.regexp_extract(text, r"^\+?(\d+(?:\.\d+)?)(ns|us|ms|s|m|h)$", 2)
    scale = F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), unit)
    relative = F.when(percent != "", percent.cast("double"))
    absolute = F.when(number != "", F.round(number.cast("double") * scale).cast("long"))
    return F.when(relative > 0, relative), F.when(absolute > 0, absolute)


def effective_settings(targets: DataFrame, defaults: dict = DEFAULTS) -> DataFrame:
    """Each target's settings: its own, else the older field, else the default."""
    rule = F.coalesce("latency_threshold", F.lit(defaults["latency_threshold"]))
    relative, absolute = threshold(rule)
    return targets.select(
        "target_id",
        F.coalesce("ping_interval_ns", "legacy_interval_ns", F.lit(defaults["interval_ns"])).alias("interval_ns"),
        F.coalesce("ping_timeout_ns", F.lit(defaults["timeout_ns"])).alias("timeout_ns"),
        F.greatest(F.lit(100_000_000), F.lit(defaults["min_interval_ns"])).cast("long").alias("fast_interval_ns"),
        relative.alias("relative_pct"),
        absolute.alias("absolute_ns"),
        (relative.isNull() & absolute.isNull()).alias("invalid"),
    )


def rate_budget(settings: DataFrame, budget_per_s: float) -> DataFrame:
    """Worst-case probes a second of all targets, whether they pass the budget, and rows a day."""
    fastest = F.least("interval_ns", "fast_interval_ns")
    return settings.agg(F.sum(1e9 / fastest).alias("rate_per_s"), F.sum(86_400e9 / F.col("interval_ns")).alias("rows_per_day")).withColumn("over_budget", F.col("rate_per_s") > budget_per_s)


def violations(targets: DataFrame, defaults: dict = DEFAULTS) -> DataFrame:
    """One row per target and broken rule."""
    s = effective_settings(targets, defaults)
    rows = targets.select("target_id", "stable_id", "address", "family").join(s, "target_id").withColumn("same_id", F.count("*").over(Window.partitionBy("stable_id")))
    rules = {
        "duplicate_id": F.col("same_id") > 1,
        "bad_family": ~F.col("family").isin("auto", "4", "6"),
        "no_address": F.trim("address") == "",
        "interval_below_minimum": F.col("interval_ns") < defaults["min_interval_ns"],
        "timeout_not_positive": F.col("timeout_ns") <= 0,
        "fast_interval_not_faster": F.col("fast_interval_ns") >= F.col("interval_ns"),
        "bad_latency_threshold": F.col("invalid"),
        "samples_do_not_fit": F.col("relative_pct").isNotNull() & (F.lit(defaults["min_samples"]) > F.floor(F.lit(defaults["baseline_window_ns"]) / F.col("interval_ns"))),
    }
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return rows.select("target_id", F.explode(broken).alias("rule"))


def retention_order(raw_s: int, minute_s: int, hour_s: int) -> list[str]:
    """Broken rules of a retention policy."""
    rules = {"raw_below_a_day": raw_s < 86_400, "minute_below_30_days": minute_s < 30 * 86_400, "raw_over_minute": raw_s > minute_s, "hour_under_minute": hour_s < minute_s}
    return [k for k, broken in rules.items() if broken]


def latest_by(rows: DataFrame, key: str, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The row of each key that is last by ``order``, without sorting."""
    return rows.groupBy(key).agg(F.max(F.struct(*order, *keep)).alias("r")).select(key, *[f"r.{c}" for c in keep])


def all_of(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
