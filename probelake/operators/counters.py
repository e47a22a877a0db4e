"""Interface counters: deltas, rates, resets, generations, rollups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.functions.scalars import any_positive, epoch_bucket, whole

NAMES = ["rx_bytes", "tx_bytes", "rx_packets", "tx_packets", "rx_errors", "tx_errors", "rx_dropped", "tx_dropped", "rx_missed", "rx_fifo", "tx_fifo", "rx_crc", "rx_frame", "tx_carrier", "collisions"]
ERRORS = ["rx_errors", "tx_errors", "rx_crc", "rx_frame", "rx_fifo", "tx_fifo", "tx_carrier", "collisions"]
DROPS = ["rx_dropped", "tx_dropped", "rx_missed"]


def _in_order() -> Window:
    return Window.partitionBy("name").orderBy(F.asc_nulls_last("sampled_at_us"), F.asc_nulls_last("event_id"))


def _decreased(counters: Sequence[str], w: Window) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c) < F.lag(c).over(w), F.lit(False)) for c in counters])


def reset_reason(samples: DataFrame, counters: Sequence[str]) -> DataFrame:
    """Samples with reset_reason: identity_changed, counter_decreased or null."""
    w = _in_order()
    moved = F.coalesce(F.col("mac") != F.lag("mac").over(w), F.lit(False))
    return samples.withColumn("reset_reason", F.when(moved, "identity_changed").when(_decreased(counters, w), "counter_decreased"))


def ingest_reason(samples: DataFrame, counters: Sequence[str]) -> DataFrame:
    """Samples in the order of their event_id with the reason for which their generation could not go on."""
    w = Window.partitionBy("name").orderBy("event_id")
    moved = F.col("mac") != F.lag("mac").over(w)
    late = F.col("sampled_at_us") <= F.lag("sampled_at_us").over(w)
    reason = F.when(moved, "collector_restart_or_identity_change").when(late, "non_monotonic_sample_time").when(_decreased(counters, w), "counter_decreased_while_stopped")
    return samples.withColumn("reset_reason", reason)


def with_generation(samples: DataFrame, counters: Sequence[str]) -> DataFrame:
    """Samples with the number of their generation; each reset begins one."""
    marked = reset_reason(samples, counters)
    run = F.sum(F.when(F.col("reset_reason").isNotNull(), 1).otherwise(0)).over(_in_order().rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("generation", run.cast("long"))


def generations(with_gen: DataFrame) -> DataFrame:
    """[started, ended) of each generation; the last one is open."""
    g = with_gen.groupBy("name", "generation").agg(F.min("sampled_at_us").alias("started_at_us"), F.first("mac").alias("mac"), F.count("*").alias("samples"))
    return g.withColumn("ended_at_us", F.lead("started_at_us").over(Window.partitionBy("name").orderBy("generation")))


def open_generations(with_gen: DataFrame) -> DataFrame:
    """name and open, the number of its last generation, which may have no time to end the one before it at."""
    return with_gen.groupBy("name").agg(F.max("generation").alias("open"))


def deltas(with_gen: DataFrame, counters: Sequence[str]) -> DataFrame:
    """Differences from the sample before in the same generation; the later sample owns them.  Times that do not go up are left out."""
    w = Window.partitionBy("name", "generation").orderBy("sampled_at_us", "event_id")
    prev = F.lag("sampled_at_us").over(w)
    out = with_gen.select("name", "generation", "sampled_at_us", "event_id", prev.alias("prev_us"), *[(F.col(c) - F.lag(c).over(w)).alias(f"{c}_delta") for c in counters])
    return out.where(F.col("sampled_at_us") > F.col("prev_us")).withColumn("elapsed_us", F.col("sampled_at_us") - F.col("prev_us"))


def rates(d: DataFrame) -> DataFrame:
    """Megabits a second, and whole bytes a second held to [0, 2**63 - 1]."""
    per_s = lambda c: F.greatest(whole(F.col(c) * 1_000_000, F.col("elapsed_us")), F.lit(0))
    mbps = lambda c: F.col(c) * 8 / (F.col("elapsed_us") / 1e6) / 1e6
    return d.select("*", *[mbps(f"{x}_bytes_delta").alias(f"{x}_mbps") for x in ("rx", "tx")], *[per_s(f"{x}_bytes_delta").alias(f"{x}_bytes_per_s") for x in ("rx", "tx")])


def rollup(with_gen: DataFrame, counters: Sequence[str], width_us: int) -> DataFrame:
    """Per interface, generation and bucket: deltas, elapsed time, samples, resets and peaks."""
    keys = ["name", "generation", "bucket_us"]
    bucket = epoch_bucket(F.col("sampled_at_us"), width_us).alias("bucket_us")
    seen = with_gen.groupBy("name", "generation", bucket).agg(F.count("*").alias("sample_count"), F.count("reset_reason").alias("reset_count"))
    moved = rates(deltas(with_gen, counters)).groupBy("name", "generation", bucket).agg(
        F.sum("elapsed_us").alias("elapsed_us"), *[F.sum(f"{c}_delta").alias(f"{c}_delta") for c in counters], F.max("rx_bytes_per_s").alias("peak_rx_bytes_per_s"), F.max("tx_bytes_per_s").alias("peak_tx_bytes_per_s")
    )
    return seen.join(moved, keys, "left")


def merge_rollups(r: DataFrame, counters: Sequence[str], width_us: int) -> DataFrame:
    """Rollups merged to a wider bucket: sums, and the greatest peaks."""
    return r.groupBy("name", "generation", epoch_bucket(F.col("bucket_us"), width_us).alias("bucket_us")).agg(
        *[F.sum(c).alias(c) for c in ("sample_count", "reset_count", "elapsed_us", *[f"{c}_delta" for c in counters])], *[F.max(c).alias(c) for c in ("peak_rx_bytes_per_s", "peak_tx_bytes_per_s")]
    )


def series(with_gen: DataFrame, counters: Sequence[str], width_us: int, from_us: int, to_us: int) -> DataFrame:
    """Display buckets per interface: peak rates, delta sums, resets from reset events only; a bucket over an edge is partial."""
    bucket = epoch_bucket(F.col("sampled_at_us"), width_us).alias("bucket_us")
    inside = (F.col("sampled_at_us") >= from_us) & (F.col("sampled_at_us") < to_us)
    moved = rates(deltas(with_gen, counters)).where(inside).groupBy("name", bucket).agg(F.max("rx_mbps").alias("rx_mbps"), F.max("tx_mbps").alias("tx_mbps"), *[F.sum(f"{c}_delta").alias(c) for c in counters])
    resets = with_gen.where(inside & F.col("reset_reason").isNotNull()).groupBy("name", bucket).agg(F.count("*").alias("reset_count"))
    out = moved.withColumn("has_deltas", F.lit(True)).join(resets, ["name", "bucket_us"], "full")
    edge = (F.col("bucket_us") < from_us) | (F.col("bucket_us") + width_us > to_us)
    return out.select("name", "bucket_us", "rx_mbps", "tx_mbps", *counters, F.coalesce("has_deltas", F.lit(False)).alias("has_deltas"), F.coalesce("reset_count", F.lit(0)).cast("long").alias("reset_count"), edge.alias("edge_partial"))


def signal(points: DataFrame) -> DataFrame:
    """Points with has_errors, has_drops and signal."""
    have = set(points.columns)
    errors, drops = any_positive(*[c for c in ERRORS if c in have]), any_positive(*[c for c in DROPS if c in have])
    return points.select("*", errors.alias("has_errors"), drops.alias("has_drops"), (errors | drops | (F.col("reset_count") > 0)).alias("signal"))


def timeline(found: DataFrame) -> DataFrame:
    """name, bucket_us and place of all signals in order of time and name.

    Numbered within each day, after the signals of the days before; only the
    days' counts, one row each, are ever in one place.
    """
    found = found.select("name", "bucket_us", F.floor(F.col("bucket_us") / 86_400_000_000).alias("_day"))
    days = found.groupBy("_day").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("_day", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_day").orderBy("bucket_us", "name")) + F.col("_before")
    return found.join(F.broadcast(days), "_day").select(place.alias("place"), "name", "bucket_us")


def dense_slots(points: DataFrame, width_us: int, from_us: int, to_us: int) -> DataFrame:
    """Every display slot of every interface, clipped to the bounds, with its point if there is one."""
    first = from_us - from_us % width_us
    slots = points.select("name").distinct().withColumn("bucket_us", F.explode(F.sequence(F.lit(first), F.lit(to_us - 1), F.lit(width_us)).cast("array<bigint>")))
    at = F.col("bucket_us")
    slots = slots.withColumn("slot_from_us", F.greatest(at, F.lit(from_us))).withColumn("slot_to_us", F.least(at + width_us, F.lit(to_us)))
    return slots.join(points, ["name", "bucket_us"], "left")


def reset_details(with_gen: DataFrame, limit: int = 100) -> DataFrame:
    """The latest resets of each interface, how many there are, and whether some are left out."""
    w = Window.partitionBy("name")
    resets = with_gen.where("reset_reason is not null").withColumn("place", F.row_number().over(w.orderBy(F.desc("sampled_at_us"), F.desc("event_id")))).withColumn("total", F.count("*").over(w))
    return resets.where(F.col("place") <= limit).select("name", "place", F.col("sampled_at_us").alias("at_us"), "reset_reason", "total", (F.col("total") > limit).alias("truncated"))


def missing_interfaces(samples: DataFrame, configured: DataFrame, tick_us: int) -> DataFrame:
    """First tick of each stretch of ticks at which a configured interface has no sample while others have.

    Each sighting is met with the tick that comes next for anyone: if the
    interface's own next sighting is later, it is missing from there on.  So
    nothing is made for every pair of tick and interface.
    """
    seen = samples.select("name", epoch_bucket(F.col("sampled_at_us"), tick_us).alias("tick_us")).distinct().join(configured.select("name").distinct(), "name", "left_semi")
    ticks = samples.select(epoch_bucket(F.col("sampled_at_us"), tick_us).alias("tick_us")).distinct()
    # Distinct ticks are few: one for each step of the clock, however many interfaces there are.
    ticks = ticks.withColumn("next_us", F.lead("tick_us").over(Window.orderBy("tick_us")))
    own_next = F.lead("tick_us").over(Window.partitionBy("name").orderBy("tick_us"))
    after = seen.withColumn("own_next", own_next).join(ticks, "tick_us").where("next_us is not null and (own_next is null or own_next > next_us)").select("name", F.col("next_us").alias("at_us"))
    first = ticks.agg(F.min("tick_us").alias("first_us"))
    begin = configured.select("name").distinct().join(seen.groupBy("name").agg(F.min("tick_us").alias("own_first")), "name", "left").crossJoin(F.broadcast(first))  # one row
    late = begin.where("first_us is not null and (own_first is null or own_first > first_us)").select("name", F.col("first_us").alias("at_us"))
    return after.unionByName(late)


def thin(samples: DataFrame, interval_us: int) -> DataFrame:
    """Samples at least an interval after the last one kept, of each interface.

    Spark sorts each interface's samples; a task jumps from one kept sample to the
    next and carries only the last one kept, so an interface's history may be of any length.
    """
    ordered = samples.select("name", "sampled_at_us").repartition("name").sortWithinPartitions("name", "sampled_at_us")

    def jump(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, last = None, None
        for batch in batches:
            at = batch["sampled_at_us"].to_numpy()
            names = batch["name"].to_numpy()
            same = (names[1:] == names[:-1]) | (pd.isna(names[1:]) & pd.isna(names[:-1]))
            edge = np.r_[0, np.flatnonzero(~same) + 1, len(at)]
            keep = []
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if last is None or not (names[s] == name or pd.isna(names[s]) and pd.isna(name)):
                    name, last = names[s], None
                i = s if last is None else s + int(np.searchsorted(at[s:e], last + interval_us))
                while i < e:
                    keep.append(i)
                    last = int(at[i])
                    i = max(i + 1, s + int(np.searchsorted(at[s:e], last + interval_us)))
            yield batch.iloc[keep]

    return ordered.mapInPandas(jump, ordered.schema)


def latest(with_gen: DataFrame, configured: DataFrame) -> DataFrame:
    """Configured interfaces with their newest sample, and whether its generation is the open one."""
    newest = with_gen.groupBy("name").agg(F.max(F.struct("sampled_at_us", "event_id", "generation", "rx_bytes")).alias("s"))
    out = configured.join(newest, "name", "left").join(open_generations(with_gen), "name", "left")
    return out.select("name", F.col("s.sampled_at_us").alias("sampled_at_us"), F.col("s.generation").alias("generation"), F.col("s.rx_bytes").alias("rx_bytes"), F.coalesce(F.col("s.generation") == F.col("open"), F.lit(False)).alias("present"))
