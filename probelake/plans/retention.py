"""Retention: what may go from each tier, what goes under disk pressure, and a pass that deletes it.

A row goes only if it is old and the next tier covers it.  ``expired`` and
``pressed`` name the rows; ``Pruner`` writes the survivors of the days that lose rows,
swaps them in and moves the watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelake.functions.scalars import epoch_bucket
from probelake.operators.gaps import gap_end
from probelake.plans import swap

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000
KEYS = ["target_id", "bucket_us"]
IFACE = ["name", "generation", "bucket_us"]


def _down(t: int, width: int) -> int:
    return t - t % width


def cutoffs(now_us: int, raw_us: int, minute_us: int, hour_us: int, trace_us: int) -> dict[str, int]:
    """The time before which each tier goes: raw rows by whole minutes, the others by whole hours."""
    return {"raw": _down(now_us - raw_us, MINUTE), "minute": _down(now_us - minute_us, HOUR), "hour": _down(now_us - hour_us, HOUR), "trace": now_us - trace_us, "change": _down(now_us - hour_us, HOUR)}


def pressure_cutoffs(now_us: int, most_timeout_ns: int) -> dict[str, int]:
    """Cutoffs under disk pressure: raw rows and traces of a day, but never of probes that may still be open; rollups of 30 days."""
    floor = max(DAY, most_timeout_ns // 1000 + MINUTE)
    month = _down(now_us - 30 * DAY, HOUR)
    return {"raw": _down(now_us - floor, MINUTE), "minute": month, "hour": month, "trace": now_us - DAY, "change": month}


def _covered(rows: DataFrame, at: str, width: int, keys: list[str], by: DataFrame, dirty: DataFrame) -> DataFrame:
    """Rows whose bucket of the next tier is stored and clean."""
    parent = [*keys[:-1], "_parent_us"]
    named = lambda df: df.select(*keys[:-1], F.col("bucket_us").alias("_parent_us")).distinct()
    return rows.withColumn("_parent_us", epoch_bucket(F.col(at), width)).join(named(by), parent, "left_semi").join(named(dirty), parent, "left_anti").drop("_parent_us")


def covered_raw(probes: DataFrame, minutes: DataFrame, dirty: DataFrame, cutoff_us: int) -> DataFrame:
    """Probes scheduled and sent before the cutoff whose minute is rolled up and clean."""
    old = probes.where((F.col("scheduled_at_us") < cutoff_us) & (F.col("sent_at_us") < cutoff_us))
    return _covered(old, "scheduled_at_us", MINUTE, KEYS, minutes, dirty)


def covered_minutes(minutes: DataFrame, hours: DataFrame, dirty_hours: DataFrame, cutoff_us: int) -> DataFrame:
    """Minute rollups before the cutoff whose hour is rolled up and clean."""
    return _covered(minutes.where(F.col("bucket_us") < cutoff_us), "bucket_us", HOUR, KEYS, hours, dirty_hours)


def covered_samples(samples: DataFrame, minutes: DataFrame, dirty: DataFrame, cutoff_us: int) -> DataFrame:
    """Counter samples (name, generation, sampled_at_us) before the cutoff whose minute is rolled up and clean."""
    return _covered(samples.where(F.col("sampled_at_us") < cutoff_us), "sampled_at_us", MINUTE, IFACE, minutes, dirty)


def covered_counter_minutes(minutes: DataFrame, hours: DataFrame, dirty_hours: DataFrame, cutoff_us: int) -> DataFrame:
    return _covered(minutes.where(F.col("bucket_us") < cutoff_us), "bucket_us", HOUR, IFACE, hours, dirty_hours)


def covered_gaps(gaps: DataFrame, dirty: DataFrame, cutoff_us: int) -> DataFrame:
    """Gaps that end before the cutoff and have no dirty minute from their first to their last.

    A gap meets the dirty minutes of the days that it spans, and nothing else of its length matters.
    """
    old = gaps.where(gap_end() < cutoff_us)
    day = lambda t: epoch_bucket(t, DAY)
    spread = old.select("target_id", "first_us", gap_end().alias("last_us"), F.explode(F.sequence(day(F.col("first_us")), day(gap_end()), F.lit(DAY).cast("long"))).alias("day_us"))
    spots = dirty.select("target_id", "bucket_us", day(F.col("bucket_us")).alias("day_us")).distinct()
    near = (F.col("bucket_us") >= epoch_bucket(F.col("first_us"), MINUTE)) & (F.col("bucket_us") <= F.col("last_us"))
    held = spread.join(spots, ["target_id", "day_us"]).where(near).select("target_id", "first_us").distinct()
    return old.join(held, ["target_id", "first_us"], "left_anti")


def referenced(changes: DataFrame, current: DataFrame) -> DataFrame:
    """trace_id of every trace that a change or a current or candidate route names."""
    ids = [changes.select(F.col(c).alias("trace_id")) for c in ("old_trace_id", "candidate_trace_id", "confirming_trace_id")]
    ids += [current.select(F.col(c).alias("trace_id")) for c in ("current_trace_id", "candidate_trace_id")]
    return reduce(DataFrame.union, ids).where("trace_id is not null").distinct()


def unreferenced_traces(runs: DataFrame, changes: DataFrame, current: DataFrame, cutoff_us: int) -> DataFrame:
    """Trace runs that ended before the cutoff and that neither a change nor a current route names."""
    return runs.where(F.col("ended_at_us") < cutoff_us).join(referenced(changes, current), "trace_id", "left_anti")


def later_of_day(runs: DataFrame, changes: DataFrame, current: DataFrame, cutoff_us: int) -> DataFrame:
    """Of the unreferenced traces before the cutoff those that are not their target's first, by trace_id, of the day they started on."""
    day = F.floor(F.col("started_at_us") / DAY).alias("_day")
    first = runs.groupBy("target_id", day).agg(F.min("trace_id").alias("_first"))
    old = unreferenced_traces(runs, changes, current, cutoff_us).withColumn("_day", F.floor(F.col("started_at_us") / DAY))
    return old.join(first, ["target_id", "_day"]).where("trace_id > _first").drop("_day", "_first")


@dataclass
class Tables:
    """Everything that retention looks at.  Dirty tables hold keys: (target_id, bucket_us), or (name, generation, bucket_us) of interfaces."""

    raw: DataFrame
    gap: DataFrame
    minute: DataFrame
    hour: DataFrame
    dirty_minute: DataFrame
    dirty_hour: DataFrame
    iface_raw: DataFrame
    iface_minute: DataFrame
    iface_hour: DataFrame
    iface_dirty_minute: DataFrame
    iface_dirty_hour: DataFrame
    trace: DataFrame
    route_change: DataFrame
    current_route: DataFrame
    #: Changes that passes of the same cutoff deleted (``Pruner``): for them they still name their traces.
    deleted_change: DataFrame | None = None

    def changes(self) -> DataFrame:
        return self.route_change if self.deleted_change is None else self.route_change.unionByName(self.deleted_change)


#: Tiers in the order in which they are pruned: the day column's source, and what tells rows apart.
TIERS = {
    "raw": ("scheduled_at_us", ["target_id", "sequence"]),
    "gap": ("first_us", ["target_id", "first_us"]),
    "iface_raw": ("sampled_at_us", ["name", "generation", "event_id"]),
    "minute": ("bucket_us", KEYS),
    "iface_minute": ("bucket_us", IFACE),
    "hour": ("bucket_us", KEYS),
    "iface_hour": ("bucket_us", IFACE),
    "trace": ("started_at_us", ["trace_id"]),
    "route_change": ("confirmed_at_us", ["target_id", "confirmed_at_us", "confirming_trace_id"]),
}


def _goes(t: Tables, cut: dict[str, int], trace: DataFrame) -> dict[str, DataFrame]:
    old = lambda df, at, c: df.where(F.col(at) < c)
    return {
        "raw": covered_raw(t.raw, t.minute, t.dirty_minute, cut["raw"]),
        "gap": covered_gaps(t.gap, t.dirty_minute, cut["raw"]),
        "iface_raw": covered_samples(t.iface_raw, t.iface_minute, t.iface_dirty_minute, cut["raw"]),
        "minute": covered_minutes(t.minute, t.hour, t.dirty_hour, cut["minute"]),
        "iface_minute": covered_counter_minutes(t.iface_minute, t.iface_hour, t.iface_dirty_hour, cut["minute"]),
        "hour": old(t.hour, "bucket_us", cut["hour"]),
        "iface_hour": old(t.iface_hour, "bucket_us", cut["hour"]),
        "trace": trace,
        "route_change": old(t.route_change, "confirmed_at_us", cut["change"]),
    }


def expired(t: Tables, cut: dict[str, int]) -> dict[str, DataFrame]:
    """Rows that regular retention deletes, by tier in order."""
    return _goes(t, cut, unreferenced_traces(t.trace, t.changes(), t.current_route, cut["trace"]))


def pressed(t: Tables, cut: dict[str, int]) -> dict[str, DataFrame]:
    """Rows that go under disk pressure, by stage in order: raw rows and all traces of a day but one first, rollups last."""
    found = _goes(t, cut, later_of_day(t.trace, t.changes(), t.current_route, cut["trace"]))
    return {k: found[k] for k in ("raw", "gap", "iface_raw", "trace", "minute", "iface_minute", "hour", "iface_hour", "route_change")}


def counts(**parts: DataFrame) -> DataFrame:
    """Rows to delete by tier."""
    out = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("tier"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def pruned_through(cutoff_us: int, left: DataFrame, before_us: int) -> DataFrame:
    """The watermark after a pass: the cutoff if no probe sent before it is left, else what it was; it never goes back."""
    remains = left.where(F.col("sent_at_us") < cutoff_us).agg(F.count("*").alias("n"))
    return remains.select(F.greatest(F.lit(before_us), F.when(F.col("n") == 0, F.lit(cutoff_us)).otherwise(F.lit(before_us))).cast("long").alias("pruned_through_us"), "n")


class Pruner:
    """Deletes rows of tiers that are Parquet tables ``root/<tier>``, partitioned by day_us.

    First the survivors of all tiers' touched days are staged, from the tables as they
    are; then a marker says that all are; then they are swapped in one by one, and the
    watermark, a table of one row, moves.  A pass that died before the marker is dropped by the
    next one and one that died after it is finished, so a pass is done wholly or not at all, and
    twice is as good as once.  One pass at a time.

    Deleted route changes are kept until a pass of a later cutoff, so that a pass done
    again does not delete the traces that they named when it was done first; the later pass does.
    """

    def __init__(self, spark: SparkSession, root: str, tiers: Sequence[str] = tuple(TIERS)):
        self.spark, self.root, self.tiers = spark, root, tiers
        self.work = f"{root}/pass"

    def path(self, tier: str) -> str:
        return f"{self.root}/{tier}"

    def write(self, tier: str, rows: DataFrame) -> None:
        """A tier's first rows; an empty table keeps the schema, as a tier may lose all its rows."""
        placed = rows.withColumn("day_us", epoch_bucket(F.col(TIERS[tier][0]), DAY))
        placed.limit(0).coalesce(1).write.parquet(f"{self.root}/schema/{tier}")
        placed.hint("rebalance", "day_us").write.partitionBy("day_us").parquet(self.path(tier))

    def _stored(self, tier: str) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.root}/schema/{tier}").schema
        return self.spark.read.schema(schema).parquet(self.path(tier))

    def read(self, tier: str) -> DataFrame:
        return self._stored(tier).drop("day_us")

    def _through(self, name: str) -> list[int]:
        """The cutoffs of the folders ``root/<name>/through-<cutoff>``."""
        return [int(c.rsplit("-", 1)[-1]) for c in swap.children(self.spark, f"{self.root}/{name}")]

    def watermark(self) -> int:
        return max(self._through("watermark"), default=0)

    def deleted_changes(self, cutoff_us: int) -> DataFrame:
        """Route changes that passes of this cutoff or a later one deleted; earlier ones are forgotten."""
        schema = self.read("route_change").schema
        found = self.spark.createDataFrame([], schema)
        for through in self._through("deleted"):
            path = f"{self.root}/deleted/through-{through}"
            if through < cutoff_us:
                swap.delete(self.spark, path)
            else:
                found = found.unionByName(self.spark.read.schema(schema).parquet(path))
        return found

    def stage(self, gone: dict[str, DataFrame], cutoff_us: int) -> None:
        """Everything a pass will change, complete once the marker is there."""
        for tier, rows in gone.items():
            at, keys = TIERS[tier]
            day = epoch_bucket(F.col(at), DAY).alias("day_us")
            touched = rows.select(day).distinct()
            there = self._stored(tier).join(F.broadcast(touched), "day_us", "left_semi")  # days: few rows
            same = reduce(lambda a, b: a & b, [F.col(f"there.{k}").eqNullSafe(F.col(f"gone.{k}")) for k in keys])
            stay = there.alias("there").join(rows.select(*keys).distinct().alias("gone"), same, "left_anti")
            if tier == "route_change":
                rows.write.mode("append").parquet(f"{self.root}/deleted/through-{cutoff_us}")
            touched.write.parquet(f"{self.work}/{tier}/touched")
            stay.hint("rebalance", "day_us").write.partitionBy("day_us").parquet(f"{self.work}/{tier}/rows")
        self.spark.range(1).select(F.lit(cutoff_us).alias("cutoff_us")).coalesce(1).write.parquet(f"{self.work}/ready")

    def finish(self) -> None:
        """Swap in what a complete pass staged, or drop what an incomplete one did."""
        if swap.exists(self.spark, f"{self.work}/ready/_SUCCESS"):
            for tier in self.tiers:
                if swap.exists(self.spark, f"{self.work}/{tier}/rows/_SUCCESS"):
                    swap.swap(self.spark, self.path(tier), f"{self.work}/{tier}", ["day_us"])
            cutoff = self.spark.read.parquet(f"{self.work}/ready").first()["cutoff_us"]
            moved = pruned_through(cutoff, self.read("raw"), self.watermark()).first()["pruned_through_us"]
            # Its name is its value, so writing it again changes nothing and it never goes back.
            self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/watermark/through-{moved}")
        swap.delete(self.spark, self.work)

    def run(self, goes: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], cutoff_us: int) -> None:
        """One pass: ``goes`` gives the rows to delete by tier from the tables by tier (and ``deleted_change``), which are read after an earlier pass was finished."""
        self.finish()
        mine = {tier: self.read(tier) for tier in self.tiers}
        if "route_change" in mine:
            mine["deleted_change"] = self.deleted_changes(cutoff_us)
        self.stage(goes(mine), cutoff_us)
        self.finish()
