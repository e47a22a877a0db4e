"""The overview of all targets: states, recent windows, trends, routes, interfaces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.functions import sketch
from probelake.functions.scalars import epoch_bucket, ms, percent, whole
from probelake.operators.gaps import gap_counts, gap_end, slots_within
from probelake.operators.probes import classified, tally


def latest_samples(probes: DataFrame) -> DataFrame:
    """Each target's newest sample, by a maximum and without a sort."""
    keep = ["local_outcome", "reply_class", "rtt_ns", "timeout_ns", "sent_at_us", "endpoint"]
    newest = probes.groupBy("target_id").agg(F.max_by(F.struct("scheduled_at_us", "sequence", *keep), F.struct("scheduled_at_us", "sequence")).alias("s"))
    return newest.select("target_id", "s.*")


def latest_gaps(gaps: DataFrame) -> DataFrame:
    """Each target's gap that ends last."""
    return gaps.withColumn("last_us", gap_end()).groupBy("target_id").agg(F.max(F.struct("last_us", "first_us", "missed_count")).alias("g")).select("target_id", F.col("g.first_us").alias("gap_first_us"), F.col("g.last_us").alias("gap_last_us"), "g.missed_count")


def states(targets: DataFrame, probes: DataFrame, gaps: DataFrame, as_of_us: int) -> DataFrame:
    """State of every target (target_id, interval_ns, timeout_ns): its newest gap or sample decides, unless that is stale."""
    rows = targets.join(latest_samples(probes).withColumnRenamed("timeout_ns", "sample_timeout_ns"), "target_id", "left").join(latest_gaps(gaps).select("target_id", "gap_last_us"), "target_id", "left")
    limit = whole(F.greatest(3 * F.col("interval_ns"), F.col("timeout_ns") + F.col("interval_ns")), 1000)
    gap_is_newer = F.col("gap_last_us").isNotNull() & (F.col("scheduled_at_us").isNull() | (F.col("gap_last_us") > F.col("scheduled_at_us")))
    last = F.when(gap_is_newer, F.col("gap_last_us")).otherwise(F.col("scheduled_at_us"))
    answered = F.when(F.col("rtt_ns") > F.col("sample_timeout_ns"), "late").otherwise("up")
    state = (
        F.when(last.isNull(), "unknown")
        .when(F.lit(as_of_us) - last > limit, "stale")
        .when(gap_is_newer, "scheduler_gap")
        .when(F.col("local_outcome").isNotNull(), "send_error")
        .when(F.col("reply_class").isNotNull(), answered)
        .when(F.lit(as_of_us) >= F.col("sent_at_us") + whole(F.col("sample_timeout_ns"), 1000), "down")
        .otherwise("pending")
    )
    return rows.select("target_id", state.alias("state"), last.alias("last_scheduled_us"), F.when(state.isin("late", "up"), ms(F.col("rtt_ns"))).alias("last_rtt_ms"))


def _missed(gaps: DataFrame, from_us: int, to_us: int) -> DataFrame:
    return gaps.select("target_id", slots_within(F.lit(from_us), F.lit(to_us)).alias("m")).groupBy("target_id").agg(F.sum("m").alias("missed"))


RECENT = ["attempted", "sent", "pending", "on_time", "late", "unanswered", "send_errors", "missed", "rtt_count"]


def _summary(targets: DataFrame, agg: DataFrame, hist: DataFrame) -> DataFrame:
    """The window's counts of every target, with quantile and shares."""
    p95 = sketch.quantiles(hist, ["target_id"], {"p95_ns": 0.95})
    out = targets.select("target_id").join(agg, "target_id", "left").join(p95, "target_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = out.select("target_id", *[n(c).alias(c) for c in RECENT], ms(F.col("p95_ns")).alias("p95_ms"))
    return out.select(
        "*",
        (F.col("attempted") + F.col("missed")).alias("scheduled"),
        (F.col("sent") - F.col("pending")).alias("settled"),
        percent(F.col("late") + F.col("unanswered"), F.col("sent")).alias("deadline_miss_pct"),
        percent(F.col("unanswered"), F.col("sent")).alias("no_reply_pct"),
    )


def recent(targets: DataFrame, probes: DataFrame, gaps: DataFrame, from_us: int, to_us: int, as_of_us: int) -> DataFrame:
    """Exact summary of the window for every target; shares are null where nothing was sent."""
    inside = classified(probes.where((F.col("scheduled_at_us") >= from_us) & (F.col("scheduled_at_us") < to_us)), as_of_us)
    agg = inside.groupBy("target_id").agg(*tally()).join(_missed(gaps, from_us, to_us), "target_id", "full")
    return _summary(targets, agg, sketch.build(inside, ["target_id"], "rtt_ns"))


def _trend_width(from_us: int, to_us: int) -> int:
    return max(60_000_000, -(-(to_us - from_us) // 15))


def _dense(targets: DataFrame, agg: DataFrame, width: int, from_us: int, to_us: int) -> DataFrame:
    """Every bucket of the window for every target, clipped at its ends."""
    first = from_us - from_us % width
    slots = targets.select("target_id", F.explode(F.sequence(F.lit(first), F.lit(to_us - 1), F.lit(width)).cast("array<bigint>")).alias("bucket_us"))
    start, end = F.greatest("bucket_us", F.lit(from_us)), F.least(F.col("bucket_us") + width, F.lit(to_us))
    out = slots.join(agg, ["target_id", "bucket_us"], "left")
    return out.select("target_id", start.cast("long").alias("from_us"), end.cast("long").alias("to_us"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("sent", "late", "unanswered", "send_errors", "missed")])


def trend(targets: DataFrame, probes: DataFrame, gaps: DataFrame, from_us: int, to_us: int, as_of_us: int) -> DataFrame:
    """Up to 16 dense buckets per target over the window, epoch aligned and clipped at its ends, empty ones too."""
    width = _trend_width(from_us, to_us)
    inside = classified(probes.where((F.col("scheduled_at_us") >= from_us) & (F.col("scheduled_at_us") < to_us)), as_of_us)
    agg = inside.groupBy("target_id", epoch_bucket(F.col("scheduled_at_us"), width).alias("bucket_us")).agg(*tally())
    return _dense(targets, agg.join(gap_counts(gaps, width, from_us, to_us), ["target_id", "bucket_us"], "full"), width, from_us, to_us)


class StoredWindow:
    """The window of all targets from stored minutes (with hist), and raw rows only where these do not answer.

    Raw rows are read for the window's edges and for dirty minutes; every minute that
    rows came to since it was stored is dirty.  The distinct dirty minutes of the window
    become ranges of the scan's filter, so it reads those alone; they are at
    most the minutes of the window, however many targets there are.
    """

    def __init__(self, targets: DataFrame, probes: DataFrame, gaps: DataFrame, minutes: DataFrame, dirty: DataFrame, from_us: int, to_us: int, as_of_us: int):
        minute, at = 60_000_000, F.col("scheduled_at_us")
        self.targets, self.from_us, self.to_us = targets, from_us, to_us
        first, last = -(-from_us // minute) * minute, to_us - to_us % minute
        inside = (F.col("bucket_us") >= first) & (F.col("bucket_us") < last)
        keys = ["target_id", "bucket_us"]
        unclean = dirty.where(inside).select(*keys).distinct()
        again = sorted(r["bucket_us"] for r in unclean.select("bucket_us").distinct().collect())
        ranges = [(from_us, min(first, to_us)), (max(last, from_us), to_us)]
        for t in again:  # neighbours become one range
            if len(ranges) > 2 and ranges[-1][1] == t:
                ranges[-1] = ranges[-1][0], t + minute
            else:
                ranges.append((t, t + minute))
        ranges = [(a, b) for a, b in ranges if a < b]
        where = lambda c: reduce(lambda x, y: x | y, [(c >= a) & (c < b) for a, b in ranges], F.lit(False))
        read = classified(probes.where(where(at)), as_of_us).withColumn("bucket_us", epoch_bucket(at, minute))
        # In a dirty minute only the targets that it is dirty for; at the edges all.
        edge = (F.col("bucket_us") < first) | (F.col("bucket_us") >= last)
        read = read.join(unclean.withColumn("dirty", F.lit(True)), keys, "left").where(edge | F.col("dirty"))
        missed = gap_counts(gaps, minute, from_us, to_us)
        missed = missed.where(edge).unionByName(missed.where(inside).join(unclean, keys, "left_semi"))
        agg = read.groupBy(*keys).agg(*tally()).join(missed, keys, "full")
        clean = minutes.where(inside).join(unclean, keys, "left_anti")
        zero = lambda df: df.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) if c in df.columns else F.lit(0).alias(c) for c in RECENT])
        self.counts = zero(clean).unionByName(zero(agg))
        packed = sketch.unpack(clean, keys).groupBy("target_id", "bin").agg(F.sum("n").alias("n"))
        self.hist = sketch.merge(packed.unionByName(sketch.build(read, ["target_id"], "rtt_ns")), ["target_id"])

    def recent(self) -> DataFrame:
        """As ``recent`` of raw rows."""
        agg = self.counts.groupBy("target_id").agg(*[F.sum(c).alias(c) for c in RECENT])
        return _summary(self.targets, agg, self.hist)

    def trend(self) -> DataFrame:
        """As ``trend`` of raw rows where buckets are whole minutes; else a minute counts where it starts."""
        width = _trend_width(self.from_us, self.to_us)
        agg = self.counts.withColumn("bucket_us", epoch_bucket(F.col("bucket_us"), width)).groupBy("target_id", "bucket_us").agg(*[F.sum(c).alias(c) for c in RECENT])
        return _dense(self.targets, agg, width, self.from_us, self.to_us)


def route_summary(targets: DataFrame, traces: DataFrame, changes: DataFrame, from_us: int, to_us: int) -> DataFrame:
    """Traces, reached, unreached, errors, last trace, changes and last change of the window for every target."""
    done = F.col("status") == "completed"
    inside = lambda c: (F.col(c) >= from_us) & (F.col(c) < to_us)
    t = traces.where(inside("started_at_us")).groupBy("target_id").agg(F.count("*").alias("traces"), F.count_if(done & F.col("reached")).alias("reached"), F.count_if(done & ~F.col("reached")).alias("unreached"), F.count_if(~done).alias("errors"), F.max("started_at_us").alias("last_trace_us"))
    c = changes.where(inside("confirmed_at_us")).groupBy("target_id").agg(F.count("*").alias("changes"), F.max("confirmed_at_us").alias("last_change_us"))
    out = targets.select("target_id").join(t, "target_id", "left").join(c, "target_id", "left")
    return out.select("target_id", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("traces", "reached", "unreached", "errors", "changes")], "last_trace_us", "last_change_us")


def interface_summary(moved: DataFrame, with_gen: DataFrame, counters: list[str], from_us: int, to_us: int) -> DataFrame:
    """Per interface: peak rates, delta sums, resets, flags, and whether a delta reaches over the window's start."""
    inside = (F.col("sampled_at_us") >= from_us) & (F.col("sampled_at_us") < to_us)
    a = moved.where(inside).groupBy("name").agg(F.max("rx_mbps").alias("rx_mbps"), F.max("tx_mbps").alias("tx_mbps"), *[F.sum(f"{c}_delta").alias(c) for c in counters], F.bool_or(F.col("prev_us") < from_us).alias("edge_partial"))
    r = with_gen.where(inside & F.col("reset_reason").isNotNull()).groupBy("name").agg(F.count("*").alias("reset_count"))
    out = a.withColumn("has_deltas", F.lit(True)).join(r, "name", "full")
    return out.select("name", "rx_mbps", "tx_mbps", *counters, F.coalesce("reset_count", F.lit(0)).cast("long").alias("reset_count"), F.coalesce("has_deltas", F.lit(False)).alias("has_deltas"), F.coalesce("edge_partial", F.lit(False)).alias("edge_partial"))


def flags(rows: DataFrame) -> DataFrame:
    """deadline, local, missing, obsessing and signal of rows that join state, window, routes and incident status."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    deadline, local = n("late") + n("unanswered") > 0, n("send_errors") + n("missed") > 0
    missing, obsessing = F.col("state").isin("unknown", "stale"), F.coalesce(F.col("incident_state") == "obsessing", F.lit(False))
    signal = F.col("state").isin("down", "late", "send_error", "scheduler_gap") | (n("errors") > 0) | (n("changes") > 0) | deadline | local | missing | obsessing
    return rows.select("*", deadline.alias("deadline"), local.alias("local"), missing.alias("missing"), obsessing.alias("obsessing"), signal.alias("signal"))


def find(rows: DataFrame, flag: str | None, text: str, sort: str, names: tuple[str, ...] = ("name", "stable_id", "address")) -> DataFrame:
    """Rows with the flag whose names hold the text in any case, sorted by name, deadline misses or p95, nulls last."""
    if flag:
        rows = rows.where(F.col(flag))
    hit: Column = F.lit(False)
    for c in names:
        hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    order = {"deadline": [F.col("deadline_miss_pct").desc_nulls_last()], "latency": [F.col("p95_ms").desc_nulls_last()]}.get(sort, [])
    return rows.where(hit).orderBy(*order, "name", "stable_id")


def flag_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("targets"), *[F.count_if(F.col(c)).alias(c) for c in ("deadline", "local", "missing", "obsessing", "signal")])


def header(points: DataFrame) -> DataFrame:
    """Per target: latest mean, loss shares of the whole window, probes sent."""
    agg = points.groupBy("target_id").agg(F.max_by("avg_ms", F.when(F.col("avg_ms").isNotNull(), F.col("bucket_us"))).alias("latest_ms"), F.sum("sent").alias("sent"), F.sum(F.col("late") + F.col("unanswered")).alias("missed_deadlines"), F.sum("unanswered").alias("unanswered"))
    return agg.select("target_id", "latest_ms", "sent", percent(F.col("missed_deadlines"), F.col("sent")).alias("deadline_miss_pct"), percent(F.col("unanswered"), F.col("sent")).alias("no_reply_pct"))
