"""Structured Streaming: reply reconciliation, rollup upkeep, incidents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from probelake.operators import incidents as O
from probelake.operators import ingest
from probelake.operators import routes as R
from probelake.operators.gaps import by_day, slot_minutes
from probelake.plans import stored, swap, tiers


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what there is into a Parquet sink, exactly once per checkpoint, and stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def reconcile_stream(sent: DataFrame, replies: DataFrame, slack: str = "10 minutes") -> DataFrame:
    """Sent probes with their valid replies, in either order of arrival; a probe without one comes out once the watermark passes it.

    ``sent`` has sequence, endpoint, sent_at; ``replies`` has sequence, responder,
    sent_at and rtt_ns.  State lives for ``slack`` of event time.  Duplicates within
    it are dropped; replies that miss it are left to the batch reconciliation.
    """
    s = sent.select("sequence", "target_id", "endpoint", "sent_at").withWatermark("sent_at", slack)
    r = replies.withWatermark("sent_at", slack).dropDuplicatesWithinWatermark(["sequence", "responder"]).select(F.col("sequence").alias("r_sequence"), "responder", F.col("sent_at").alias("r_sent_at"), "rtt_ns")
    same = (F.col("sequence") == F.col("r_sequence")) & (F.col("endpoint") == F.col("responder"))
    near = F.col("r_sent_at").between(F.col("sent_at") - F.expr("interval 1 second"), F.col("sent_at") + F.expr("interval 1 second"))
    return s.join(r, same & near, "left_outer").select("sequence", "target_id", "rtt_ns", F.col("r_sequence").isNotNull().alias("answered"))


DAY_US = 86_400_000_000
PROBES = "target_id long, scheduled_at_us long, sent_at_us long, timeout_ns long, local_outcome string, rtt_ns long, reply_class string"
GAPS = "target_id long, first_us long, interval_ns long, missed_count long"
PLACE = "day_us long, run string, batch long"
ROLLUP = f"target_id long, bucket_us long, attempted long, sent long, on_time long, late long, unanswered long, send_errors long, rtt_count long, missed long, rtt_sum_ns long, rtt_min_ns long, rtt_max_ns long, timeout_min_ns long, timeout_max_ns long, scheduled long, hist {stored.HIST}, resolution_s int, bucket_date date"


def _day(at_us: Column) -> Column:
    return at_us - F.pmod(at_us, F.lit(DAY_US))


class RollupUpkeep:
    """Keeps stored minutes and hours, counts and sketch, complete however late rows and gaps come: ``probes`` and ``gaps`` are foreachBatch functions.

    A batch's rows go to a folder of their own, named by day, stream and batch, so that a batch
    that runs again replaces itself and a stream that begins anew, from an empty
    checkpoint, replaces nothing.  A stream's name is the id that Spark keeps in its
    checkpoint, or ``run`` where it is called by hand.  Then the minutes that the batch
    touches, and the hours of these, are redone from all raw rows of theirs;
    partition pruning reads only their days.  Their days' stored rows are replaced
    through a staging folder, so a crash loses none; the next call finishes it.
    A gap run is stored by day, each part in its own.  With an evaluation time, probes that
    are open then are sent but not unanswered, and their minutes are to be made dirty once they settle.

    Streams may come in any order but one batch at a time: two at once would
    replace each other's days.
    """

    def __init__(self, raw_path: str, gap_path: str, rollup_path: str, run: str | None = None, as_of_us: int = tiers.SETTLED):
        self.raw_path, self.gap_path, self.rollup_path, self.run, self.as_of_us = raw_path, gap_path, rollup_path, run, as_of_us

    def probes(self, batch: DataFrame, batch_id: int) -> None:
        kept = batch.select(*[c.split()[0] for c in PROBES.split(", ")], _day(F.col("scheduled_at_us")).alias("day_us"))
        mine = self._stored(kept, self.raw_path, PROBES, batch_id)
        self._redo(tiers.dirty_buckets(mine))

    def gaps(self, batch: DataFrame, batch_id: int) -> None:
        mine = self._stored(by_day(batch), self.gap_path, GAPS, batch_id)
        self._redo(slot_minutes(mine))

    def _name(self, batch: DataFrame) -> str:
        return self.run or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"

    def _stored(self, rows: DataFrame, path: str, columns: str, batch_id: int) -> DataFrame:
        """The batch's rows, read back from where they are kept."""
        name = self._name(rows)
        placed = rows.withColumn("run", F.lit(name)).withColumn("batch", F.lit(batch_id))
        placed.hint("rebalance", "day_us").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day_us", "run", "batch").parquet(path)
        return rows.sparkSession.read.schema(f"{columns}, {PLACE}").parquet(path).where((F.col("run") == name) & (F.col("batch") == batch_id))

    def _raw(self, of_days: Callable[[str, str], DataFrame]) -> DataFrame:
        """The probes of the days that are redone."""
        return of_days(self.raw_path, PROBES)

    def _redo(self, dirty: DataFrame) -> None:
        spark = dirty.sparkSession
        by = ["resolution_s", "bucket_date"]
        swap.recover(spark, self.rollup_path, by)
        dates = F.broadcast(dirty.select(F.to_date(F.timestamp_micros("bucket_us")).alias("bucket_date")).distinct())  # days of one batch: a few rows
        days = F.broadcast(dirty.select(_day(F.col("bucket_us")).alias("day_us")).distinct())

        def of_days(path: str, columns: str, after: int = 0) -> DataFrame:
            """Rows of these days, and of ``after`` days more behind each."""
            wanted = F.broadcast(days.select(F.explode(F.array(*[F.col("day_us") + i * DAY_US for i in range(after + 1)])).alias("day_us")).distinct())
            return swap.read(spark, path, f"{columns}, {PLACE}").join(wanted, "day_us", "left_semi").select(*[c.split()[0] for c in columns.split(", ")])

        def kept(resolution: int) -> DataFrame:
            rows = swap.read(spark, self.rollup_path, ROLLUP).where(F.col("resolution_s") == resolution)
            return rows.join(dates, "bucket_date", "left_semi").drop(*by)

        def put(rows: DataFrame, resolution: int) -> None:
            placed = rows.withColumn("resolution_s", F.lit(resolution)).withColumn("bucket_date", F.to_date(F.timestamp_micros("bucket_us")))
            swap.replace(placed.select(*[c.split()[0] for c in _columns(ROLLUP)]), self.rollup_path, by)

        fresh = stored.redone(dirty, self._raw(of_days), of_days(self.gap_path, GAPS), self.as_of_us)
        put(stored.upsert(kept(60), dirty, fresh.select(kept(60).columns)), 60)
        hours = tiers.parents(dirty)
        inside = kept(60).withColumn("hour_us", F.col("bucket_us") - F.pmod("bucket_us", F.lit(tiers.HOUR))).join(hours.withColumnRenamed("bucket_us", "hour_us"), ["target_id", "hour_us"], "left_semi").drop("hour_us")
        put(stored.upsert(kept(3600), hours, stored.widen(inside, tiers.HOUR).select(kept(3600).columns)), 3600)

    def compact(self, spark: SparkSession) -> None:
        """Put the batches of each day and stream, but for each stream's last, into one folder (batch -1) of few files.

        The last batch of a stream may run again and stays as it is.
        """
        for path, columns in ((self.raw_path, PROBES), (self.gap_path, GAPS)):
            rows = swap.read(spark, path, f"{columns}, {PLACE}")
            last = F.broadcast(rows.groupBy("run").agg(F.max("batch").alias("last")))  # one row a stream
            old = rows.join(last, "run").where("batch < last").drop("last")
            folders = old.select("day_us", "run", "batch").distinct()
            staged = swap.stage(old.withColumn("batch", F.lit(-1).cast("long")), path, ["day_us", "run", "batch"], folders.unionByName(folders.withColumn("batch", F.lit(-1).cast("long"))))
            swap.swap(spark, path, staged, ["day_us", "run", "batch"])


SENT = "sequence long, target_id long, scheduled_at_us long, sent_at_us long, timeout_ns long, local_outcome string, endpoint long"
REPLIES = "sequence long, responder long, sent_at_us long, reply_at_us long, rtt_ns long"


class ReplyUpkeep(RollupUpkeep):
    """Upkeep from sent probes and replies that come apart, in any order and however late.

    Both are kept as they come, probes by the day of their schedule and replies by that of
    their probe's sent_at_us, which they carry and which is at most a day later.
    A batch of replies makes the minutes of the probes that it belongs to dirty, a batch of
    probes its own; a dirty minute's probes get their first valid reply by a join on sequence.
    A reply whose probe has not come yet waits in its table: the probe's batch finds it.
    No state is held and no watermark drops anything.
    """

    def __init__(self, sent_path: str, reply_path: str, gap_path: str, rollup_path: str, run: str | None = None, as_of_us: int = tiers.SETTLED):
        super().__init__(sent_path, gap_path, rollup_path, run, as_of_us)
        self.reply_path = reply_path

    def probes(self, batch: DataFrame, batch_id: int) -> None:
        kept = batch.select(*[c.split()[0] for c in SENT.split(", ")], _day(F.col("scheduled_at_us")).alias("day_us"))
        self._redo(tiers.dirty_buckets(self._stored(kept, self.raw_path, SENT, batch_id)))

    def replies(self, batch: DataFrame, batch_id: int) -> None:
        kept = batch.select(*[c.split()[0] for c in REPLIES.split(", ")], _day(F.col("sent_at_us")).alias("day_us"))
        mine = self._stored(kept, self.reply_path, REPLIES, batch_id)
        # Days of one batch, few rows; a probe may have been scheduled the day before it was sent.
        days = F.broadcast(mine.select(F.explode(F.array("day_us", F.col("day_us") - DAY_US)).alias("day_us")).distinct())
        sent = swap.read(batch.sparkSession, self.raw_path, f"{SENT}, {PLACE}").join(days, "day_us", "left_semi")
        self._redo(tiers.dirty_buckets(sent.join(mine.select("sequence").distinct(), "sequence", "left_semi")))

    def _raw(self, of_days: Callable[[str, str], DataFrame]) -> DataFrame:
        sent = of_days(self.raw_path, SENT)
        found = ingest.reconcile(sent, of_days(self.reply_path, REPLIES, 1))
        return found.join(sent.select("sequence", "scheduled_at_us"), "sequence").select(*[c.split()[0] for c in PROBES.split(", ")])

    def samples(self, spark: SparkSession) -> DataFrame:
        """All probes with their first valid replies and the number of further ones."""
        return ingest.reconcile(self._all(spark, self.raw_path, SENT), self._all(spark, self.reply_path, REPLIES))

    def waiting(self, spark: SparkSession, pruned_through_us: int) -> DataFrame:
        """Replies without a probe so far (sequence, kind): those of pruned probes are evicted, the others may yet be met."""
        return ingest.orphans(self._all(spark, self.raw_path, SENT), self._all(spark, self.reply_path, REPLIES), pruned_through_us)

    def diagnostics(self, spark: SparkSession, pruned_through_us: int) -> DataFrame:
        """Named counters of all that has come, with the time of the last occurrence; a reply that found its probe late is no orphan any more."""
        return ingest.diagnostics(self._all(spark, self.raw_path, SENT), self._all(spark, self.reply_path, REPLIES), pruned_through_us)

    def _all(self, spark: SparkSession, path: str, columns: str) -> DataFrame:
        return swap.read(spark, path, f"{columns}, {PLACE}").select(*[c.split()[0] for c in columns.split(", ")])


def _columns(schema: str) -> list[str]:
    """Name and type of each column, with types that hold commas kept whole."""
    return re.findall(r"\w+ (?:array<.*?>>|\w+)", schema)


def incident_stream(probes: DataFrame, policy: O.Policy, delay: str = "0 seconds") -> DataFrame:
    """Incident transitions of a stream of reconciled probes (with sent_at, a timestamp), whose batches follow each other in time for every target.

    State per target is the fold's, with the probes that are still on their way: a batch's end
    settles none of them.  They settle as later probes of the target come, or when
    the watermark (``delay`` behind the newest probe of all targets) passes their settling
    time, so the transitions do not depend on how the stream is cut into batches.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        machine = O.Machine.resume(policy, held.get) if held.exists else O.Machine(policy)
        if held.hasTimedOut:
            machine.advance(held.getCurrentWatermarkMs() * 1000)
        else:
            for r in pd.concat(list(parts)).sort_values(["sent_at_us", "sequence"]).itertuples(index=False):
                O.feed(machine, r)
        held.update(machine.rest())
        if (at := machine.next_us()) is not None:
            # Whole milliseconds, and never before the watermark.
            held.setTimeoutTimestamp(max(-(-at // 1000), held.getCurrentWatermarkMs() + 1))
        out = pd.DataFrame(machine.take(), columns=[c.split()[0] for c in O.FOLDED.split(", ")])
        yield out[[c.split()[0] for c in O.TRANSITION.split(", ")]].astype({"sequence": "Int64"}).assign(target_id=key[0])

    timed = probes.withWatermark("sent_at", delay).select("target_id", "sent_at", *O.NEEDED)
    return timed.groupBy("target_id").applyInPandasWithState(update, f"{O.TRANSITION}, target_id long", O.RESTING, "append", GroupStateTimeout.EventTimeTimeout)


def route_stream(traces: DataFrame, delay: str = "1 day") -> DataFrame:
    """Confirmed route changes of a stream of traces (with started_at, a timestamp, and signature, the route as JSON) that come at most ``delay`` out of order.

    State per target is the current route, the candidate, and traces that wait until the
    watermark has passed their start, so that they are walked in the order of their starts. A batch's
    traces all wait, so a stream of many is to be cut into batches that fit in memory; traces
    that come later than that are dropped by Spark.  Several batches give what one would.
    """
    names = [f.name for f in fields(R.Walk)]

    def update(key: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        plain = lambda v: [list(x) if hasattr(x, "__len__") and not isinstance(x, str) else x for x in v] if hasattr(v, "__len__") and not isinstance(v, str) else v
        walk = R.Walk(*map(plain, held.get)) if held.exists else R.Walk()
        if not held.hasTimedOut:
            for part in parts:
                for r in part.itertuples(index=False):
                    walk.add(r)
        now = held.getCurrentWatermarkMs()
        found = walk.release(now * 1000)
        held.update(tuple(getattr(walk, n) for n in names))
        if (at := walk.next_us()) is not None:
            held.setTimeoutTimestamp(max(at // 1000 + 1, now + 1))
        yield pd.DataFrame(found, columns=[c.split()[0] for c in R.STREAMED.split(", ")]).assign(target_id=key[0])

    needed = ["trace_id", "endpoint_id", "status", "signature", "reached_hop", "method", "flow_id", "started_at_us", "ended_at_us"]
    timed = traces.withWatermark("started_at", delay).select("target_id", "started_at", *needed)
    return timed.groupBy("target_id").applyInPandasWithState(update, f"{R.STREAMED}, target_id long", R.WALK, "append", GroupStateTimeout.EventTimeTimeout)
