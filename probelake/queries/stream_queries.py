"""Streaming queries: each runs its stream over the table to the end and returns what it wrote."""

from functools import lru_cache

from pyspark.sql import functions as F

from probelake.functions import sketch
from probelake.operators import gaps as G
from probelake.plans import stored, tiers
from probelake.queries.base import ORACLES, query
from probelake.queries.incident_queries import POLICY
from probelake.queries.ingest_queries import PRUNED
from probelake.queries.probe_queries import Q3, quantile_sql
from probelake.queries.tier_queries import COLUMNS, SHOWN, scratch
from probelake.queries import route_queries as RQ
from probelake.sources import adapters as A
from probelake.streaming import streams as S


def event_stream(spark, sf_dir):
    """The event table as a file stream."""
    schema = A.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet")


#: Rows of one batch of events, about; a stream has three batches at least.
BATCH_ROWS = 1_000_000
#: Traces of one batch, about: all of a batch wait in state for the watermark, which moves when it is through.
BATCH_TRACES = 200_000


def batches(spark, sf_dir, late=None, beats=0):
    """The folder of a copy of the events that grows by one batch between two yields, in order of time; after these come the rows that are
    ``late``, and ``beats`` send errors of target -1, a day later each, which let time go on."""
    events, path, staged = A.table(spark, sf_dir, "events"), scratch(spark, "events"), scratch(spark, "events-by-batch")
    first, last, n = events.select(F.min(A.micros("ts")), F.max(A.micros("ts")), F.count("*")).first()
    count = max(3, -(-n // BATCH_ROWS))
    part = F.least(F.floor((A.micros("ts") - F.lit(first or 0)) * count / (F.lit(last or 0) - F.lit(first or 0) + 1)), F.lit(count - 1))
    parted = events.withColumn("part", (part if late is None else F.when(late, count).otherwise(part)).cast("int"))
    parted.write.partitionBy("part").parquet(staged)
    for i in range(count if late is None else count + 1):
        spark.read.schema(parted.schema).parquet(staged).where(F.col("part") == i).drop("part").write.mode("append").parquet(path)
        yield path
    for i in range(beats):
        beat = {"event_id": -1 - i, "user_id": -1, "event_type": "error", "ts": F.timestamp_micros(F.lit((last or 0) + (i + 1) * A.DAY)).cast("timestamp_ntz")}
        row = spark.range(1).select(*[F.lit(beat.get(c)).cast(t).alias(c) if not hasattr(beat.get(c), "cast") else beat[c].cast(t).alias(c) for c, t in events.dtypes])
        row.coalesce(1).write.mode("append").parquet(path)
        yield path


def in_batches(spark, sf_dir, late=None):
    """The event table as a stream of several batches; these take files as they come, so only roughly in order of time, the ``late`` rows last."""
    *_, path = batches(spark, sf_dir, late)
    files = len(spark.read.parquet(path).inputFiles())
    return spark.readStream.schema(A.table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", max(1, files // 4)).parquet(path)


def probe_stream(spark, sf_dir, stream=None):
    """The adapter's probes over the stream: it is a projection, so it holds for both."""
    stream = event_stream(spark, sf_dir) if stream is None else stream
    answered = ~F.col("event_type").isin("error", "signup")
    rtt = F.round(F.col("value") * 1e6).cast("long")
    timeout = F.when(F.col("event_id") % 2 == 0, 100_000_000).otherwise(150_000_000).cast("long")
    at = A.micros("ts")
    return stream.select(
        (F.col("user_id") % 10).alias("target_id"), F.col("event_id").alias("sequence"), at.alias("scheduled_at_us"), at.alias("sent_at_us"), timeout.alias("timeout_ns"),
        F.when(F.col("event_type") == "error", F.lit("send_error")).alias("local_outcome"), F.when(answered, rtt).alias("rtt_ns"),
        F.when(answered, F.when(rtt > timeout, "late").otherwise("on_time")).alias("reply_class"), F.when(answered, at + F.floor(rtt / 1000)).alias("reply_at_us"),
        (F.col("user_id") % 10 * 10 + F.floor(F.dayofmonth("ts") / 10)).cast("long").alias("endpoint"), F.col("ts").cast("timestamp").alias("sent_at"),
    )


@query("probes", "select target_id, count(*) as n, cast(sum(rtt_ns) as bigint) as rtt_sum_ns from probes where rtt_ns is not null group by target_id")
def stream_reconcile(spark, sf_dir):
    """Answered probes of a stream-stream join; replies come twice for every 11th, and from strangers for every 13th."""
    sent = probe_stream(spark, sf_dir)
    good = probe_stream(spark, sf_dir).where("reply_class is not null").select("sequence", F.col("endpoint").alias("responder"), "sent_at", "rtt_ns")
    copies = F.explode(F.array(F.lit(0), F.when(F.col("sequence") % 11 == 0, 0).otherwise(1000), F.when(F.col("sequence") % 13 == 0, 2000).otherwise(1000)))
    replies = good.withColumn("shift", copies).select("sequence", (F.col("responder") + F.col("shift")).alias("responder"), "sent_at", "rtt_ns")
    path = scratch(spark, "reconciled")
    S.run_available(S.reconcile_stream(sent, replies), path, scratch(spark, "progress"))
    return spark.read.parquet(path).where("answered").groupBy("target_id").agg(F.count("*").alias("n"), F.sum("rtt_ns").alias("rtt_sum_ns"))


@lru_cache(maxsize=4)  # one run of the streams answers all queries of a session
def kept_up(spark, sf_dir):
    """Where rollups are that were kept by streams: the gaps first, then the probes in batches, every seventh long after its day."""
    upkeep = S.RollupUpkeep(scratch(spark, "raw"), scratch(spark, "gaps"), scratch(spark, "rollups"), as_of_us=A.AS_OF)
    run = lambda stream, f: stream.writeStream.foreachBatch(f).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    gaps, path = G.infer_gaps(A.probes_sent(spark, sf_dir), A.INTERVAL_NS), scratch(spark, "gap-events")
    gaps.write.parquet(path)
    run(spark.readStream.schema(gaps.schema).parquet(path), upkeep.gaps)
    run(probe_stream(spark, sf_dir, in_batches(spark, sf_dir, F.col("event_id") % 7 == 0)).drop("sent_at"), upkeep.probes)
    return upkeep.rollup_path


@query("agg_minute", f"select {COLUMNS} from agg_minute")
def stream_rollup(spark, sf_dir):
    """Minute rollups after all batches: equal to rolling up all at once."""
    return tiers.read_rollup(spark, kept_up(spark, sf_dir), 60).select(*SHOWN)


@query("agg_hour", f"select {COLUMNS} from agg_hour")
def stream_rollup_hours(spark, sf_dir):
    return tiers.read_rollup(spark, kept_up(spark, sf_dir), 3600).select(*SHOWN)


@query("hist_hour", quantile_sql("hist_hour", "target_id, bucket_us", Q3))
def stream_quantiles(spark, sf_dir):
    """Quantiles of the hours that streams kept, late rows and all."""
    hours = tiers.read_rollup(spark, kept_up(spark, sf_dir), 3600)
    return sketch.quantiles(stored.unfold(hours), ["target_id", "bucket_us"], Q3)


@query("moves", "select target_id, at_us, kind, reason from moves")
def stream_incidents(spark, sf_dir):
    """Transitions of a stream in batches: equal to those of the whole table once time has gone on."""
    path, progress = scratch(spark, "incidents"), scratch(spark, "progress")
    for arrived in batches(spark, sf_dir, beats=2):
        # The stream goes on from its checkpoint with all that is new: a batch of many files is not cut, as its files are not in order of time.
        stream = spark.readStream.schema(A.table(spark, sf_dir, "events").schema).parquet(arrived)
        S.run_available(S.incident_stream(probe_stream(spark, sf_dir, stream), POLICY), path, progress)
    return spark.read.parquet(path).where("target_id >= 0").select("target_id", "at_us", "kind", "reason")


@lru_cache(maxsize=4)
def replied(spark, sf_dir):
    """Upkeep from probes and replies of separate streams: half of the replies before any probe, the probes in batches, the rest of the replies last."""
    upkeep = S.ReplyUpkeep(*[scratch(spark, x) for x in ("sent", "replies", "gaps", "rollups")], as_of_us=A.AS_OF)

    def run(rows, f):
        path = scratch(spark, "arrivals")
        rows.write.parquet(path)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(path)
        stream.writeStream.foreachBatch(f).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()

    gaps, replies = G.infer_gaps(A.probes_sent(spark, sf_dir), A.INTERVAL_NS), A.replies(spark, sf_dir)
    early = F.pmod(F.xxhash64("sequence", "responder", "reply_at_us"), F.lit(2)) == 0
    run(gaps, upkeep.gaps)
    run(replies.where(early), upkeep.replies)
    run(A.probes_sent(spark, sf_dir), upkeep.probes)
    run(replies.where(~early), upkeep.replies)
    return upkeep


@query("agg_minute", f"select {COLUMNS} from agg_minute")
def stream_replies_rollup(spark, sf_dir):
    """Minutes that were kept up from late and early replies: those of the reconciled probes."""
    return tiers.read_rollup(spark, replied(spark, sf_dir).rollup_path, 60).select(*SHOWN)


@query("", ORACLES["probe_reconcile"])
def stream_replies_samples(spark, sf_dir):
    """Samples, and duplicates counted, from the tables that streams of any order filled."""
    return replied(spark, sf_dir).samples(spark)


@query("", ORACLES["diagnostics"])
def stream_diagnostics(spark, sf_dir):
    """Counters of the tables that streams of any order filled: those of all rows at once."""
    return replied(spark, sf_dir).diagnostics(spark, PRUNED)


@query("", ORACLES["orphan_replies"])
def stream_orphans(spark, sf_dir):
    """Replies that still wait for a probe when all streams are through."""
    return replied(spark, sf_dir).waiting(spark, PRUNED).select("sequence", "kind")


@query("changes", "select target_id, endpoint_id, old_trace_id, candidate_trace_id, confirming_trace_id, old_reached_hop, new_reached_hop, first_seen_us, confirmed_at_us from changes")
def stream_route_changes(spark, sf_dir):
    """Route changes of traces that come in batches, a day out of order at most: those of all traces at once."""
    rows = RQ.traces(spark, sf_dir).withColumn("signature", F.to_json("route")).withColumn("started_at", F.timestamp_micros("started_at_us")).drop("route")
    path, kept, staged = scratch(spark, "traces"), scratch(spark, "all-traces"), scratch(spark, "traces-by-batch")
    rows.write.parquet(kept)
    rows = spark.read.parquet(kept)
    # By a shifted start: traces around a batch's end come in the wrong one.
    first, last, n = rows.agg(F.min("started_at_us"), F.max("started_at_us"), F.count("*")).first()
    first, last, count = first or 0, last or 0, max(3, -(-n // BATCH_TRACES))
    shifted = F.col("started_at_us") + F.when(F.col("trace_id") % 2 == 0, A.DAY).otherwise(0)
    part = F.least(F.floor((shifted - first) / -(-(last - first + 1) // count)), F.lit(count - 1)).cast("int")
    parted = rows.withColumn("part", part)
    parted.write.partitionBy("part").parquet(staged)
    for i in range(count):
        spark.read.schema(parted.schema).parquet(staged).where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    for i in (1, 2):  # traces of no target, which let time go on
        beat = rows.limit(1).withColumn("target_id", F.lit(-1).cast("long")).withColumn("started_at_us", F.lit(last + 5 * i * A.DAY)).withColumn("started_at", F.timestamp_micros("started_at_us"))
        beat.select(rows.columns).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = scratch(spark, "changes")
    S.run_available(S.route_stream(stream, "2 days"), out, scratch(spark, "progress"))
    return spark.read.parquet(out).where("target_id >= 0")
