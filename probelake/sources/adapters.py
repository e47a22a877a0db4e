"""Domain tables as views of the event, order and dimension tables.

Times are microseconds since the epoch, durations nanoseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Evaluation time of the registered queries: 2024-01-31 00:00:00 UTC.
AS_OF = 1_706_659_200_000_000
MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000
INTERVAL_NS = 1_800_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def probes_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per probe that was sent or failed to be sent."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("target_id"),
        F.col("event_id").alias("sequence"),
        micros("ts").alias("scheduled_at_us"),
        micros("ts").alias("sent_at_us"),
        F.when(F.col("event_id") % 2 == 0, 100_000_000).otherwise(150_000_000).cast("long").alias("timeout_ns"),
        F.when(F.col("event_type") == "error", F.lit("send_error")).alias("local_outcome"),
        (F.col("user_id") % 10 * 10 + F.floor(F.dayofmonth("ts") / 10)).cast("long").alias("endpoint"),
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes with their first reply: rtt_ns, reply_class and reply_at_us are null without one."""
    answered = ~F.col("event_type").isin("error", "signup")
    rtt = F.round(F.col("value") * 1e6).cast("long")
    timeout = F.when(F.col("event_id") % 2 == 0, 100_000_000).otherwise(150_000_000).cast("long")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("target_id"),
        F.col("event_id").alias("sequence"),
        micros("ts").alias("scheduled_at_us"),
        micros("ts").alias("sent_at_us"),
        timeout.alias("timeout_ns"),
        F.when(F.col("event_type") == "error", F.lit("send_error")).alias("local_outcome"),
        F.when(answered, rtt).alias("rtt_ns"),
        F.when(answered, F.when(rtt > timeout, "late").otherwise("on_time")).alias("reply_class"),
        F.when(answered, micros("ts") + F.floor(rtt / 1000)).alias("reply_at_us"),
        (F.col("user_id") % 10 * 10 + F.floor(F.dayofmonth("ts") / 10)).cast("long").alias("endpoint"),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as they arrive: each answered probe's, a copy of every 11th, a stray one for every 13th, an orphan for every 17th."""
    base = probes(spark, sf_dir).where("reply_class is not null").select("sequence", "sent_at_us", "reply_at_us", "rtt_ns", F.col("endpoint").alias("responder"))
    copy = base.where("sequence % 11 = 0").withColumn("reply_at_us", F.col("reply_at_us") + 1)
    stray = base.where("sequence % 13 = 0").withColumn("responder", F.col("responder") + 1000).withColumn("reply_at_us", F.col("reply_at_us") - 1)
    orphan = base.where("sequence % 17 = 0").withColumn("sequence", F.col("sequence") + 1_000_000_000)
    return base.unionByName(copy).unionByName(stray).unionByName(orphan)


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interface counters that wrap: name, mac, sampled_at_us and the cumulative counters of ``COUNTERS``; samples without a time come last."""
    k = F.get_json_object("props", "$.k").cast("long")
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("name"), "event_id", "ts", k.alias("k"), "event_type")
    w = Window.partitionBy("name").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum("k").over(w)
    seen = F.count("*").over(w)
    errors = F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(w)
    return events.select(
        "name",
        "event_id",
        micros("ts").alias("sampled_at_us"),
        F.floor(F.dayofmonth("ts") / 15).cast("long").alias("mac"),
        (run % 1000).cast("long").alias("rx_bytes"),
        (seen * 7).cast("long").alias("tx_bytes"),
        seen.cast("long").alias("rx_packets"),
        errors.cast("long").alias("rx_errors"),
        F.floor(errors / 3).cast("long").alias("rx_dropped"),
    )


COUNTERS = ["rx_bytes", "tx_bytes", "rx_packets", "rx_errors", "rx_dropped"]


def hop_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traceroute probes: one per line item."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("trace_id"),
        ((F.col("l_linenumber") - 1) % 3 + 1).cast("int").alias("ttl"),
        F.col("l_linenumber").cast("int").alias("probe_index"),
        F.col("l_linestatus").alias("responder"),
        F.col("l_partkey").alias("token"),
    )


def trace_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace runs without their routes: one per order."""
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trace_id"),
        (F.col("o_custkey") % 10).alias("target_id"),
        (F.col("o_custkey") % 10).alias("endpoint_id"),
        start.alias("started_at_us"),
        (start + 1_000_000).alias("ended_at_us"),
        F.when(F.col("o_orderstatus") == "P", "timed_out").otherwise("completed").alias("status"),
        (F.col("o_orderstatus") == "F").alias("reached"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitored targets, one per nation; settings are null where the default holds."""
    key = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        key.cast("long").alias("target_id"),
        F.concat(F.lit("t"), key.cast("string")).alias("stable_id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("10.0."), F.col("n_regionkey").cast("string"), F.lit("."), key.cast("string")).alias("address"),
        F.element_at(F.array(F.lit("auto"), F.lit("4"), F.lit("6")), (F.col("n_regionkey") % 3 + 1).cast("int")).alias("family"),
        F.when(key % 4 == 0, F.lit(5_000_000_000) * (key + 1)).cast("long").alias("ping_interval_ns"),
        F.when(key % 6 == 1, F.lit(2_000_000_000)).cast("long").alias("legacy_interval_ns"),
        F.when(key % 5 == 0, F.lit(500_000_000)).cast("long").alias("ping_timeout_ns"),
        F.when(key % 3 == 0, F.element_at(F.array(F.lit("50%"), F.lit("100ms"), F.lit("-5%"), F.lit("0.2s")), (key % 4 + 1).cast("int"))).alias("latency_threshold"),
    )
