"""From event streams to reconciled probe samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probelake.functions.scalars import whole

#: Payload fields of each kind of a tagged event stream.
KINDS = {
    "sent": "sequence long, target_id long, sent_at_us long, timeout_ns long, endpoint long",
    "send_error": "sequence long, target_id long, sent_at_us long, timeout_ns long, code string",
    "reply": "sequence long, reply_at_us long, rtt_ns long, responder long",
    "gap": "target_id long, first_us long, interval_ns long, missed_count long",
    "endpoint_change": "target_id long, at_us long, endpoint long",
    "interface_snapshot": "name long, sampled_at_us long, rx_bytes long, tx_bytes long",
    "interface_reset": "name long, at_us long, reason string",
    "trace": "trace_id long, target_id long, started_at_us long, status string",
}


def tagged(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind as (kind, payload) with the payload in JSON."""
    names = [f.split()[0] for f in KINDS[kind].split(", ")]
    return rows.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*[n for n in names if n in rows.columns])).alias("payload"))


def decode(events: DataFrame, kind: str) -> DataFrame:
    """The relation of one kind of a stream of (kind, payload)."""
    return events.where(F.col("kind") == kind).select(F.from_json("payload", KINDS[kind]).alias("p")).select("p.*")


def reconcile(sent: DataFrame, replies: DataFrame) -> DataFrame:
    """Each sent probe with its first valid reply, and how many more there were.

    A reply is valid if its responder is the probe's endpoint; the order in which
    probes and replies come does not matter.  Probes without one keep nulls.
    """
    valid = replies.join(sent.select("sequence", F.col("endpoint").alias("responder")), ["sequence", "responder"], "left_semi")
    first = valid.groupBy("sequence").agg(
        F.min(F.struct("reply_at_us", "rtt_ns")).alias("first"), (F.count("*") - 1).alias("duplicate_count")
    )
    out = sent.join(first, "sequence", "left")
    late = F.when(F.col("first").isNotNull(), F.when(F.col("first.rtt_ns") > F.col("timeout_ns"), "late").otherwise("on_time"))
    return out.select("sequence", "target_id", "sent_at_us", "timeout_ns", "local_outcome", F.col("first.reply_at_us").alias("reply_at_us"), F.col("first.rtt_ns").alias("rtt_ns"), late.alias("reply_class"), F.coalesce("duplicate_count", F.lit(0)).cast("long").alias("duplicate_count"))


def mismatches(sent: DataFrame, replies: DataFrame) -> DataFrame:
    """Replies of known probes from another responder than the probe's endpoint."""
    return replies.join(sent.select("sequence", "target_id", "endpoint"), "sequence").where(F.col("responder") != F.col("endpoint"))


def orphans(sent: DataFrame, replies: DataFrame, pruned_through_us: int) -> DataFrame:
    """Replies without a probe: evicted if the probe would have been pruned, else orphans."""
    lost = replies.join(sent.select("sequence"), "sequence", "left_anti")
    return lost.withColumn("kind", F.when(F.col("sent_at_us") <= pruned_through_us, "late_reply_evicted").otherwise("orphan"))


def valid_replies(replies: DataFrame, sent: DataFrame) -> DataFrame:
    """Replies of known probes whose round trip is not negative, with their class by the probe's timeout."""
    known = replies.where(F.col("rtt_ns") >= 0).join(sent.select("sequence", "timeout_ns"), "sequence")
    return known.withColumn("reply_class", F.when(F.col("rtt_ns") > F.col("timeout_ns"), "late").otherwise("on_time"))


def diagnostics(sent: DataFrame, replies: DataFrame, pruned_through_us: int) -> DataFrame:
    """Named counters with the time of the last occurrence."""
    valid = replies.join(sent.select("sequence", F.col("endpoint").alias("responder")), ["sequence", "responder"], "left_semi")
    w = Window.partitionBy("sequence").orderBy("reply_at_us", "rtt_ns")
    again = valid.withColumn("i", F.row_number().over(w)).where("i > 1").select(F.lit("duplicate_reply").alias("name"), F.col("reply_at_us").alias("at_us"))
    wrong = mismatches(sent, replies).select(F.lit("reply_source_mismatch").alias("name"), F.col("reply_at_us").alias("at_us"))
    lost = orphans(sent, replies, pruned_through_us).select(F.col("kind").alias("name"), F.col("reply_at_us").alias("at_us"))
    return again.unionByName(wrong).unionByName(lost).groupBy("name").agg(F.count("*").alias("n"), F.max("at_us").alias("last_at_us"))


def counter_violations(rows: DataFrame, counters: list[str]) -> DataFrame:
    """Counter samples outside the signed 64-bit range, one row per sample and counter, for a side table.

    Counters may come as decimals or strings; those that are no numbers count too.
    """
    wide = F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).cast("string").alias("value")) for c in counters]))
    long = rows.select("name", "sampled_at_us", wide.alias("c")).select("name", "sampled_at_us", "c.*").where("value is not null")
    n = F.expr("try_cast(value as decimal(38, 0))")
    return long.where(n.isNull() | (n < 0) | (n > F.lit(2**63 - 1)))


def settled(as_of_us: int):
    return F.col("sent_at_us") + whole(F.col("timeout_ns"), 1000) <= as_of_us
