"""Queries of ingest reconciliation."""

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelake.operators import counters as C
from probelake.operators import dims as D
from probelake.operators import ingest as I
from probelake.queries import counter_queries  # noqa: F401  (its view of resets)
from probelake.queries.base import query
from probelake.queries.probe_queries import gaps_of
from probelake.sources import adapters as A

PRUNED = 1_704_844_800_000_000  # 2024-01-10


def _both(spark, sf_dir):
    return A.probes_sent(spark, sf_dir), A.replies(spark, sf_dir)


@query("probes replies gaps counters runs reasons", """
    select 'sent' as kind, count(*) as n, cast(sum(sequence) as bigint) as total from probes where local_outcome is null
    union all select 'send_error', count(*), cast(sum(sequence) as bigint) from probes where local_outcome is not null
    union all select 'reply', count(*), cast(sum(sequence) as bigint) from replies
    union all select 'gap', count(*), cast(sum(missed_count) as bigint) from gaps
    union all select 'interface_snapshot', count(*), cast(sum(rx_bytes) as bigint) from counters
    union all select 'trace', count(*), cast(sum(trace_id) as bigint) from runs
    union all select 'endpoint_change', count(*), cast(sum(at_us + endpoint) as bigint) from (select sent_at_us as at_us, endpoint, lag(endpoint) over (partition by target_id order by sent_at_us, sequence) as old from probes) where old <> endpoint
    union all select 'interface_reset', count(*), cast(sum(sampled_at_us + length(reset_reason)) as bigint) from reasons where reset_reason is not null""")
def probe_events(spark, sf_dir):
    """A tagged stream of all eight kinds, written as JSON payloads, and decoded into its relations; kinds without events count none.

    Totals are summed as decimals; where one is beyond 64 bits, the column is a decimal.
    """
    sent, got = _both(spark, sf_dir)
    resets = C.reset_reason(A.counters(spark, sf_dir), A.COUNTERS).where("reset_reason is not null")
    sources = {
        "sent": (sent.where("local_outcome is null"), "sequence"),
        "send_error": (sent.where("local_outcome is not null").withColumn("code", F.lit("EIO")), "sequence"),
        "reply": (got, "sequence"),
        "gap": (gaps_of(spark, sf_dir), "missed_count"),
        "interface_snapshot": (A.counters(spark, sf_dir), "rx_bytes"),
        "trace": (A.trace_runs(spark, sf_dir), "trace_id"),
        "endpoint_change": (D.endpoint_changes(sent).withColumnRenamed("new", "endpoint"), "at_us + endpoint"),
        "interface_reset": (resets.select("name", F.col("sampled_at_us").alias("at_us"), F.col("reset_reason").alias("reason")), "at_us + length(reason)"),
    }
    stream = reduce(DataFrame.unionByName, [I.tagged(rows, kind) for kind, (rows, _) in sources.items()])
    sums = [I.decode(stream, kind).select(F.lit(kind).alias("kind"), F.expr(c).cast("decimal(20,0)").alias("v")) for kind, (_, c) in sources.items()]
    counted = reduce(DataFrame.unionByName, sums).groupBy("kind").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    found = {r.kind: (r.n, None if r.total is None else int(r.total)) for r in counted.collect()}  # a row for each kind
    long = all(t is None or -(2**63) <= t < 2**63 for _, t in found.values())
    rows = [(kind, n, t if long or t is None else Decimal(t)) for kind in sources for n, t in [found.get(kind, (0, None))]]
    return spark.createDataFrame(rows, f"kind string, n long, total {'long' if long else 'decimal(38,0)'}")


@query("probes replies", """
    select sequence, target_id, p.sent_at_us, timeout_ns, local_outcome, f.reply_at_us, f.rtt_ns,
           case when f.rtt_ns > timeout_ns then 'late' when f.reply_at_us is not null then 'on_time' end as reply_class, coalesce(n - 1, 0) as duplicate_count
    from probes p left join (select sequence, responder, min(reply_at_us) as reply_at_us, min(rtt_ns) as rtt_ns, count(*) as n from replies group by all) f
      using (sequence) where f.responder is null or f.responder = p.endpoint
    union all
    select sequence, target_id, sent_at_us, timeout_ns, local_outcome, null, null, null, 0 from probes
    where sequence in (select sequence from replies) and (sequence, endpoint) not in (select (sequence, responder) from replies)""")
def probe_reconcile(spark, sf_dir):
    return I.reconcile(*_both(spark, sf_dir))


@query("probes replies", """
    select target_id, cast(sum(n - 1) as bigint) as duplicates from (select target_id, sequence, count(*) as n from probes join replies r using (sequence) where r.responder = endpoint group by all)
    where n > 1 group by target_id""")
def reply_duplicates(spark, sf_dir):
    return I.reconcile(*_both(spark, sf_dir)).where("duplicate_count > 0").groupBy("target_id").agg(F.sum("duplicate_count").alias("duplicates"))


@query("probes replies", "select target_id, count(*) as n from probes join replies r using (sequence) where r.responder <> endpoint group by target_id")
def reply_source_mismatch(spark, sf_dir):
    return I.mismatches(*_both(spark, sf_dir)).groupBy("target_id").agg(F.count("*").alias("n"))


@query("probes replies", f"select sequence, case when sent_at_us <= {PRUNED} then 'late_reply_evicted' else 'orphan' end as kind from replies where sequence not in (select sequence from probes)")
def orphan_replies(spark, sf_dir):
    return I.orphans(*_both(spark, sf_dir), PRUNED).select("sequence", "kind")


@query("probes replies", f"""
    select name, count(*) as n, max(at_us) as last_at_us from (
        select 'duplicate_reply' as name, reply_at_us as at_us from (select *, row_number() over (partition by sequence order by r.reply_at_us, r.rtt_ns) as i from replies r join (select sequence, endpoint from probes) using (sequence) where responder = endpoint) where i > 1
        union all select 'reply_source_mismatch', r.reply_at_us from replies r join probes p using (sequence) where responder <> p.endpoint
        union all select case when sent_at_us <= {PRUNED} then 'late_reply_evicted' else 'orphan' end, reply_at_us from replies where sequence not in (select sequence from probes)) group by name""")
def diagnostics(spark, sf_dir):
    return I.diagnostics(*_both(spark, sf_dir), PRUNED)


@query("probes replies", "select r.sequence, r.rtt_ns, case when r.rtt_ns > timeout_ns then 'late' else 'on_time' end as reply_class, count(*) as n from replies r join probes p using (sequence) where r.rtt_ns >= 0 group by all")
def reply_validity(spark, sf_dir):
    return I.valid_replies(A.replies(spark, sf_dir), A.probes_sent(spark, sf_dir)).groupBy("sequence", "rtt_ns", "reply_class").agg(F.count("*").alias("n"))


@query("counters", """
    select name, sampled_at_us, counter, value from (
        select name, sampled_at_us, 'rx_bytes' as counter, cast(rx_bytes * 20000000000000000::hugeint as varchar) as value, rx_bytes * 20000000000000000::hugeint as v from counters
        union all select name, sampled_at_us, 'tx_bytes', cast(tx_bytes - 700 as varchar), tx_bytes - 700 from counters)
    where v < 0 or v > 9223372036854775807""")
def counter_range_check(spark, sf_dir):
    rows = A.counters(spark, sf_dir)
    scaled = rows.select("name", "sampled_at_us", (F.col("rx_bytes").cast("decimal(20,0)") * F.lit(20_000_000_000_000_000).cast("decimal(18,0)")).alias("rx_bytes"), (F.col("tx_bytes") - 700).alias("tx_bytes"))
    return I.counter_violations(scaled, ["rx_bytes", "tx_bytes"])


@query("", """
    select user_id % 10 as target_id, count(*) as n, min(epoch_us(ts)) as first_us, max(epoch_us(ts)) as last_us from events
    where user_id % 10 = 3 and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-12' group by all""")
def table_scan(spark, sf_dir):
    """A range of one entity: both bounds reach the file scan as pushed filters."""
    events = A.table(spark, sf_dir, "events")
    held = events.where("user_id % 10 = 3 and ts >= timestamp_ntz'2024-01-05 00:00:00' and ts < timestamp_ntz'2024-01-12 00:00:00'")
    return held.groupBy((F.col("user_id") % 10).alias("target_id")).agg(F.count("*").alias("n"), F.min(A.micros("ts")).alias("first_us"), F.max(A.micros("ts")).alias("last_us"))
