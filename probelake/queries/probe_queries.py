"""Queries of gaps, probe outcomes and their aggregates."""

from pyspark.sql import functions as F

from probelake.operators import gaps as G
from probelake.operators import probes as P
from probelake.queries.base import query, view
from probelake.sources import adapters as A

AS_OF = A.AS_OF
OUTCOME = f"""case when local_outcome is not null then 'send_error' when reply_class is not null then reply_class
              when sent_at_us + timeout_ns // 1000 > {AS_OF} then 'pending' else 'unanswered' end"""


def gaps_of(spark, sf_dir):
    return G.infer_gaps(A.probes_sent(spark, sf_dir), A.INTERVAL_NS)


def missed_sql(width: int) -> str:
    return f"""
        select target_id, bucket_us, cast(sum(m) as bigint) as missed from (
            select target_id, bucket_us,
                   greatest(least(case when bucket_us + {width} > first_us then (bucket_us + {width} - 1 - first_us) // 1800000000 else -1 end, missed_count - 1)
                            - case when bucket_us > first_us then (bucket_us - first_us + 1799999999) // 1800000000 else 0 end + 1, 0) as m
            from (select *, unnest(range(first_us // {width} * {width}, first_us + (missed_count - 1) * 1800000000 + 1, {width})) as bucket_us from gaps))
        where m > 0 group by all"""


def agg_sql(width: int, of: str = "probes") -> str:
    return f"""
        select target_id, bucket_us, coalesce(attempted, 0) as attempted, coalesce(sent, 0) as sent, coalesce(on_time, 0) as on_time, coalesce(late, 0) as late,
               coalesce(unanswered, 0) as unanswered, coalesce(send_errors, 0) as send_errors, coalesce(pending, 0) as pending, coalesce(rtt_count, 0) as rtt_count,
               coalesce(missed, 0) as missed, rtt_sum_ns, rtt_min_ns, rtt_max_ns, timeout_min_ns, timeout_max_ns,
               coalesce(attempted, 0) + coalesce(missed, 0) as scheduled, coalesce(pending, 0) > 0 as pending_partial
        from (select target_id, scheduled_at_us // {width} * {width} as bucket_us, count(*) as attempted, count(*) filter (outcome <> 'send_error') as sent,
                     count(*) filter (outcome = 'on_time') as on_time, count(*) filter (outcome = 'late') as late,
                     count(*) filter (outcome = 'unanswered') as unanswered, count(*) filter (outcome = 'send_error') as send_errors,
                     count(*) filter (outcome = 'pending') as pending, count(rtt_ns) as rtt_count, cast(sum(rtt_ns) as bigint) as rtt_sum_ns,
                     min(rtt_ns) as rtt_min_ns, max(rtt_ns) as rtt_max_ns, min(timeout_ns) as timeout_min_ns, max(timeout_ns) as timeout_max_ns
              from (select *, {OUTCOME} as outcome from {of}) group by all) a
        full join ({missed_sql(width)}) m using (target_id, bucket_us)"""


def quantile_sql(hist: str, keys: str, wanted: dict[str, float]) -> str:
    """Quantiles of a view of bins."""
    picks = ", ".join(f"min(bin) filter (cum >= greatest(ceil({q}::double * total), 1)) as {n}" for n, q in wanted.items())
    values = ", ".join(f"cast(round(exp(({n} + 0.5::double) * ln(1.02::double))) as bigint) as {n}" for n in wanted)
    over = f"partition by {keys}" if keys else ""
    group = f"group by {keys}" if keys else ""
    return f"""select {keys}{',' if keys else ''} {values} from (select {keys}{',' if keys else ''} {picks} from (
               select *, sum(n) over ({over} order by bin) as cum, sum(n) over ({over}) as total from {hist}) {group})"""


BIN = "cast(greatest(floor(ln(greatest(rtt_ns, 1)::double) / ln(1.02::double)), 0) as int)"
for w, n in ((A.MINUTE, "minute"), (A.HOUR, "hour"), (7 * A.MINUTE, "odd")):
    view(f"agg_{n}", "probes gaps", agg_sql(w))
    view(f"hist_{n}", "probes", f"select target_id, scheduled_at_us // {w} * {w} as bucket_us, {BIN} as bin, count(*) as n from probes where rtt_ns is not null group by all")


@query("gaps", "select * from gaps")
def infer_gaps(spark, sf_dir):
    return gaps_of(spark, sf_dir)


@query("gaps", """
    select target_id, min(first_us) as first_us, 1800000000000::bigint as interval_ns, cast(sum(missed_count) as bigint) as missed_count
    from (select *, sum(new) over (partition by target_id order by first_us) as run
          from (select *, case when lag(last_us) over (partition by target_id order by first_us) + 1800000000 = first_us then 0 else 1 end as new
                from (select target_id, first_us + i * 1800000000 as first_us, 1 as missed_count, first_us + i * 1800000000 as last_us
                      from (select *, unnest(range(missed_count)) as i from gaps))))
    group by target_id, run""")
def coalesce_gaps(spark, sf_dir):
    # Single skipped slots, as a scheduler reports them, become runs again.
    slots = gaps_of(spark, sf_dir).select("target_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("missed_count") - 1)).alias("i"), "first_us", "interval_ns")
    single = slots.select("target_id", (F.col("first_us") + F.col("i") * 1_800_000_000).alias("first_us"), "interval_ns", F.lit(1).cast("long").alias("missed_count"))
    return G.coalesce_gaps(single)


@query("gaps", missed_sql(A.HOUR))
def gap_counts(spark, sf_dir):
    return G.gap_counts(gaps_of(spark, sf_dir), A.HOUR)


@query("gaps", """
    select distinct target_id, unnest(range(first_us // 60000000 * 60000000, (first_us + (missed_count - 1) * 1800000000) // 60000000 * 60000000 + 1, 60000000)) as bucket_us
    from gaps""")
def gap_dirty_minutes(spark, sf_dir):
    return G.gap_minutes(gaps_of(spark, sf_dir))


@query("gaps", "select target_id, first_us, first_us + (missed_count - 1) * 1800000000 as last_us from gaps")
def gap_end(spark, sf_dir):
    return gaps_of(spark, sf_dir).select("target_id", "first_us", G.gap_end().alias("last_us"))


@query("probes", f"select target_id, sequence, {OUTCOME} as outcome, scheduled_at_us // 3600000000 * 3600000000 as bucket_us, cast(floor((scheduled_at_us - 1704067260000000) / 5400000000) as bigint) as anchored from probes")
def probe_outcome(spark, sf_dir):
    from probelake.functions.scalars import anchored_bucket, epoch_bucket

    at = F.col("scheduled_at_us")
    out = P.classified(A.probes(spark, sf_dir), AS_OF)
    return out.select("target_id", "sequence", "outcome", epoch_bucket(at, A.HOUR).alias("bucket_us"), anchored_bucket(at, 1_704_067_260_000_000, 5_400_000_000).alias("anchored"))


@query("probes", OUTCOME_PENDING := f"""
    select outcome, count(*) as n from (select {OUTCOME.replace(str(AS_OF), '(select max(sent_at_us) + 50000 from probes)')} as outcome from probes) group by outcome""")
def probe_pending(spark, sf_dir):
    """Outcomes 50 ms after the last probe."""
    rows = A.probes(spark, sf_dir)
    last = rows.agg(F.max("sent_at_us").alias("t")).first()["t"]  # one number
    return P.classified(rows, (last or 0) + 50_000).groupBy("outcome").agg(F.count("*").alias("n"))


@query("agg_hour", "select * from agg_hour")
def ping_raw_agg(spark, sf_dir):
    return P.raw_agg(A.probes(spark, sf_dir), gaps_of(spark, sf_dir), A.HOUR, AS_OF)


@query("agg_odd", "select target_id, bucket_us, scheduled, sent, on_time, late, unanswered, missed from agg_odd")
def ping_raw_agg_odd_width(spark, sf_dir):
    return P.raw_agg(A.probes(spark, sf_dir), gaps_of(spark, sf_dir), 7 * A.MINUTE, AS_OF).select("target_id", "bucket_us", "scheduled", "sent", "on_time", "late", "unanswered", "missed")


POINTS = """
    select target_id, bucket_us, scheduled, attempted, sent, on_time, late, unanswered, send_errors, missed, rtt_count,
           case when rtt_count > 0 then rtt_sum_ns / rtt_count / 1e6::double end as avg_ms, rtt_min_ns / 1e6::double as min_ms, rtt_max_ns / 1e6::double as max_ms,
           p50_ns / 1e6::double as p50_ms, p95_ns / 1e6::double as p95_ms, p99_ns / 1e6::double as p99_ms,
           case when sent > 0 then 100.0::double * (late + unanswered) / sent end as deadline_miss_pct, case when sent > 0 then 100.0::double * unanswered / sent end as no_reply_pct,
           case when sent > 0 then 100.0::double * late / sent end as late_pct, case when attempted > 0 then 100.0::double * send_errors / attempted end as send_error_pct,
           case when scheduled > 0 then 100.0::double * missed / scheduled end as gap_pct
    from {agg} a left join ({q}) q using (target_id, bucket_us)"""
Q3 = {"p50_ns": 0.5, "p95_ns": 0.95, "p99_ns": 0.99}


@query("agg_hour hist_hour", POINTS.format(agg="agg_hour", q=quantile_sql("hist_hour", "target_id, bucket_us", Q3)))
def ping_series(spark, sf_dir):
    rows = A.probes(spark, sf_dir)
    return P.points(P.raw_agg(rows, gaps_of(spark, sf_dir), A.HOUR, AS_OF), P.bins(rows, A.HOUR))


@query("agg_hour", "select target_id, bucket_us, case when sent > 0 then 100.0::double * (late + unanswered) / sent end as deadline_miss_pct, case when sent > 0 then 100.0::double * unanswered / sent end as no_reply_pct from agg_hour")
def loss_pcts(spark, sf_dir):
    return ping_series(spark, sf_dir).select("target_id", "bucket_us", "deadline_miss_pct", "no_reply_pct")


@query("probes", f"""
    select target_id, bucket_us, count(*) as attempted, count(*) filter (outcome <> 'send_error') as sent, count(*) filter (outcome = 'late') as late, max(rtt_ns) as rtt_max_ns
    from (select *, {OUTCOME} as outcome, scheduled_at_us // 86400000000 * 86400000000 as bucket_us from probes)
    group by grouping sets ((target_id, bucket_us), (target_id), ())""")
def ping_grouping_sets(spark, sf_dir):
    return P.grouping_agg(A.probes(spark, sf_dir), A.DAY, AS_OF).select("target_id", "bucket_us", "attempted", "sent", "late", "rtt_max_ns")
