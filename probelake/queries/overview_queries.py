"""Queries of the overview."""

from functools import lru_cache

from pyspark.sql import functions as F

from probelake.operators import counters as C
from probelake.operators import overview as V
from probelake.queries import counter_queries as CQ
from probelake.queries import incident_queries as IQ
from probelake.queries import probe_queries as PQ
from probelake.queries import route_queries as RQ
from probelake.queries.base import query, view
from probelake.sources import adapters as A

# The window: the 24 hours up to 50 ms after the last probe.
view("bounds", "probes", "select max(sent_at_us) + 50000 as to_us, max(sent_at_us) + 50000 - 86400000000 as from_us from probes")
OUT = "case when local_outcome is not null then 'send_error' when reply_class is not null then reply_class when sent_at_us + timeout_ns // 1000 > to_us then 'pending' else 'unanswered' end"
view("recent_probes", "probes bounds", f"select *, {OUT} as outcome from probes, bounds where scheduled_at_us >= from_us and scheduled_at_us < to_us")
SLOTS = "greatest(least(case when {b} > first_us then ({b} - 1 - first_us) // 1800000000 else -1 end, missed_count - 1) - case when {a} > first_us then ({a} - first_us + 1799999999) // 1800000000 else 0 end + 1, 0)"
BINS = "cast(greatest(floor(ln(greatest(rtt_ns, 1)::double) / ln(1.02::double)), 0) as int)"
view("recent_hist", "recent_probes", f"select target_id, {BINS} as bin, count(*) as n from recent_probes where rtt_ns is not null group by all")
view("recent", "recent_probes recent_hist gaps targets bounds", f"""
    select *, attempted + missed as scheduled, sent - pending as settled, case when sent > 0 then 100.0::double * (late + unanswered) / sent end as deadline_miss_pct, case when sent > 0 then 100.0::double * unanswered / sent end as no_reply_pct
    from (select target_id, coalesce(attempted, 0) as attempted, coalesce(sent, 0) as sent, coalesce(pending, 0) as pending, coalesce(on_time, 0) as on_time, coalesce(late, 0) as late, coalesce(unanswered, 0) as unanswered,
                 coalesce(send_errors, 0) as send_errors, coalesce(missed, 0) as missed, coalesce(rtt_count, 0) as rtt_count, p95_ns / 1e6::double as p95_ms
          from (select target_id from targets) left join (
                select target_id, count(*) as attempted, count(*) filter (outcome <> 'send_error') as sent, count(*) filter (outcome = 'pending') as pending, count(*) filter (outcome = 'on_time') as on_time,
                       count(*) filter (outcome = 'late') as late, count(*) filter (outcome = 'unanswered') as unanswered, count(*) filter (outcome = 'send_error') as send_errors, count(rtt_ns) as rtt_count from recent_probes group by target_id) using (target_id)
          left join (select target_id, cast(sum({SLOTS.format(a='from_us', b='to_us')}) as bigint) as missed from gaps, bounds group by target_id) using (target_id)
          left join ({PQ.quantile_sql('recent_hist', 'target_id', {'p95_ns': .95})}) using (target_id))""")
view("newest", "probes", "select * from probes qualify row_number() over (partition by target_id order by scheduled_at_us desc, sequence desc) = 1")
view("newest_gap", "gaps", "select target_id, first_us as gap_first_us, first_us + (missed_count - 1) * 1800000000 as gap_last_us, missed_count from gaps qualify row_number() over (partition by target_id order by first_us + (missed_count - 1) * 1800000000 desc) = 1")
view("states", "newest newest_gap targets bounds", """
    select target_id, case when last is null then 'unknown' when to_us - last > 5400000000 then 'stale' when gap_newer then 'scheduler_gap' when local_outcome is not null then 'send_error'
           when reply_class is not null then case when rtt_ns > timeout_ns then 'late' else 'up' end when to_us >= sent_at_us + timeout_ns // 1000 then 'down' else 'pending' end as state, last as last_scheduled_us, rtt_ns / 1e6::double as rtt_ms
    from (select *, case when gap_newer then gap_last_us else scheduled_at_us end as last from (
            select t.target_id, s.* exclude (target_id), g.gap_last_us, to_us, g.gap_last_us is not null and (s.scheduled_at_us is null or g.gap_last_us > s.scheduled_at_us) as gap_newer
            from targets t left join newest s on s.target_id = t.target_id left join newest_gap g on g.target_id = t.target_id, bounds))""")
FROM_T, TO_T = RQ.FROM, RQ.TO
view("route_sums", "traces changes targets", f"""
    select target_id, coalesce(traces, 0) as traces, coalesce(reached, 0) as reached, coalesce(unreached, 0) as unreached, coalesce(errors, 0) as errors, coalesce(changes, 0) as changes, last_trace_us, last_change_us
    from (select target_id from targets) left join (select target_id, count(*) as traces, count(*) filter (status = 'completed' and reached) as reached, count(*) filter (status = 'completed' and not reached) as unreached,
          count(*) filter (status <> 'completed') as errors, max(started_at_us) as last_trace_us from traces where started_at_us >= {FROM_T} and started_at_us < {TO_T} group by all) using (target_id)
    left join (select target_id, count(*) as changes, max(confirmed_at_us) as last_change_us from changes where confirmed_at_us >= {FROM_T} and confirmed_at_us < {TO_T} group by all) using (target_id)""")
view("incident_states", "final ends", "select target_id, case when active then 'obsessing' else 'normal' end as incident_state from final join ends using (target_id, epoch) where end_us is null")
view("flagged", "states recent route_sums incident_states targets", """
    select *, state in ('down', 'late', 'send_error', 'scheduler_gap') or errors > 0 or changes > 0 or deadline or local or missing or obsessing as signal
    from (select target_id, name, stable_id, address, state, deadline_miss_pct, p95_ms, errors, changes, late + unanswered > 0 as deadline, send_errors + missed > 0 as local, state in ('unknown', 'stale') as missing, coalesce(incident_state = 'obsessing', false) as obsessing
          from targets join states using (target_id) join recent using (target_id) join route_sums using (target_id) left join incident_states using (target_id))""")


@lru_cache(maxsize=64)
def _last(spark, sf_dir) -> int:
    return A.probes_sent(spark, sf_dir).agg(F.max("sent_at_us").alias("t")).first()["t"] or 0  # one number


def bounds(spark, sf_dir):
    to = _last(spark, sf_dir) + 50_000
    return to - A.DAY, to


def targets(spark, sf_dir):
    fixed = F.lit(A.INTERVAL_NS).cast("long").alias("interval_ns"), F.lit(150_000_000).cast("long").alias("timeout_ns")
    return A.targets(spark, sf_dir).select("target_id", "name", "stable_id", "address", *fixed)


def states(spark, sf_dir):
    return V.states(targets(spark, sf_dir), A.probes(spark, sf_dir), PQ.gaps_of(spark, sf_dir), bounds(spark, sf_dir)[1])


def recent(spark, sf_dir):
    lo, hi = bounds(spark, sf_dir)
    return V.recent(targets(spark, sf_dir), A.probes(spark, sf_dir), PQ.gaps_of(spark, sf_dir), lo, hi, hi)


def routes(spark, sf_dir):
    rows = RQ.traces(spark, sf_dir)
    from probelake.operators import routes as R

    return V.route_summary(targets(spark, sf_dir), rows, R.route_changes(rows), FROM_T, TO_T)


def flagged(spark, sf_dir):
    from probelake.operators import incidents as O

    status = O.status(IQ.folded(spark, sf_dir), []).select("target_id", F.col("state").alias("incident_state"))
    joined = targets(spark, sf_dir).join(states(spark, sf_dir), "target_id").join(recent(spark, sf_dir), "target_id").join(routes(spark, sf_dir), "target_id").join(status, "target_id", "left")
    return V.flags(joined)


FLAGS = ["deadline", "local", "missing", "obsessing", "signal"]


@query("newest", "select target_id, sequence, scheduled_at_us, rtt_ns from newest")
def latest_sample(spark, sf_dir):
    return V.latest_samples(A.probes(spark, sf_dir)).select("target_id", "sequence", "scheduled_at_us", "rtt_ns")


@query("newest_gap", "select * from newest_gap")
def latest_gap(spark, sf_dir):
    return V.latest_gaps(PQ.gaps_of(spark, sf_dir))


@query("newest endpoint_sightings", "select target_id, sequence, endpoint, first_seen_us from newest join endpoint_sightings using (target_id, endpoint)")
def sample_endpoint(spark, sf_dir):
    from probelake.operators import dims

    return V.latest_samples(A.probes(spark, sf_dir)).join(dims.endpoint_dim(A.probes_sent(spark, sf_dir)), ["target_id", "endpoint"]).select("target_id", "sequence", "endpoint", "first_seen_us")


@query("states", "select target_id, state, last_scheduled_us, case when state in ('late', 'up') then rtt_ms end as last_rtt_ms from states")
def target_state(spark, sf_dir):
    return states(spark, sf_dir)


@query("recent", "select * from recent")
def overview_recent(spark, sf_dir):
    return recent(spark, sf_dir)


W = 5_760_000_000  # a fifteenth of the window


@query("recent_probes gaps targets bounds", f"""
    select target_id, greatest(b, from_us) as from_us, least(b + {W}, to_us) as to_us, coalesce(sent, 0) as sent, coalesce(late, 0) as late, coalesce(unanswered, 0) as unanswered, coalesce(send_errors, 0) as send_errors, coalesce(missed, 0) as missed
    from (select target_id, from_us, to_us, unnest(range(from_us // {W} * {W}, to_us, {W})) as b from targets, bounds)
    left join (select target_id, scheduled_at_us // {W} * {W} as b, count(*) filter (outcome <> 'send_error') as sent, count(*) filter (outcome = 'late') as late, count(*) filter (outcome = 'unanswered') as unanswered,
                      count(*) filter (outcome = 'send_error') as send_errors from recent_probes group by all) using (target_id, b)
    left join (select target_id, b, cast(sum({SLOTS.format(a='greatest(b, from_us)', b=f'least(b + {W}, to_us)')}) as bigint) as missed
               from gaps, (select from_us, to_us, unnest(range(from_us // {W} * {W}, to_us, {W})) as b from bounds) group by all) using (target_id, b)""")
def overview_trend(spark, sf_dir):
    lo, hi = bounds(spark, sf_dir)
    return V.trend(targets(spark, sf_dir), A.probes(spark, sf_dir), PQ.gaps_of(spark, sf_dir), lo, hi, hi)


@query("route_sums", "select * from route_sums")
def overview_route(spark, sf_dir):
    return routes(spark, sf_dir)


N = CQ.NAMES


@query("rates gens bounds", f"""
    select name, rx_mbps, tx_mbps, {', '.join(N)}, coalesce(reset_count, 0) as reset_count, m.name is not null as has_deltas, coalesce(edge_partial, false) as edge_partial
    from (select name, max(rx_mbps) as rx_mbps, max(tx_mbps) as tx_mbps, {', '.join(f'cast(sum({c}_delta) as bigint) as {c}' for c in N)}, bool_or(prev_us < from_us) as edge_partial
          from rates, bounds where sampled_at_us >= from_us and sampled_at_us < to_us group by name) m
    full join (select name, count(*) as reset_count from gens, bounds where reset_reason is not null and sampled_at_us >= from_us and sampled_at_us < to_us group by name) r using (name)""")
def overview_interface(spark, sf_dir):
    g = CQ.gens(spark, sf_dir)
    return V.interface_summary(C.rates(C.deltas(g, N)), g, N, *bounds(spark, sf_dir))


@query("flagged", f"select target_id, {', '.join(FLAGS)} from flagged")
def overview_flags(spark, sf_dir):
    return flagged(spark, sf_dir).select("target_id", *FLAGS)


@query("flagged", """
    select row_number() over (order by p95_ms desc nulls last, name, stable_id) as place, name, p95_ms from flagged where signal and (name ilike '%a%' or stable_id ilike '%a%' or address ilike '%a%')""")
def overview_filter_sort(spark, sf_dir):
    from pyspark.sql import Window

    found = V.find(flagged(spark, sf_dir), "signal", "A", "latency")
    # The table of targets that one page shows.
    w = Window.orderBy(F.col("p95_ms").desc_nulls_last(), "name", "stable_id")
    return found.select(F.row_number().over(w).alias("place"), "name", "p95_ms")


@query("flagged", f"select count(*) as targets, {', '.join(f'count(*) filter ({c}) as {c}' for c in FLAGS)} from flagged")
def overview_counts(spark, sf_dir):
    return V.flag_counts(flagged(spark, sf_dir))


@query("agg_hour", """
    select target_id, arg_max(a, bucket_us) as latest_ms, cast(sum(sent) as bigint) as sent, case when sum(sent) > 0 then 100.0::double * sum(late + unanswered) / sum(sent) end as deadline_miss_pct,
           case when sum(sent) > 0 then 100.0::double * sum(unanswered) / sum(sent) end as no_reply_pct from (select *, case when rtt_count > 0 then rtt_sum_ns / rtt_count / 1e6::double end as a from agg_hour) group by target_id""")
def stats_header(spark, sf_dir):
    """The latest mean is the newest point's that has one."""
    return V.header(PQ.ping_series(spark, sf_dir))
