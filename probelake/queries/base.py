"""Registration of queries and the SQL views that their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VIEWS = {
    "probes": ("", """
        select user_id % 10 as target_id, event_id as sequence, epoch_us(ts) as scheduled_at_us, epoch_us(ts) as sent_at_us,
               (case when event_id % 2 = 0 then 100000000 else 150000000 end)::bigint as timeout_ns,
               case when event_type = 'error' then 'send_error' end as local_outcome,
               case when event_type not in ('error', 'signup') then cast(round(value * 1e6) as bigint) end as rtt_ns,
               case when event_type not in ('error', 'signup') then
                    case when cast(round(value * 1e6) as bigint) > (case when event_id % 2 = 0 then 100000000 else 150000000 end)
                         then 'late' else 'on_time' end end as reply_class,
               case when event_type not in ('error', 'signup') then epoch_us(ts) + cast(round(value * 1e6) as bigint) // 1000 end as reply_at_us,
               user_id % 10 * 10 + day(ts) // 10 as endpoint
        from events"""),
    "gaps": ("probes", """
        select target_id, prev + 1800000000 as first_us, 1800000000000::bigint as interval_ns, (t - prev) // 1800000000 - 1 as missed_count
        from (select target_id, scheduled_at_us as t,
                     lag(scheduled_at_us) over (partition by target_id order by scheduled_at_us, sequence) as prev from probes)
        where (t - prev) // 1800000000 - 1 > 0"""),
    "replies": ("probes", """
        select sequence, sent_at_us, reply_at_us, rtt_ns, endpoint as responder from probes where reply_class is not null
        union all select sequence, sent_at_us, reply_at_us + 1, rtt_ns, endpoint from probes where reply_class is not null and sequence % 11 = 0
        union all select sequence, sent_at_us, reply_at_us - 1, rtt_ns, endpoint + 1000 from probes where reply_class is not null and sequence % 13 = 0
        union all select sequence + 1000000000, sent_at_us, reply_at_us, rtt_ns, endpoint from probes where reply_class is not null and sequence % 17 = 0"""),
    "counters": ("", """
        select name, event_id, sampled_at_us, mac, run % 1000 as rx_bytes, seen * 7 as tx_bytes, seen as rx_packets, errs as rx_errors, errs // 3 as rx_dropped
        from (select user_id % 10 as name, event_id, epoch_us(ts) as sampled_at_us, day(ts) // 15 as mac,
                     cast(sum(cast(json_extract_string(props, '$.k') as bigint)) over w as bigint) as run,
                     count(*) over w as seen, cast(sum(case when event_type = 'error' then 1 else 0 end) over w as bigint) as errs
              from events window w as (partition by user_id % 10 order by ts, event_id rows between unbounded preceding and current row))"""),
    "hops": ("", """
        select l_orderkey as trace_id, cast((l_linenumber - 1) % 3 + 1 as int) as ttl, cast(l_linenumber as int) as probe_index,
               l_linestatus as responder, l_partkey as token from lineitem"""),
    "runs": ("", """
        select o_orderkey as trace_id, o_custkey % 10 as target_id, o_custkey % 10 as endpoint_id, epoch_us(o_orderdate::timestamp) as started_at_us,
               epoch_us(o_orderdate::timestamp) + 1000000 as ended_at_us,
               case when o_orderstatus = 'P' then 'timed_out' else 'completed' end as status, o_orderstatus = 'F' as reached from orders"""),
    "targets": ("", """
        select n_nationkey::bigint as target_id, 't' || n_nationkey as stable_id, n_name as name, '10.0.' || n_regionkey || '.' || n_nationkey as address,
               ['auto', '4', '6'][n_regionkey % 3 + 1] as family,
               case when n_nationkey % 4 = 0 then 5000000000 * (n_nationkey + 1) end as ping_interval_ns,
               case when n_nationkey % 6 = 1 then 2000000000 end as legacy_interval_ns,
               case when n_nationkey % 5 = 0 then 500000000 end as ping_timeout_ns,
               case when n_nationkey % 3 = 0 then ['50%', '100ms', '-5%', '0.2s'][n_nationkey % 4 + 1] end as latency_threshold
        from nation"""),
}


def view(name: str, needs: str, sql: str) -> None:
    """Add a view that later oracles can name."""
    VIEWS[name] = (needs, sql)


def with_views(needs: str, sql: str) -> str:
    """The statement, after the views that it needs and those that these need."""
    order: list[str] = []

    def add(names: str) -> None:
        for n in names.split():
            add(VIEWS[n][0])
            if n not in order:
                order.append(n)

    add(needs)
    return (f"with {', '.join(f'{n} as ({VIEWS[n][1]})' for n in order)} " if order else "") + sql


def query(needs: str = "", sql: str | None = None, name: str | None = None):
    """Register a function as a query, with its SQL over the named views."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = with_views(needs, sql)
        return f

    return register
