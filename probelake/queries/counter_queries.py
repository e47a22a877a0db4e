"""Queries of interface counters."""

from pyspark.sql import functions as F

from probelake.operators import counters as C
from probelake.queries.base import query, view
from probelake.sources import adapters as A

NAMES = A.COUNTERS
DOWN = " or ".join(f"{c} < lag({c}) over w" for c in NAMES)
FROM, TO = 1_704_153_600_000_000 + 1_800_000_000, 1_704_844_800_000_000  # a window that starts inside a bucket

view("reasons", "counters", f"""
    select *, case when coalesce(mac <> lag(mac) over w, false) then 'identity_changed' when coalesce({DOWN}, false) then 'counter_decreased' end as reset_reason
    from counters window w as (partition by name order by sampled_at_us, event_id)""")
view("gens", "reasons", "select *, cast(sum(case when reset_reason is not null then 1 else 0 end) over (partition by name order by sampled_at_us, event_id) as bigint) as generation from reasons")
view("deltas", "gens", f"""
    select *, sampled_at_us - prev_us as elapsed_us from (
        select name, generation, sampled_at_us, event_id, lag(sampled_at_us) over w as prev_us, {', '.join(f'{c} - lag({c}) over w as {c}_delta' for c in NAMES)}
        from gens window w as (partition by name, generation order by sampled_at_us, event_id)) where sampled_at_us > prev_us""")
view("rates", "deltas", """
    select *, rx_bytes_delta * 8 / (elapsed_us / 1e6::double) / 1e6::double as rx_mbps, tx_bytes_delta * 8 / (elapsed_us / 1e6::double) / 1e6::double as tx_mbps,
           rx_bytes_delta * 1000000 // elapsed_us as rx_bytes_per_s, tx_bytes_delta * 1000000 // elapsed_us as tx_bytes_per_s from deltas""")
SUMS = ", ".join(f"cast(sum({c}_delta) as bigint) as {c}_delta" for c in NAMES)
for w, n in ((A.MINUTE, "minute"), (A.HOUR, "hour")):
    view(f"iface_{n}", "rates gens", f"""
        select * from (select name, generation, sampled_at_us // {w} * {w} as bucket_us, count(*) as sample_count, count(reset_reason) as reset_count from gens group by all) s
        left join (select name, generation, sampled_at_us // {w} * {w} as bucket_us, cast(sum(elapsed_us) as bigint) as elapsed_us, {SUMS},
                          max(rx_bytes_per_s) as peak_rx_bytes_per_s, max(tx_bytes_per_s) as peak_tx_bytes_per_s from rates group by all) m using (name, generation, bucket_us)""")
view("iface_points", "rates gens", f"""
    select name, bucket_us, rx_mbps, tx_mbps, {', '.join(NAMES)}, m.name is not null as has_deltas, coalesce(reset_count, 0) as reset_count, bucket_us < {FROM} or bucket_us + 3600000000 > {TO} as edge_partial
    from (select name, sampled_at_us // 3600000000 * 3600000000 as bucket_us, max(rx_mbps) as rx_mbps, max(tx_mbps) as tx_mbps, {', '.join(f'cast(sum({c}_delta) as bigint) as {c}' for c in NAMES)}
          from rates where sampled_at_us >= {FROM} and sampled_at_us < {TO} group by all) m
    full join (select name, sampled_at_us // 3600000000 * 3600000000 as bucket_us, count(*) as reset_count from gens where reset_reason is not null and sampled_at_us >= {FROM} and sampled_at_us < {TO} group by all) r using (name, bucket_us)""")
view("iface_signal", "iface_points", """
    select *, coalesce(rx_errors > 0, false) as has_errors, coalesce(rx_dropped > 0, false) as has_drops,
           coalesce(rx_errors > 0, false) or coalesce(rx_dropped > 0, false) or reset_count > 0 as signal from iface_points""")


def gens(spark, sf_dir):
    return C.with_generation(A.counters(spark, sf_dir), NAMES)


def points(spark, sf_dir):
    return C.series(gens(spark, sf_dir), NAMES, A.HOUR, FROM, TO)


def configured(spark, sf_dir):
    """Interfaces 0 to 11; two of them are never sampled."""
    return spark.range(12).withColumnRenamed("id", "name")


@query("deltas", "select * from deltas")
def counter_deltas(spark, sf_dir):
    return C.deltas(gens(spark, sf_dir), NAMES)


@query("rates", "select name, event_id, rx_mbps, tx_mbps, rx_bytes_per_s, tx_bytes_per_s from rates")
def counter_rates(spark, sf_dir):
    return C.rates(C.deltas(gens(spark, sf_dir), NAMES)).select("name", "event_id", "rx_mbps", "tx_mbps", "rx_bytes_per_s", "tx_bytes_per_s")


@query("reasons", "select name, event_id, reset_reason from reasons where reset_reason is not null")
def reset_reason(spark, sf_dir):
    return C.reset_reason(A.counters(spark, sf_dir), NAMES).where("reset_reason is not null").select("name", "event_id", "reset_reason")


@query("counters", f"""
    select name, event_id, reset_reason from (
        select name, event_id, case when mac <> lag(mac) over w then 'collector_restart_or_identity_change' when at_us <= lag(at_us) over w then 'non_monotonic_sample_time'
               when {DOWN} then 'counter_decreased_while_stopped' end as reset_reason
        from (select *, case when event_id % 97 = 0 then sampled_at_us - 86400000000 else sampled_at_us end as at_us from counters) window w as (partition by name order by event_id)) where reset_reason is not null""")
def reset_reason_ingest(spark, sf_dir):
    rows = A.counters(spark, sf_dir).withColumn("sampled_at_us", F.when(F.col("event_id") % 97 == 0, F.col("sampled_at_us") - A.DAY).otherwise(F.col("sampled_at_us")))
    return C.ingest_reason(rows, NAMES).where("reset_reason is not null").select("name", "event_id", "reset_reason")


@query("gens", "select *, lead(started_at_us) over (partition by name order by generation) as ended_at_us from (select name, generation, min(sampled_at_us) as started_at_us, arg_min(mac, (sampled_at_us, event_id)) as mac, count(*) as samples from gens group by all)")
def generations(spark, sf_dir):
    return C.generations(gens(spark, sf_dir))


@query("iface_minute", "select * from iface_minute")
def iface_rollup_minute(spark, sf_dir):
    return C.rollup(gens(spark, sf_dir), NAMES, A.MINUTE)


@query("iface_hour", "select * from iface_hour")
def iface_rollup_hour(spark, sf_dir):
    """Hours as merged minutes; the oracle computes them from the samples."""
    return C.merge_rollups(C.rollup(gens(spark, sf_dir), NAMES, A.MINUTE), NAMES, A.HOUR)


@query("iface_points", "select * from iface_points")
def iface_series(spark, sf_dir):
    return points(spark, sf_dir)


@query("iface_points", f"select name, max(rx_mbps) as rx_mbps, max(tx_mbps) as tx_mbps, {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in NAMES)}, cast(sum(reset_count) as bigint) as reset_count from iface_points group by name")
def iface_single_point(spark, sf_dir):
    return points(spark, sf_dir).groupBy("name").agg(F.max("rx_mbps").alias("rx_mbps"), F.max("tx_mbps").alias("tx_mbps"), *[F.sum(c).alias(c) for c in (*NAMES, "reset_count")])


@query("iface_signal", "select name, bucket_us, has_errors, has_drops, signal from iface_signal")
def iface_signal(spark, sf_dir):
    return C.signal(points(spark, sf_dir)).select("name", "bucket_us", "has_errors", "has_drops", "signal")


@query("iface_points", f"""
    select s.name, s.bucket_us, greatest(s.bucket_us, {FROM}) as slot_from_us, least(s.bucket_us + 3600000000, {TO}) as slot_to_us, p.rx_mbps, p.reset_count, p.has_deltas
    from (select name, unnest(range({FROM} // 3600000000 * 3600000000, {TO}, 3600000000)) as bucket_us from (select distinct name from iface_points)) s left join iface_points p using (name, bucket_us)""")
def iface_dense_slots(spark, sf_dir):
    return C.dense_slots(points(spark, sf_dir), A.HOUR, FROM, TO).select("name", "bucket_us", "slot_from_us", "slot_to_us", "rx_mbps", "reset_count", "has_deltas")


@query("iface_signal", "select row_number() over (order by bucket_us, name) as place, name, bucket_us from iface_signal where signal")
def signal_timeline(spark, sf_dir):
    """The signals of all days in order."""
    return C.timeline(C.signal(points(spark, sf_dir)).where("signal"))


@query("iface_signal", "select place, name, bucket_us // 86400000000 as day from (select *, row_number() over (order by bucket_us, name) as place from iface_signal where signal)")
def signal_timeline_all(spark, sf_dir):
    """The same places by day."""
    return C.timeline(C.signal(points(spark, sf_dir)).where("signal")).select("place", "name", F.floor(F.col("bucket_us") / A.DAY).alias("day"))


@query("reasons", """
    select name, place, at_us, reset_reason, total, total > 20 as truncated from (
        select name, sampled_at_us as at_us, reset_reason, row_number() over (partition by name order by sampled_at_us desc, event_id desc) as place, count(*) over (partition by name) as total from reasons where reset_reason is not null)
    where place <= 20""")
def reset_details(spark, sf_dir):
    return C.reset_details(gens(spark, sf_dir), 20)


@query("counters", """
    select name, tick_us as at_us from (
        select *, lag(missing, 1, false) over (partition by name order by tick_us) as before from (
            select n.name, t.tick_us, s.name is null as missing from (select distinct sampled_at_us // 86400000000 * 86400000000 as tick_us from counters where event_id % 3 = 0) t
            cross join (select unnest(range(12)) as name) n
            left join (select distinct name, sampled_at_us // 86400000000 * 86400000000 as tick_us from counters where event_id % 3 = 0 and not (name = 4 and sampled_at_us // 86400000000 % 5 = 0)) s using (name, tick_us)))
    where missing and not before""")
def interface_missing(spark, sf_dir):
    rows = A.counters(spark, sf_dir).where("event_id % 3 = 0")
    gaps = rows.where(~((F.col("name") == 4) & (F.floor(F.col("sampled_at_us") / A.DAY) % 5 == 0)))
    return C.missing_interfaces(gaps, configured(spark, sf_dir), A.DAY)


@query("counters", """
    select * from (with recursive s as (select name, list(sampled_at_us order by sampled_at_us) as t from counters group by all),
         f as (select name, t, t[1] as kept from s union all
               select name, t, list_min(list_filter(t, lambda x: x >= kept + 21600000000)) from f where list_min(list_filter(t, lambda x: x >= kept + 21600000000)) is not null)
    select name, kept as sampled_at_us from f)""")
def thin_samples(spark, sf_dir):
    return C.thin(A.counters(spark, sf_dir), 6 * A.HOUR)


@query("gens", """
    select c.name, s.sampled_at_us, s.generation, s.rx_bytes, coalesce(s.generation = (select max(generation) from gens g where g.name = c.name), false) as present
    from (select unnest(range(12)) as name) c left join (select * from gens qualify row_number() over (partition by name order by sampled_at_us desc, event_id desc) = 1) s using (name)""")
def iface_latest(spark, sf_dir):
    return C.latest(gens(spark, sf_dir), configured(spark, sf_dir))
