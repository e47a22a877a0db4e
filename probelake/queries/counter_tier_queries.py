"""Queries of counter rollups that are kept up in batches with late samples."""

from functools import lru_cache

from pyspark.sql import functions as F

from probelake.operators import counters as C
from probelake.plans import counter_tiers as T
from probelake.queries.base import query, view
from probelake.queries.counter_queries import FROM, NAMES, TO, gens
from probelake.queries.tier_queries import scratch
from probelake.sources import adapters as A

M, H = A.MINUTE, A.HOUR
#: Three batches: before and after this time, and last what came late.
SPLIT, LATE = 1_705_276_800_000_000, "event_id % 7 = 0"
BATCHES = [f"not ({LATE}) and sampled_at_us < {SPLIT}", f"not ({LATE}) and sampled_at_us >= {SPLIT}", LATE]
PLACE = f"case when {LATE} then 2 when sampled_at_us >= {SPLIT} then 1 else 0 end"


def batches(spark, sf_dir):
    """The samples, written once, with the batch that each comes in."""
    path = scratch(spark, "samples")
    gens(spark, sf_dir).withColumn("batch", F.expr(PLACE)).write.parquet(path)
    return spark.read.parquet(path)


@lru_cache(maxsize=4)  # one run of the batches answers both queries of a session
def kept_up(spark, sf_dir):
    """(minutes, hours) after three batches, each of which redoes only what it touches."""
    every = batches(spark, sf_dir)
    minutes, hours = C.rollup(every.limit(0), NAMES, M), C.merge_rollups(C.rollup(every.limit(0), NAMES, M), NAMES, H)
    for k in range(len(BATCHES)):
        held, new = every.where(F.col("batch") <= k), every.where(F.col("batch") == k)
        minutes, hours = T.update(minutes, hours, T.dirty_buckets(new, held), held, NAMES)
        at = scratch(spark, "minutes"), scratch(spark, "hours")
        for df, path in zip((minutes, hours), at, strict=True):
            df.write.parquet(path)
        minutes, hours = map(spark.read.parquet, at)
    return minutes, hours


@query("iface_minute", "select * from iface_minute")
def iface_incremental_minute(spark, sf_dir):
    return kept_up(spark, sf_dir)[0]


@query("iface_hour", "select * from iface_hour")
def iface_incremental_hour(spark, sf_dir):
    return kept_up(spark, sf_dir)[1]


view("iface_late", "gens", f"""
    select distinct name, generation, unnest([sampled_at_us, next_us]) // {M} * {M} as bucket_us
    from (select *, lead(sampled_at_us) over (partition by name, generation order by sampled_at_us, event_id) as next_us from gens) where {LATE}""")


def late_minutes(spark, sf_dir):
    every = gens(spark, sf_dir)
    return every, T.dirty_buckets(every.where(LATE), every)


@query("iface_late", "select distinct name, generation, bucket_us from iface_late where bucket_us is not null")
def iface_dirty_buckets(spark, sf_dir):
    """Minutes that late samples touch, with those of the samples after them."""
    return late_minutes(spark, sf_dir)[1]


@query("iface_late gens", f"""
    select l.name, l.generation, l.bucket_us from iface_late l join (select name, generation, max(sampled_at_us) as last_us from gens group by all) g using (name, generation) join (select name, max(generation) as open from gens group by all) o using (name)
    where bucket_us is not null and bucket_us + {M} <= {A.AS_OF} and (last_us >= bucket_us + {M} or generation < open)""")
def iface_sealable(spark, sf_dir):
    every, dirty = late_minutes(spark, sf_dir)
    closed = every.select("name", "generation").distinct().join(C.open_generations(every), "name").where("generation < open")
    return T.sealable(dirty, every, closed, A.AS_OF)


@query("iface_late", f"""
    select distinct name, generation, bucket_us // {H} * {H} as bucket_us from iface_late where bucket_us is not null
    and (name, generation, bucket_us // {H} * {H}) not in (select (name, generation, bucket_us // {H} * {H}) from iface_late where bucket_us is not null and bucket_us // {H} % 3 = 0)""")
def iface_dirty_eligible(spark, sf_dir):
    """Dirty hours whose minutes are clean, whether over or not; here those of every third hour are not."""
    _, dirty = late_minutes(spark, sf_dir)
    return T.sealable_hours(T.parents(dirty), dirty.where(F.floor(F.col("bucket_us") / H) % 3 == 0))


W = 3 * H


@query("rates gens iface_late", f"""
    select * from (with late as (select distinct name, generation, bucket_us // {H} * {H} as hour_us from iface_late where bucket_us is not null),
    r as (select r.*, case when l.hour_us is null then sampled_at_us // {H} * {H} else sampled_at_us // {M} * {M} end as row_us, case when l.hour_us is null then {H} else {M} end as source_us
          from rates r left join late l on l.name = r.name and l.generation = r.generation and l.hour_us = r.sampled_at_us // {H} * {H})
    select name, bucket_us, peak_rx_bytes_per_s, peak_tx_bytes_per_s, {', '.join(NAMES)}, m.name is not null as has_deltas, coalesce(reset_count, 0) as reset_count, bucket_us < {FROM} or bucket_us + {W} > {TO} as edge_partial
    from (select name, row_us // {W} * {W} as bucket_us, max(rx_bytes_per_s) as peak_rx_bytes_per_s, max(tx_bytes_per_s) as peak_tx_bytes_per_s, {', '.join(f'cast(sum({c}_delta) as bigint) as {c}' for c in NAMES)}
          from r where row_us + source_us > {FROM} and row_us < {TO} group by all) m
    full join (select name, sampled_at_us // {W} * {W} as bucket_us, count(*) as reset_count from gens where reset_reason is not null and sampled_at_us >= {FROM} and sampled_at_us < {TO} group by all) g using (name, bucket_us))""")
def iface_series_tiers(spark, sf_dir):
    """Three-hour buckets from hours, the minutes of hours with late samples, and samples for dirty minutes."""
    every, dirty = late_minutes(spark, sf_dir)
    before = every.where(f"not ({LATE})")
    minutes = C.rollup(before, NAMES, M)
    hours = C.merge_rollups(minutes, NAMES, H)
    rows = T.overlay(minutes, hours, dirty, T.parents(dirty).limit(0), every, NAMES)
    resets = every.where("reset_reason is not null").select("name", F.col("sampled_at_us").alias("at_us"))
    return T.series(rows, resets, NAMES, W, FROM, TO)
