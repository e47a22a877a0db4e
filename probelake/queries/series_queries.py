"""Queries of chart series."""

from pyspark.sql import functions as F

from probelake.functions.scalars import nice_ceil, nice_ceil_sql
from probelake.operators import probes as P
from probelake.operators import series as S
from probelake.queries.base import query, view
from probelake.queries.probe_queries import AS_OF, OUTCOME, Q3, gaps_of, quantile_sql
from probelake.sources import adapters as A

# Charts of a day: buckets that hold more than 17 replies occur.
WIDTH = A.DAY
BIN_VALUE = "cast(round(exp((bin + 0.5::double) * ln(1.02::double))) as bigint)"
BIN = "cast(greatest(floor(ln(greatest(rtt_ns, 1)::double) / ln(1.02::double)), 0) as int)"
view("hist_day", "probes", f"select target_id, scheduled_at_us // {WIDTH} * {WIDTH} as bucket_us, {BIN} as bin, count(*) as n from probes where rtt_ns is not null group by all")
view("hist_target", "probes", f"select target_id, {BIN} as bin, count(*) as n from probes where rtt_ns is not null group by all")
view("agg_day", "probes", f"""
    select target_id, scheduled_at_us // {WIDTH} * {WIDTH} as bucket_us, count(*) as attempted, count(*) filter ({OUTCOME} = 'late') as late, count(rtt_ns) as rtt_count,
           min(rtt_ns) as rtt_min_ns, max(rtt_ns) as rtt_max_ns, min(timeout_ns) as timeout_min_ns, max(timeout_ns) as timeout_max_ns from probes group by all""")
# Twice: with the usual seam, and with one so low that there is much above it.
for x, seam in (("", "p95_ns"), ("_low", "p50_ns")):
    view(f"pooled{x}", "hist_target probes", f"""
        select target_id, rtt_count, p50_ns / 1e6::double as p50_ms, p95_ns / 1e6::double as p95_ms, p99_ns / 1e6::double as p99_ms, max_ns / 1e6::double as max_ms, {nice_ceil_sql(f'(2 * {seam} / 1e6::double)')} as seam_ms
        from ({quantile_sql('hist_target', 'target_id', Q3)}) q join (select target_id, count(rtt_ns) as rtt_count, max(rtt_ns) as max_ns from probes group by target_id) t using (target_id)""")
    view(f"tails{x}", f"hist_day agg_day pooled{x}", f"""
        select target_id, bucket_us, place, greatest(rtt_min_ns, least(value, rtt_max_ns)) / 1e6::double as value_ms, n,
               (run <= late and (timeout_min_ns = timeout_max_ns or low > timeout_max_ns)) as late, truncated from (
            select *, row_number() over k as place, count(*) over (partition by target_id, bucket_us) > 24 as truncated, sum(n) over k as run, cast(floor(exp(bin * ln(1.02::double))) as bigint) as low
            from (select h.*, a.*, {BIN_VALUE} as value,
                         least(case when seam_ms > 0 then cast(floor(seam_ms * 1e6) as bigint) + 1 end, case when a.rtt_count > 17 then greatest(4 * p50_ns, p95_ns) end) as threshold
                  from hist_day h join (select * exclude (target_id, bucket_us), target_id as t, bucket_us as b from agg_day) a on target_id = t and bucket_us = b
                  join (select target_id as qt, bucket_us as qb, p50_ns, p95_ns from ({quantile_sql('hist_day', 'target_id, bucket_us', {'p50_ns': .5, 'p95_ns': .95})})) q on target_id = qt and bucket_us = qb
                  join (select target_id as pt, seam_ms from pooled{x}) p on target_id = pt)
            where value >= threshold window k as (partition by target_id, bucket_us order by bin desc))
        where place <= 24""")
    view(f"scale{x}", f"pooled{x}", f"""
        select target_id, seam_ms, seam_ms > 0 and max_ms >= 3 * seam_ms as sky, {nice_ceil_sql("((case when seam_ms > 0 and max_ms >= 3 * seam_ms then 1.15::double else 1.08::double end) * max_ms)")} as top_ms from pooled{x}""")
    view(f"embers{x}", f"tails{x} scale{x}", f"""
        select *, not late and severity < 0.35 as mild from (
            select target_id, bucket_us, place, value_ms, n, late, least(greatest(ln(value_ms / seam_ms) / ln(greatest(top_ms / seam_ms, 20)), 0), 1) as severity
            from tails{x} join scale{x} using (target_id) where sky and value_ms > seam_ms)""")
view("worst", "probes", f"""
    select target_id, bucket_us, place, scheduled_at_us, rtt_ns, reply_class = 'late' as late from (
        select *, row_number() over (partition by target_id, bucket_us order by rtt_ns desc, scheduled_at_us, sequence) as place
        from (select *, scheduled_at_us // {WIDTH} * {WIDTH} as bucket_us from probes where rtt_ns is not null and local_outcome is null)) where place <= 5""")


def _parts(spark, sf_dir):
    rows = A.probes(spark, sf_dir)
    return rows, P.bins(rows, WIDTH), P.raw_agg(rows, gaps_of(spark, sf_dir), WIDTH, AS_OF).where("attempted > 0")


@query("pooled", "select * from pooled")
def ping_window(spark, sf_dir):
    _, hist, agg = _parts(spark, sf_dir)
    return S.window_stats(hist, agg)


@query("hist_day agg_day", f"""
    select target_id, bucket_us, i, greatest(rtt_min_ns, least({BIN_VALUE}, rtt_max_ns)) / 1e6::double as value_ms
    from (select *, sum(n) over (partition by target_id, bucket_us order by bin) as cum, sum(n) over (partition by target_id, bucket_us) as total from hist_day) h
    join (select target_id, bucket_us, i, greatest(ceil((i + 0.5::double) / least(rtt_count, 17) * rtt_count), 1) as rank from (select *, unnest(range(least(rtt_count, 17))) as i from agg_day)) q using (target_id, bucket_us)
    join agg_day using (target_id, bucket_us) where cum >= rank and cum - n < rank""")
def ping_distribution(spark, sf_dir):
    _, hist, agg = _parts(spark, sf_dir)
    return S.distribution(hist, agg)


@query("tails", "select * from tails")
def ping_tail(spark, sf_dir):
    _, hist, agg = _parts(spark, sf_dir)
    return S.tail(hist, agg, S.window_stats(hist, agg))


@query("worst", "select * from worst")
def worst_samples(spark, sf_dir):
    return S.worst_samples(A.probes(spark, sf_dir), WIDTH)


@query("probes", f"""
    select target_id, bucket_us, place, scheduled_at_us from (
        select *, row_number() over (partition by target_id, bucket_us order by scheduled_at_us, sequence) as place
        from (select *, scheduled_at_us // {WIDTH} * {WIDTH} as bucket_us from probes where {OUTCOME} = 'unanswered')) where place <= 5""")
def missed_samples(spark, sf_dir):
    return S.missed_samples(A.probes(spark, sf_dir), WIDTH, AS_OF)


@query("agg_day", "select target_id, bucket_us, attempted from (select *, sum(attempted) over (partition by target_id) as total from agg_day where bucket_us >= 1704412800000000) where total <= 860")
def exact_budget(spark, sf_dir):
    _, _, agg = _parts(spark, sf_dir)
    return S.exact_buckets(agg, 860, 1_704_412_800_000_000)


view("exact_raw", "agg_day probes", f"""
    select * from (select *, scheduled_at_us // {WIDTH} * {WIDTH} as bucket_us from probes) where (target_id, bucket_us) in (
        select (target_id, bucket_us) from (select *, sum(attempted) over (partition by target_id) as total from agg_day where bucket_us >= 1704412800000000) where total <= 860)""")


@query("exact_raw", f"""
    select * from (select 'worst' as kind, target_id, bucket_us, row_number() over (partition by target_id, bucket_us order by rtt_ns desc, scheduled_at_us, sequence) as place, scheduled_at_us, rtt_ns, reply_class = 'late' as late
                   from exact_raw where rtt_ns is not null and local_outcome is null) where place <= 5
    union all
    select * from (select 'missed', target_id, bucket_us, row_number() over (partition by target_id, bucket_us order by scheduled_at_us, sequence) as place, scheduled_at_us, null::bigint, null::boolean
                   from exact_raw where {OUTCOME} = 'unanswered') where place <= 5""")
def exact_samples(spark, sf_dir):
    _, _, agg = _parts(spark, sf_dir)
    return S.exact_samples(A.probes(spark, sf_dir), agg, WIDTH, AS_OF, 860, 1_704_412_800_000_000)


@query("scale", "select * from scale")
def outlier_scale(spark, sf_dir):
    _, hist, agg = _parts(spark, sf_dir)
    return S.outlier_scale(S.window_stats(hist, agg))


@query("embers_low", "select * from embers_low")
def ember_severity(spark, sf_dir):
    _, hist, agg = _parts(spark, sf_dir)
    window = S.window_stats(hist, agg, "p50_ns")
    return S.embers(S.tail(hist, agg, window), S.outlier_scale(window))


@query("embers_low worst", """
    select e.target_id, e.bucket_us, e.place, coalesce(w.rtt_ns / 1e6::double, e.value_ms) as label_ms, w.rtt_ns is not null as exact
    from (select *, row_number() over (partition by target_id order by value_ms desc, bucket_us) as place
          from (select target_id, bucket_us, max(value_ms) as value_ms from embers_low where not mild group by all)) e
    left join (select * from worst where place = 1) w using (target_id, bucket_us) where e.place <= 3""")
def labelled_outliers(spark, sf_dir):
    return S.labelled(ember_severity(spark, sf_dir), worst_samples(spark, sf_dir))


@query("", f"""
    with v as (select event_id, value * 7.3::double as x from events where value is not null) select event_id, x, {nice_ceil_sql('x')} as nice from v""")
def nice_ceil_values(spark, sf_dir):
    rows = A.table(spark, sf_dir, "events").where("value is not null").select("event_id", (F.col("value") * 7.3).alias("x"))
    return rows.withColumn("nice", nice_ceil(F.col("x")))


@query("agg_day hist_target probes gaps", f"""
    select target_id, scheduled_at_us // 1 * 0 as bucket_us, count(*) as attempted, count(rtt_ns) as rtt_count, min(rtt_ns) as rtt_min_ns, max(rtt_ns) as rtt_max_ns, any_value(p95) as p95_ns
    from probes join (select target_id, p95 from ({quantile_sql('hist_target', 'target_id', {'p95': .95})})) using (target_id) group by target_id, bucket_us""")
def ping_single_point(spark, sf_dir):
    """A request for one point: all buckets of a target as one."""
    from probelake.functions import sketch

    _, hist, agg = _parts(spark, sf_dir)
    one = P.merge_agg(agg.withColumn("bucket_us", F.lit(0).cast("long")), ["target_id", "bucket_us"])
    q = sketch.quantiles(sketch.merge(hist, ["target_id"]), ["target_id"], {"p95_ns": 0.95})
    return one.join(q, "target_id").select("target_id", "bucket_us", "attempted", "rtt_count", "rtt_min_ns", "rtt_max_ns", "p95_ns")
