"""Queries of the latency sketch."""

from pyspark.sql import functions as F

from probelake.functions import sketch as H
from probelake.operators import probes as P
from probelake.queries.base import query
from probelake.queries.probe_queries import BIN, Q3, quantile_sql
from probelake.sources import adapters as A

KEYS = ["target_id", "bucket_us"]


@query("probes", f"select sequence, {BIN} as bin from probes where rtt_ns is not null")
def hist_bin(spark, sf_dir):
    return A.probes(spark, sf_dir).where("rtt_ns is not null").select("sequence", H.bin_of(F.col("rtt_ns")).alias("bin"))


@query("hist_hour", "select * from hist_hour")
def hist_build(spark, sf_dir):
    packed = H.pack(P.bins(A.probes(spark, sf_dir), A.HOUR), KEYS)
    return H.unpack(packed, KEYS)


@query("hist_hour", "select target_id, bin, cast(sum(n) as bigint) as n from hist_hour group by all")
def hist_merge(spark, sf_dir):
    return H.merge(P.bins(A.probes(spark, sf_dir), A.HOUR), ["target_id"])


@query("hist_hour", quantile_sql("hist_hour", "target_id, bucket_us", Q3 | {"low_ns": 0.0, "high_ns": 1.0, "p07_ns": 0.07}))
def hist_quantiles(spark, sf_dir):
    return H.quantiles(P.bins(A.probes(spark, sf_dir), A.HOUR), KEYS, Q3 | {"low_ns": 0.0, "high_ns": 1.0, "p07_ns": 0.07})


@query("probes", f"""
    with h as (select target_id, {BIN} as bin, count(*) as n from probes where rtt_ns is not null group by all)
    select target_id, place, value, low, n, truncated from (
        select *, cast(floor(exp(bin * ln(1.02::double))) as bigint) as low, row_number() over (partition by target_id order by bin desc) as place, count(*) over (partition by target_id) > 10 as truncated
        from (select *, cast(round(exp((bin + 0.5::double) * ln(1.02::double))) as bigint) as value from h) where value >= 50000000)
    where place <= 10""".replace("with h as", "select * from (with h as") + ")")
def hist_top_bins(spark, sf_dir):
    bins = H.build(A.probes(spark, sf_dir), ["target_id"], "rtt_ns")
    return H.top_bins(bins, ["target_id"], F.lit(50_000_000), 10).select("target_id", "place", "value", "low", "n", "truncated")


@query("hist_hour", "select distinct bin, cast(floor(exp(bin * ln(1.02::double))) as bigint) as low, cast(round(exp((bin + 0.5::double) * ln(1.02::double))) as bigint) as value from hist_hour")
def hist_bounds(spark, sf_dir):
    bins = P.bins(A.probes(spark, sf_dir), A.HOUR).select("bin").distinct()
    return bins.select("bin", H.bin_low(F.col("bin")).alias("low"), H.bin_value(F.col("bin")).alias("value"))


@query("probes", f"""
    select target_id, rtt_count, abs(sketch_ns - exact_ns) / exact_ns::double <= 0.011 as close from (
        select target_id, total as rtt_count, cast(round(exp((min(bin) filter (cum >= rank) + 0.5::double) * ln(1.02::double))) as bigint) as sketch_ns, min(rtt_ns) filter (place = rank) as exact_ns
        from (select *, row_number() over (partition by target_id order by rtt_ns, sequence) as place, count(*) over (partition by target_id order by bin) as cum,
                     count(*) over (partition by target_id) as total, greatest(ceil(0.95::double * count(*) over (partition by target_id)), 1) as rank
              from (select *, {BIN} as bin from probes where rtt_ns > 0)) group by target_id, total)""")
def hist_relative_error(spark, sf_dir):
    """Whether the sketch's p95 lies within 1.1 % of the exact nearest rank."""
    from pyspark.sql import Window

    rows = A.probes(spark, sf_dir).where("rtt_ns > 0")
    q = H.quantiles(H.build(rows, ["target_id"], "rtt_ns"), ["target_id"], {"sketch_ns": 0.95})
    w = Window.partitionBy("target_id")
    ranked = rows.select("target_id", "rtt_ns", F.row_number().over(w.orderBy("rtt_ns", "sequence")).alias("place"), F.count("*").over(w).alias("rtt_count"))
    exact = ranked.where(F.col("place") == H.rank(0.95, F.col("rtt_count"))).select("target_id", "rtt_count", F.col("rtt_ns").alias("exact_ns"))
    close = F.abs(F.col("sketch_ns") - F.col("exact_ns")) / F.col("exact_ns") <= 0.011
    return q.join(exact, "target_id").select("target_id", "rtt_count", close.alias("close"))
