"""Queries of dimensions and settings."""

from pyspark.sql import functions as F

from probelake.functions.scalars import normalise_address
from probelake.operators import dims as D
from probelake.queries.base import query, view
from probelake.sources import adapters as A

view("settings", "targets", """
    select target_id, coalesce(ping_interval_ns, legacy_interval_ns, 1000000000) as interval_ns, coalesce(ping_timeout_ns, 1000000000) as timeout_ns, 200000000::bigint as fast_interval_ns,
           case coalesce(latency_threshold, '50%') when '50%' then 50.0::double end as relative_pct,
           case coalesce(latency_threshold, '50%') when '100ms' then 100000000 when '0.2s' then 200000000 end::bigint as absolute_ns,
           coalesce(latency_threshold, '50%') = '-5%' as invalid from targets""")
view("endpoint_sightings", "probes", "select target_id, endpoint, min(sent_at_us) as first_seen_us, max(sent_at_us) as last_seen_us from probes group by all")


@query("endpoint_sightings", "select * from endpoint_sightings")
def endpoint_dim(spark, sf_dir):
    return D.endpoint_dim(A.probes_sent(spark, sf_dir))


@query("endpoint_sightings", "select target_id, arg_max(endpoint, (last_seen_us, endpoint)) as endpoint from endpoint_sightings group by target_id")
def last_endpoint(spark, sf_dir):
    return D.last_endpoint(D.endpoint_dim(A.probes_sent(spark, sf_dir)))


@query("probes", "select * from (select target_id, sent_at_us as at_us, lag(endpoint) over (partition by target_id order by sent_at_us, sequence) as old, endpoint as new from probes) where old <> new")
def endpoint_changes(spark, sf_dir):
    return D.endpoint_changes(A.probes_sent(spark, sf_dir))


@query("targets", """
    select target_id, action, action <> 'removed' as active,
           case when action = 'changed' then '{"old":{"name":"' || o.name || '","family":"' || family || '"},"new":{"name":"' || n.name || '","family":"' || family || '"}}' end as detail
    from (select coalesce(o.target_id, n.target_id) as target_id, o, n, coalesce(o.family, n.family) as family,
                 case when o.target_id is null then 'added' when n.target_id is null then 'removed' when o.name = n.name then 'same' else 'changed' end as action
          from (select * from targets where target_id < 20) o
          full join (select * replace (case when target_id % 7 = 0 then name || '-2' else name end as name) from targets where target_id >= 5) n on o.target_id = n.target_id)""")
def target_sync(spark, sf_dir):
    base = A.targets(spark, sf_dir)
    new = base.where("target_id >= 5").withColumn("name", F.when(F.col("target_id") % 7 == 0, F.concat("name", F.lit("-2"))).otherwise(F.col("name")))
    return D.sync(base.where("target_id < 20"), new, "target_id", ["name", "family"])


@query("settings", "select * from settings")
def effective_settings(spark, sf_dir):
    return D.effective_settings(A.targets(spark, sf_dir))


@query("settings", "select sum(1e9::double / least(interval_ns, fast_interval_ns)) as rate_per_s, sum(86400e9::double / interval_ns) as rows_per_day, sum(1e9::double / least(interval_ns, fast_interval_ns)) > 100 as over_budget from settings")
def rate_budget(spark, sf_dir):
    return D.rate_budget(D.effective_settings(A.targets(spark, sf_dir)), 100)


@query("settings targets", """
    select target_id, unnest(list_filter([case when dup > 1 then 'duplicate_id' end, case when interval_ns < 200000000 then 'interval_below_minimum' end, case when fast_interval_ns >= interval_ns then 'fast_interval_not_faster' end,
           case when invalid then 'bad_latency_threshold' end, case when relative_pct is not null and 3 > 60000000000 // interval_ns then 'samples_do_not_fit' end], lambda x: x is not null)) as rule
    from (select s.*, count(*) over (partition by target_id % 23) as dup from settings s)""")
def config_violations(spark, sf_dir):
    rows = A.targets(spark, sf_dir).withColumn("stable_id", F.concat(F.lit("t"), F.col("target_id") % 23))
    return D.violations(rows)


@query("", "select n_nationkey::bigint as target_id, '10.0.0.' || n_nationkey as normal from nation")
def normalise_address_values(spark, sf_dir):
    raw = F.concat(F.lit("::FFFF:10.0.0."), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, F.lit("%eth0")).otherwise(F.lit("")))
    return A.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("target_id"), normalise_address(raw).alias("normal"))
