"""Queries of routes."""

from pyspark.sql import functions as F

from probelake.functions.scalars import trace_outcome
from probelake.operators import routes as R
from probelake.queries.base import query, view
from probelake.sources import adapters as A

FROM, TO, POINTS = 725_846_400_000_000, 852_076_800_000_000, 12  # 1993-01-01 to 1997-01-01

view("sets", "hops", "select trace_id, ttl, list_sort(list(distinct responder)) as responders from hops where responder is not null group by all")
view("routes", "sets hops", """
    select trace_id, '[' || coalesce(string_agg('{"ttl":' || ttl || ',"responders":["' || array_to_string(responders, '","') || '"]}', ',' order by ttl), '') || ']' as signature, max(ttl) as hops
    from (select distinct trace_id from hops) left join sets using (trace_id) group by trace_id""")
view("traces", "runs routes hops", """
    select r.*, signature, case when reached then n else 0 end as reached_hop, case when r.trace_id % 5 = 0 then 'paris-udp' else 'classic-udp' end as method,
           row_number() over (partition by target_id order by started_at_us, r.trace_id) as seq
    from runs r join routes using (trace_id) join (select trace_id, count(distinct ttl) as n from hops group by trace_id) using (trace_id)""")
# The fold as a recursion over each target's completed traces in order; meaningful difference by joined sets.
view("fit", "traces", "select *, row_number() over (partition by target_id order by started_at_us, trace_id) as k from traces where status = 'completed'")
view("apart", "sets fit", """
    select distinct a.signature as s1, b.signature as s2 from (select distinct signature, min(trace_id) over (partition by signature) as t from fit) a
    join (select distinct signature, min(trace_id) over (partition by signature) as t from fit) b on a.signature <> b.signature
    join sets x on x.trace_id = a.t join sets y on y.trace_id = b.t and y.ttl = x.ttl where len(list_intersect(x.responders, y.responders)) = 0""")
view("fold", "fit apart", """
    select * from (with recursive f as (
        select target_id, k, trace_id as cur, signature as cs, reached_hop as ch, null::bigint as cand, null::varchar as ds, null::int as dh, null::bigint as first_us,
               null::bigint as old, null::bigint as was, null::varchar as os, null::int as oh, null::bigint as seen, trace_id as at_trace, ended_at_us as at_us from fit where k = 1
        union all
        select target_id, k, case when act = 2 then trace_id else cur end, case when act = 2 then signature else cs end, case when act = 2 then reached_hop else ch end,
               case when act = 3 then trace_id end, case when act = 3 then signature end, case when act = 3 then reached_hop end, case when act = 3 then started_at_us end,
               case when act = 2 then cur end, case when act = 2 then cand end, case when act = 2 then cs end, case when act = 2 then ch end, case when act = 2 then first_us end, trace_id, ended_at_us
        from (select t.target_id, t.k, t.trace_id, t.signature, t.reached_hop, t.started_at_us, t.ended_at_us, f.cur, f.cs, f.ch, f.cand, f.ds, f.dh, f.first_us,
                     case when t.reached_hop = f.ch and (t.signature = f.cs or a.s1 is null) then 1 when f.ds = t.signature and f.dh = t.reached_hop then 2 else 3 end as act
              from f join fit t on t.target_id = f.target_id and t.k = f.k + 1 left join apart a on a.s1 = f.cs and a.s2 = t.signature)) select * from f)""")
view("changes", "fold", """
    select target_id, target_id as endpoint_id, old as old_trace_id, was as candidate_trace_id, at_trace as confirming_trace_id, os as old_signature, cs as new_signature,
           oh as old_reached_hop, ch as new_reached_hop, seen as first_seen_us, at_us as confirmed_at_us from fold where old is not null""")


def traces(spark, sf_dir):
    """Runs with their routes; runs without probes are left out.  The method alternates by run but the flow stays one context."""
    probes = A.hop_probes(spark, sf_dir)
    hops = probes.groupBy("trace_id").agg(F.countDistinct("ttl").cast("int").alias("n"))
    runs = A.trace_runs(spark, sf_dir).join(R.signatures(probes), "trace_id").join(hops, "trace_id")
    return runs.select("*", F.when(F.col("reached"), F.col("n")).otherwise(0).alias("reached_hop"), F.lit("paris-udp").alias("method"), F.lit("0").alias("flow_id")).drop("n")


def with_method(spark, sf_dir):
    return A.trace_runs(spark, sf_dir).withColumn("method", F.when(F.col("trace_id") % 5 == 0, "paris-udp").otherwise("classic-udp"))


def changes(spark, sf_dir):
    return R.route_changes(traces(spark, sf_dir))


CHANGE = ["target_id", "endpoint_id", "old_trace_id", "candidate_trace_id", "confirming_trace_id", "old_reached_hop", "new_reached_hop", "first_seen_us", "confirmed_at_us"]


@query("sets", "select trace_id, ttl, array_to_string(responders, ',') as responders from sets")
def distinct_responders(spark, sf_dir):
    return R.responders(A.hop_probes(spark, sf_dir)).withColumn("responders", F.array_join("responders", ","))


@query("routes", "select trace_id, signature from routes")
def route_signature(spark, sf_dir):
    return R.signatures(A.hop_probes(spark, sf_dir)).select("trace_id", "signature")


@query("routes", "select trace_id, signature as again, coalesce(hops, 0) as last_ttl from routes")
def route_parse(spark, sf_dir):
    s = R.signatures(A.hop_probes(spark, sf_dir)).select("trace_id", R.parse(F.col("signature")).alias("r"))
    last = F.aggregate("r", F.lit(0), lambda a, x: F.greatest(a, x["ttl"]))
    return s.select("trace_id", F.to_json("r").alias("again"), last.alias("last_ttl"))


@query("hops", "select trace_id, coalesce(min(case when token % 3 = 0 and responder = 'F' then ttl end), 0) as reached_hop from hops group by trace_id")
def reached_hop(spark, sf_dir):
    return R.reached_hops(A.hop_probes(spark, sf_dir), F.lit("F"), F.col("token") % 3 == 0)


@query("runs", """
    select trace_id // 2 as round, case when bool_or(method = 'paris-udp' and reached) then 'paris-udp' when bool_or(method = 'classic-udp') then 'classic-udp' else 'paris-udp' end as method
    from (select *, case when trace_id % 2 = 0 then 'paris-udp' else 'classic-udp' end as method from runs) group by round""")
def prefer_method(spark, sf_dir):
    runs = A.trace_runs(spark, sf_dir)
    tries = runs.select(F.floor(F.col("trace_id") / 2).alias("round"), "trace_id", F.when(F.col("trace_id") % 2 == 0, "paris-udp").otherwise("classic-udp").alias("method"), F.col("reached").alias("answered"))
    return R.prefer_method(tries).select("round", "method")


@query("fit apart", """
    select t.trace_id, coalesce(a.s1 is not null, false) as differs from (select *, lag(signature) over (partition by target_id order by k) as prev from fit) t
    left join apart a on a.s1 = t.prev and a.s2 = t.signature where prev is not null""")
def route_differs(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("target_id").orderBy("started_at_us", "trace_id")
    steps = traces(spark, sf_dir).where("status = 'completed'").withColumn("prev", F.lag("route").over(w)).where("prev is not null")
    return steps.select("trace_id", R.differs(F.col("prev"), F.col("route")).alias("differs"))


@query("changes", f"select {', '.join(CHANGE)} from changes")
def route_changes(spark, sf_dir):
    return changes(spark, sf_dir).select(*CHANGE)


@query("fold", "select target_id, cur as current_trace_id, cs as signature, ch as reached_hop, cand as candidate_trace_id from fold qualify k = max(k) over (partition by target_id)")
def current_route(spark, sf_dir):
    out = R.current_routes(traces(spark, sf_dir))
    return out.select("target_id", "current_trace_id", F.to_json("route").alias("signature"), "reached_hop", "candidate_trace_id")


DIFF = """
    select confirming_trace_id, ttl, array_to_string(coalesce(o.responders, []), ',') as old, array_to_string(coalesce(n.responders, []), ',') as new,
           coalesce(o.responders, []) <> coalesce(n.responders, []) as different,
           o.responders is not null and n.responders is not null and len(list_intersect(o.responders, n.responders)) = 0 as evidence
    from (select c.confirming_trace_id, s.ttl, s.responders from changes c join sets s on s.trace_id = c.old_trace_id) o
    full join (select c.confirming_trace_id, s.ttl, s.responders from changes c join sets s on s.trace_id = c.confirming_trace_id) n using (confirming_trace_id, ttl)"""
view("diffs", "changes sets", DIFF)


@query("diffs", "select * from diffs")
def hop_diff(spark, sf_dir):
    return R.hop_diff(changes(spark, sf_dir)).withColumn("old", F.array_join("old", ",")).withColumn("new", F.array_join("new", ","))


@query("diffs changes", """
    select confirming_trace_id, coalesce(nullif(concat_ws(' · ', case when n = 1 then 'Hop ' || hops || ' changed' when n > 1 then 'Hops ' || hops || ' changed' end,
           case when old_reached_hop <> new_reached_hop then 'Destination observation changed' end), ''), 'Confirmed route change') as label
    from changes left join (select confirming_trace_id, string_agg(ttl::varchar, ', ' order by ttl) as hops, count(*) as n from diffs where evidence group by all) using (confirming_trace_id)""")
def change_label(spark, sf_dir):
    return R.change_labels(changes(spark, sf_dir))


W = -(-(TO - FROM) // POINTS)


@query("traces changes", f"""
    select s.target_id, s.i, {FROM} + s.i * {W} as from_us, least({FROM} + s.i * {W} + {W}, {TO}) as to_us, coalesce(t.traces, 0) as traces, coalesce(t.reached, 0) as reached,
           coalesce(t.unreached, 0) as unreached, coalesce(t.errors, 0) as errors, coalesce(c.changes, 0) as changes
    from (select target_id, unnest(range({POINTS})) as i from (select distinct target_id from traces)) s
    left join (select target_id, (started_at_us - {FROM}) // {W} as i, count(*) as traces, count(*) filter (status = 'completed' and reached) as reached,
                      count(*) filter (status = 'completed' and not reached) as unreached, count(*) filter (status <> 'completed') as errors
               from traces where started_at_us >= {FROM} and started_at_us < {TO} group by all) t using (target_id, i)
    left join (select target_id, (confirmed_at_us - {FROM}) // {W} as i, count(*) as changes from changes where confirmed_at_us >= {FROM} and confirmed_at_us < {TO} group by all) c using (target_id, i)""")
def route_history_buckets(spark, sf_dir):
    rows = traces(spark, sf_dir)
    return R.history_buckets(rows, R.route_changes(rows), FROM, TO, POINTS)


@query("runs", "select trace_id, case when status <> 'completed' then status when reached then 'reached' else 'unreached' end as outcome from runs")
def trace_outcome_of(spark, sf_dir):
    return A.trace_runs(spark, sf_dir).select("trace_id", trace_outcome().alias("outcome"))


@query("runs", """
    select target_id, trace_id, place, total > 50 as truncated from (
        select *, row_number() over (partition by target_id order by started_at_us desc, trace_id desc) as place, count(*) over (partition by target_id) as total from runs) where place <= 50""")
def trace_list(spark, sf_dir):
    return R.newest(A.trace_runs(spark, sf_dir), [F.desc("started_at_us"), F.desc("trace_id")], 50).select("target_id", "trace_id", "place", "truncated")


@query("runs hops", """
    select trace_id, n, text from runs left join (select trace_id, count(*) as n, string_agg(ttl || '/' || probe_index || '/' || responder, ' ' order by ttl, probe_index, token, responder) as text from hops group by trace_id) using (trace_id)""")
def trace_detail(spark, sf_dir):
    out = R.trace_detail(A.trace_runs(spark, sf_dir), A.hop_probes(spark, sf_dir))
    shown = F.array_join(F.transform("probes", lambda p: F.concat_ws("/", p["ttl"].cast("string"), p["probe_index"].cast("string"), p["responder"])), " ")
    return out.select("trace_id", F.when(F.col("probes").isNotNull(), F.size("probes")).alias("n"), shown.alias("text"))


@query("runs targets", "select trace_id, name, address, status from runs join targets using (target_id)")
def trace_summary(spark, sf_dir):
    """Runs with their target; the dimension is broadcast by its size."""
    return A.trace_runs(spark, sf_dir).join(A.targets(spark, sf_dir), "target_id").select("trace_id", "name", "address", "status")


@query("changes targets traces", """
    select c.confirming_trace_id, t.name, coalesce(a.method, b.method, o.method) as method from changes c join targets t using (target_id)
    left join traces a on a.trace_id = c.confirming_trace_id left join traces b on b.trace_id = c.candidate_trace_id left join traces o on o.trace_id = c.old_trace_id""")
def route_change_detail(spark, sf_dir):
    return R.change_detail(changes(spark, sf_dir), A.targets(spark, sf_dir), with_method(spark, sf_dir)).select("confirming_trace_id", "name", "method")


@query("changes", "select target_id, confirming_trace_id, place, total > 3 as truncated from (select *, row_number() over (partition by target_id order by confirmed_at_us desc, confirming_trace_id desc) as place, count(*) over (partition by target_id) as total from changes) where place <= 3")
def route_change_list(spark, sf_dir):
    return R.newest(changes(spark, sf_dir), [F.desc("confirmed_at_us"), F.desc("confirming_trace_id")], 3).select("target_id", "confirming_trace_id", "place", "truncated")
