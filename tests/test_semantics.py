"""Literal cases: hand-computed ranks, scales, tails, gaps, counters, routes and incidents."""

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from probelake.functions import sketch
from probelake.functions.scalars import nice_ceil, point_width
from probelake.operators import counters as C
from probelake.operators import dims, gaps, overview, probes, series
from probelake.operators import incidents as O
from probelake.operators import ingest as I
from probelake.operators import routes as R
from probelake.plans import retention, stored, tiers

S = 1_000_000
MS = 1_000_000  # nanoseconds


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def probe(spark, items):
    """(target, seq, second, rtt ms or None, late, error, timeout ms)"""
    data = [(t, q, int(s * S), int(s * S), int(to * MS), "send_error" if err else None, None if rtt is None else int(rtt * MS), None if rtt is None else ("late" if late else "on_time"), None if rtt is None else int(s * S + rtt * 1000), 1) for t, q, s, rtt, late, err, to in items]
    return spark.createDataFrame(data, "target_id long, sequence long, scheduled_at_us long, sent_at_us long, timeout_ns long, local_outcome string, rtt_ns long, reply_class string, reply_at_us long, endpoint long")


def no_gaps(spark):
    return spark.createDataFrame([], "target_id long, first_us long, interval_ns long, missed_count long")


def test_nearest_ranks(spark):
    bins = spark.createDataFrame([(1, 0, 2), (1, 100, 3), (1, 200, 5)], "k long, bin int, n long")
    asked = {"a": 1.0, "b": 0.21, "c": 0.2, "d": 0.5001, "e": 0.0, "f": 0.5, "g": -5.0, "h": 3.0}
    assert rows(sketch.quantiles(bins, ["k"], asked))[0][1:] == (53, 7, 1, 53, 1, 7, 1, 53)


def test_sketch_error_of_merged_halves(spark):
    v = spark.range(1, 1001).select((F.col("id") * 1_000_000).alias("v"), (F.col("id") % 2).alias("half"), F.lit(1).alias("k"))
    merged = sketch.merge(sketch.build(v, ["k", "half"], "v"), ["k"])
    assert abs(rows(sketch.quantiles(merged, ["k"], {"q": 0.5}))[0][1] / 5e8 - 1) <= 0.011
    assert merged.agg(F.sum("n")).first()[0] == 1000


def test_nice_ceil(spark):
    x = [168, 2.6, 0.26, 11, 0.9, 1000, 1001, 8.1, 0.011, 0.0026, 0.7, 0.00055, 0.13, 0.081]
    want = [200, 3, 0.3, 12, 1, 1000, 1200, 10, 0.012, 0.003, 0.8, 0.0006, 0.15, 0.1]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").select("i", nice_ceil(F.col("x")))
    assert [r[1] for r in rows(df, "i")] == want


def test_point_width(spark):
    h = 3600 * S
    asked = [(0, h, 61, 60 * S), (1, 6 * h, 73, 300 * S), (2, 24 * h, 97, 900 * S), (3, 168 * h, 169, h), (4, 720 * h, 181, 4 * h), (5, h, 1, h), (6, 10, 5, 100_000)]
    df = spark.createDataFrame(asked, "i int, span long, n long, want long").select("i", point_width(F.col("span"), F.col("n")).alias("w"), "want")
    assert all(w == want for _, w, want in rows(df, "i"))


def test_tier_choice(spark):
    want = [60, 60, 60, 3600, 3600]
    spans = [60 * S, 300 * S, 900 * S, 3600 * S, 14_400 * S]
    df = spark.createDataFrame([(i, s, 1, 100, 0, 0, 0) for i, s in enumerate(spans)], "i int, span_us long, max_points long, start_us long, raw_us long, minute_us long, hour_us long")
    assert [r[0] for r in tiers.choose_tier(df).orderBy("i").select("resolution_s").collect()] == want


def test_loss_denominators(spark):
    g = spark.createDataFrame([(1, 2 * S, 100 * MS, 98)], "target_id long, first_us long, interval_ns long, missed_count long")
    p = probe(spark, [(1, 1, 0, None, False, False, 100), (1, 2, 1, None, False, True, 100)])
    agg = probes.raw_agg(p, g, 3600 * S, 10**12)
    r = probes.points(agg, probes.bins(p, 3600 * S)).first()
    assert (r.scheduled, r.attempted, r.sent, r.unanswered, r.send_errors, r.missed) == (100, 2, 1, 1, 1, 98)
    assert (r.deadline_miss_pct, r.no_reply_pct, r.avg_ms) == (100.0, 100.0, None)


def test_pending_is_no_loss(spark):
    p = probe(spark, [(1, 1, 0, None, False, False, 1000)])
    for as_of, kind in ((999_999, "pending"), (1_000_000, "unanswered")):
        assert probes.classified(p, as_of).first().outcome == kind


def tail_of(spark, rtts, seam=None):
    items = [(1, i, i, v, late, False, to) for i, (v, late, to) in enumerate(rtts)]
    p = probe(spark, items)
    agg, hist = probes.raw_agg(p, no_gaps(spark), 3600 * S, 10**12), probes.bins(p, 3600 * S)
    window = series.window_stats(hist, agg)
    if seam is not None:
        window = window.withColumn("seam_ms", F.lit(float(seam)))
    return series.tail(hist, agg, window).orderBy("place").collect()


def test_lone_outlier(spark):
    t = tail_of(spark, [(8, False, 5000)] * 59 + [(4115, False, 5000)])
    assert [r.n for r in t] == [1] and abs(t[0].value_ms / 4115 - 1) < 0.02


def test_late_flags(spark):
    one = tail_of(spark, [(8, False, 1000)] * 58 + [(995, False, 1000), (4115, True, 1000)])
    assert [r.late for r in one] == [True, False]
    shared = tail_of(spark, [(8, False, 1000)] * 58 + [(999, False, 1000), (1005, True, 1000)])
    assert [(r.n, r.late) for r in shared] == [(2, False)]
    mixed = tail_of(spark, [(8, False, 1000)] * 57 + [(1500, True, 1000), (1995, False, 2000), (2500, True, 2000)])
    assert [r.late for r in mixed] == [True, False, False]


def test_tail_cap(spark):
    t = tail_of(spark, [(1, False, 5000)] * 10 + [(100 * i, False, 5000) for i in range(1, 31)], seam=50)
    assert len(t) == 24 and t[0].truncated and [r.value_ms for r in t] == sorted((r.value_ms for r in t), reverse=True)


def test_distribution(spark):
    p = probe(spark, [(1, i, i, v, False, False, 1000) for i, v in enumerate([10, 30, 30, 30])])
    agg, hist = probes.raw_agg(p, no_gaps(spark), 3600 * S, 10**12), probes.bins(p, 3600 * S)
    grains = [r.value_ms for r in series.distribution(hist, agg).orderBy("i").collect()]
    assert len(grains) == 4 and grains == sorted(grains) and 10 <= grains[0] and grains[-1] <= 30
    assert probes.points(agg, hist).first().avg_ms == 25
    many = probe(spark, [(1, i, i, 5 + i, False, False, 1000) for i in range(40)])
    assert series.distribution(probes.bins(many, 3600 * S), probes.raw_agg(many, no_gaps(spark), 3600 * S, 10**12)).count() == 17


def test_worst_and_missed(spark):
    p = probe(spark, [(1, i, i * 5, None if i in (3, 40) else 4115 if i == 17 else 8, i == 17, False, 1000) for i in range(60)])
    worst = series.worst_samples(p, 3600 * S).orderBy("place").collect()
    assert len(worst) == 5 and worst[0].rtt_ns == 4115 * MS and worst[0].late
    assert [r.scheduled_at_us // S for r in series.missed_samples(p, 3600 * S, 10**12).orderBy("place").collect()] == [15, 200]


def test_gap_over_the_edges(spark):
    g = spark.createDataFrame([(1, 70 * S, 1000 * MS, 345)], "target_id long, first_us long, interval_ns long, missed_count long")
    assert gaps.gap_counts(g, 60 * S, 100 * S, 400 * S).agg(F.sum("missed")).first()[0] == 300
    assert gaps.gap_counts(g, 60 * S).agg(F.sum("missed")).first()[0] == 345


def test_gap_rounds_like_slots(spark):
    g = spark.createDataFrame([(1, 10 * S, 7000 * MS, 50)], "target_id long, first_us long, interval_ns long, missed_count long")
    slots = [10 + 7 * i for i in range(50)]
    for a in range(0, 60, 7):
        got = g.select(gaps.slots_within(F.lit(a * S), F.lit((a + 9) * S))).first()[0]
        assert got == sum(a <= s < a + 9 for s in slots)


def test_rollup_with_gap(spark):
    g = spark.createDataFrame([(1, 5 * S, 5000 * MS, 2)], "target_id long, first_us long, interval_ns long, missed_count long")
    r = tiers.minute_rollup(probe(spark, [(1, 1, 1, None, False, False, 100)]), g).first()
    assert (r.scheduled, r.unanswered, r.missed, r.rtt_min_ns) == (3, 1, 2, None)


def test_overlay_keeps_clean_sibling(spark):
    p = probe(spark, [(1, i, 10 + i, 5, False, False, 100) for i in range(5)] + [(1, 20, 70, 5, False, False, 100)])
    rolled = tiers.minute_rollup(p.where("sequence < 5"), no_gaps(spark))
    dirty = tiers.dirty_buckets(p.where("sequence = 20"))
    assert [r.scheduled for r in tiers.overlay(rolled, dirty, p, no_gaps(spark), 120 * S).collect()] == [6]


def test_overview_window(spark):
    to = 900
    items = [(1, 0, -1, 5, False, False, 1000), (1, 1, 0, 5, False, False, 1000), (1, 2, 10, 5, False, False, 1000), (1, 3, 20, 5, False, False, 1000), (1, 4, 30, 1500, True, False, 1000), (1, 5, 40, None, False, False, 1000), (1, 6, 50, None, False, True, 1000), (1, 7, 899.5, None, False, False, 1000), (1, 8, 900, 5, False, False, 1000)]
    p = probe(spark, [(t, q, s + 10_000, *rest) for t, q, s, *rest in items])
    g = spark.createDataFrame([(1, (10_000 - 3) * S, 2000 * MS, 4)], "target_id long, first_us long, interval_ns long, missed_count long")
    targets = spark.createDataFrame([(1,), (2,)], "target_id long")
    r, idle = overview.recent(targets, p, g, 10_000 * S, (10_000 + to) * S, (10_000 + to) * S).orderBy("target_id").collect()
    assert (r.scheduled, r.attempted, r.sent, r.settled, r.pending, r.on_time, r.late, r.unanswered, r.send_errors, r.missed, r.rtt_count) == (9, 7, 6, 5, 1, 3, 1, 1, 1, 2, 4)
    assert round(r.deadline_miss_pct, 1) == 33.3 and round(r.no_reply_pct, 1) == 16.7
    assert idle.scheduled == 0 and idle.deadline_miss_pct is None and idle.p95_ms is None


def samples(spark, items):
    return spark.createDataFrame([(1, i, int(s * S), 0, v, v, v, 0, 0) for i, (s, v) in enumerate(items)], "name long, event_id long, sampled_at_us long, mac long, rx_bytes long, tx_bytes long, rx_packets long, rx_errors long, rx_dropped long")


NAMES = ["rx_bytes", "tx_bytes", "rx_packets", "rx_errors", "rx_dropped"]


def test_interface_right_edge(spark):
    g = C.with_generation(samples(spark, [(50, 0), (60, 10), (70, 20), (120, 30)]), NAMES)
    r = {x.bucket_us // S: x.rx_bytes_delta for x in C.rollup(g, NAMES, 60 * S).collect()}
    assert r == {0: None, 60: 20, 120: 10}


def test_interface_rates_and_resets(spark):
    g = C.with_generation(samples(spark, [(0, 0), (5, 5_000_000), (10, 4_000_000), (15, 4_000_000)]), NAMES)
    d = C.rates(C.deltas(g, NAMES)).orderBy("sampled_at_us").collect()
    assert [(r.rx_mbps, r.rx_bytes_per_s) for r in d] == [(8.0, 1_000_000), (0.0, 0)]
    assert [r.reset_reason for r in g.orderBy("event_id").collect()] == [None, None, "counter_decreased", None]


def test_thin(spark):
    got = [r.sampled_at_us // S for r in C.thin(samples(spark, [(0, 0), (3, 0), (5, 0), (9, 0), (10, 0)]), 5 * S).orderBy("sampled_at_us").collect()]
    assert got == [0, 5, 10]


def test_reply_before_sent_and_duplicates(spark):
    sent = spark.createDataFrame([(1, 7, 0, 10**9, None, 1), (2, 7, 5, 10**9, None, 1), (3, 7, 9, 10**9, "send_error", 1)], "sequence long, target_id long, sent_at_us long, timeout_ns long, local_outcome string, endpoint long")
    got = spark.createDataFrame([(1, 0, 3, 3000, 1), (1, 0, 4, 4000, 1), (1, 0, 2, 2000, 9), (8, 0, 2, 2000, 1)], "sequence long, sent_at_us long, reply_at_us long, rtt_ns long, responder long")
    r = I.reconcile(sent, got).orderBy("sequence").collect()
    assert [(x.rtt_ns, x.reply_class, x.duplicate_count) for x in r] == [(3000, "on_time", 1), (None, None, 0), (None, None, 0)]
    assert I.mismatches(sent, got).count() == 1 and I.orphans(sent, got, 0).count() == 1


def test_thresholds(spark):
    df = spark.createDataFrame([("50%",), ("100ms",), ("0.2s",), ("-5%",), ("0%",), ("x",), ("2h",)], "raw string")
    rel, absolute = dims.threshold(F.col("raw"))
    got = {r.raw: (r.a, r.b) for r in df.select("raw", rel.alias("a"), absolute.alias("b")).collect()}
    assert got == {"50%": (50.0, None), "100ms": (None, 10**8), "0.2s": (None, 2 * 10**8), "-5%": (None, None), "0%": (None, None), "x": (None, None), "2h": (None, 7200 * 10**9)}


def test_retention_rules():
    assert dims.retention_order(7 * 86_400, 90 * 86_400, 5 * 365 * 86_400) == []
    assert dims.retention_order(3600, 86_400, 3600) == ["raw_below_a_day", "minute_below_30_days", "hour_under_minute"]
    assert retention.cutoffs(10**12, S, S, S, S)["raw"] % (60 * S) == 0


HOPS = "trace_id long, ttl int, responder string"


def test_signature_order(spark):
    a = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (1, 3, None)], HOPS)
    b = spark.createDataFrame([(2, 2, "c"), (2, 2, "b"), (2, 1, "a"), (2, 2, "b")], HOPS)
    sig = [r.signature for r in R.signatures(a.union(b)).orderBy("trace_id").collect()]
    assert sig[0] == sig[1] == '[{"ttl":1,"responders":["a"]},{"ttl":2,"responders":["b","c"]}]'
    silent = spark.createDataFrame([(3, 1, None)], HOPS)
    assert R.signatures(silent).first().signature == "[]"


def trace(spark, items):
    """(id, second, responder at ttl 1, reached hop, status)"""
    data = [(i, 1, 1, "p", "0", int(s * S), int(s * S) + 1, st, hop > 0, [(1, [who])] if who else [], hop) for i, s, who, hop, st in items]
    return spark.createDataFrame(data, "trace_id long, target_id long, endpoint_id long, method string, flow_id string, started_at_us long, ended_at_us long, status string, reached boolean, route array<struct<ttl:int,responders:array<string>>>, reached_hop int")


def test_reached_hop_is_part_of_a_route(spark):
    hops = trace(spark, [(i, i, "a", h, "completed") for i, h in enumerate([3, 4, 5])])
    assert R.route_changes(hops).count() == 0
    more = trace(spark, [(i, i, "a", h, "completed") for i, h in enumerate([3, 4, 5, 4, 4])])
    c = R.route_changes(more).collect()
    assert [(r.old_reached_hop, r.new_reached_hop, r.candidate_trace_id, r.confirming_trace_id) for r in c] == [(3, 4, 3, 4)]


def test_errors_do_not_reset_a_candidate(spark):
    t = trace(spark, [(0, 1, "a", 1, "completed"), (1, 1.5, "b", 0, "completed"), (2, 2, None, 0, "timed_out"), (3, 2.5, None, 0, "error"), (4, 3, "b", 0, "completed")])
    c = R.route_changes(t).collect()
    assert [(r.candidate_trace_id, r.confirming_trace_id, r.first_seen_us, r.confirmed_at_us) for r in c] == [(1, 4, 1_500_000, 3_000_001)]
    assert R.current_routes(t).first().current_trace_id == 4


def test_overlapping_routes_are_alike(spark):
    t = trace(spark, [(0, 1, "a", 1, "completed"), (1, 2, "b", 1, "completed"), (2, 3, "a", 1, "completed"), (3, 4, "b", 1, "completed")])
    assert R.route_changes(t).count() == 0


MIN = 60 * S
POLICY = O.Policy(relative_pct=50.0, baseline_window_us=MIN, min_samples=3, fast_interval_us=S // 10, recover_after_us=MIN)


def walk(spark, items, policy=POLICY):
    p = probe(spark, [(1, i, s, rtt, late, False, 1000) for i, (s, rtt, late) in enumerate(items)])
    return O.transitions(O.fold(p, policy)).orderBy("at_us").collect()


def test_frozen_baseline(spark):
    calm = [(i, 10, False) for i in range(5)]
    slow = [(5 + i / 10, 20, False) for i in range(700)]
    well = [(75 + i / 10, 10, False) for i in range(602)]
    moves = walk(spark, calm + slow + well)
    assert [m.kind for m in moves] == ["started", "recovered"]
    assert moves[0].reason == "latency" and moves[0].limit_ns == 15 * MS
    assert moves[1].at_us == 135 * S + 10_000


def test_limit_itself_is_healthy(spark):
    assert walk(spark, [(i, 10, False) for i in range(5)] + [(6, 15, False)]) == []
    assert len(walk(spark, [(i, 10, False) for i in range(5)] + [(6, 15.001, False)])) == 1


def test_slow_replies_stay_out_of_the_baseline(spark):
    """A first incident of latency faults does not raise the limit of a second one, and ends what was held before it."""
    policy = O.Policy(relative_pct=50.0, baseline_window_us=60 * MIN, min_samples=3, fast_interval_us=S, recover_after_us=10 * S)
    calm = [(i, 10, False) for i in range(5)]
    slow = [(5 + i, 90, False) for i in range(5)]
    well = [(10 + i, 12, False) for i in range(20)]
    moves = walk(spark, calm + slow + well + [(31, 19, False)], policy)
    assert [(m.kind, m.limit_ns) for m in moves] == [("started", 15 * MS), ("recovered", 15 * MS), ("started", 18 * MS)]
    assert moves[2].baseline_count == 20
    p = probe(spark, [(1, i, s, rtt, late, False, 1000) for i, (s, rtt, late) in enumerate(calm + slow + well)])
    held = {r.sequence: (r.baseline_count, r.held, r.fault) for r in O.baselines(p, policy).collect()}
    assert held[4] == (4, 4, "good") and held[5] == (5, 5, "latency") and held[6] == (5, 0, "latency") and held[10] == (5, 0, "good") and held[21] == (11, 11, "good")


def test_good_replies_wait_for_earlier_probes(spark):
    """A reply behind an open probe counts when that one is lost, and is then from before the incident."""
    policy = O.Policy(relative_pct=None, absolute_ns=500 * MS, fast_interval_us=S, recover_after_us=2 * S)
    items = [(0, None, False), (0.1, 10, False), (1.5, 10, False), (3.4, 10, False), (3.5, 10, False)]
    moves = walk(spark, items, policy)
    assert [(m.kind, m.at_us) for m in moves] == [("started", S), ("recovered", 3_510_000)]
    assert [m.kind for m in walk(spark, items[:2] + items[2:4], policy)] == ["started"]


def test_incidents_do_not_depend_on_partitions(spark):
    rng = random.Random(8)
    data = [(t, i * 10 + t, i * 0.3, rng.choice([5, 8, 30, 200, None]), False, rng.random() < 0.1, 700) for t in range(6) for i in range(120)]
    want = None
    for n in (1, 7):
        got = sorted(map(str, O.fold(probe(spark, data).repartition(n), O.Policy(baseline_window_us=10 * S, fast_interval_us=S, recover_after_us=S), each=True).collect()))
        assert want in (None, got)
        want = got
    assert len(want) > 720


def test_thinning_goes_on_over_midnight(spark):
    hours = spark.createDataFrame([(n, h * 3600 * S) for n in (1, 2) for h in (0, 23, 46, 69, 76)] + [(3, 5), (3, 5)], "name long, sampled_at_us long")
    assert sorted((r.name, r.sampled_at_us // (3600 * S)) for r in C.thin(hours, 30 * 3600 * S).collect()) == [(n, h) for n in (1, 2) for h in (0, 46, 76)] + [(3, 0)]
    assert C.thin(hours.limit(0), S).count() == 0


def test_upkeep_over_batches_loses_nothing(spark, tmp_path):
    """Three batches with late rows and gaps over midnight: rollups equal those of all rows at once, and untouched days stay."""
    from probelake.streaming.streams import RollupUpkeep

    day = 86_400
    data = [(t, d * 100 + t * 10 + i, d * day + 40 * i + 7 * t, 5 + i, False, False, 1000) for t in (1, 2) for d in range(4) for i in range(10)]
    every = probe(spark, data)
    runs = spark.createDataFrame([(1, (day - 90) * S, 30_000_000_000, 10), (2, 3 * day * S + S, 1_000_000_000, 90)], "target_id long, first_us long, interval_ns long, missed_count long")
    up = RollupUpkeep(*(str(tmp_path / x) for x in ("raw", "gaps", "rollups")))
    late = F.col("sequence") % 4 == 0
    batches = [every.where(~late & (F.col("scheduled_at_us") < 2 * day * S)), every.where(~late & (F.col("scheduled_at_us") >= 2 * day * S)), every.where(late)]
    up.probes(batches[0], 0)
    up.gaps(runs, 0)
    for i in (1, 2, 2):  # the last batch comes twice, as after a failure
        up.probes(batches[i], i)
    minutes = tiers.minute_rollup(every, runs)
    cols = ["target_id", "bucket_us", "scheduled", "sent", "missed", "rtt_sum_ns"]
    for got, want in ((60, minutes), (3600, tiers.widen(minutes, tiers.HOUR))):
        assert sorted(map(tuple, tiers.read_rollup(spark, up.rollup_path, got).select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def kept_rows(spark, up, resolution):
    """Stored rows without the folders they lie in, sketches as pairs."""
    cols = ["target_id", "bucket_us", "scheduled", "sent", "missed", "rtt_sum_ns", "hist"]
    found = tiers.read_rollup(spark, up.rollup_path, resolution).select(*cols).collect()
    return sorted((*r[:6], tuple(map(tuple, r.hist))) for r in found)


def wanted_rows(every, runs, width):
    cols = ["target_id", "bucket_us", "scheduled", "sent", "missed", "rtt_sum_ns", "hist"]
    found = stored.minutes(every, runs)
    found = (found if width == tiers.MINUTE else stored.widen(found, width)).select(*cols).collect()
    return sorted((*r[:6], tuple(map(tuple, r.hist))) for r in found)


def test_upkeep_survives_a_new_checkpoint(spark, tmp_path):
    """Two streams that both begin at batch 0, a batch that runs again, compaction, and a crash between staging and swap."""
    from probelake.plans import swap
    from probelake.streaming.streams import RollupUpkeep

    data = [(t, t * 100 + i, 40 * i + 7 * t, 5 + i, False, False, 1000) for t in (1, 2) for i in range(40)]
    every = probe(spark, data)
    paths = [str(tmp_path / x) for x in ("raw", "gaps", "rollups")]
    up = RollupUpkeep(*paths, run="first")
    part = lambda i: every.where(F.col("sequence") % 4 == i)
    for i in (0, 1):
        up.probes(part(i), i)
    again = RollupUpkeep(*paths, run="second")
    again.probes(part(2), 0)
    assert kept_rows(spark, again, 60) == wanted_rows(every.where("sequence % 4 < 3"), no_gaps(spark), tiers.MINUTE)
    # A crash after staging: the next batch puts it in place.
    staged = swap.stage(spark.read.parquet(paths[2]), paths[2], ["resolution_s", "bucket_date"])
    assert swap.exists(spark, staged)
    half = swap.stage(spark.read.parquet(paths[2]).limit(1), paths[2], ["resolution_s", "bucket_date"])
    swap.delete(spark, f"{half}/rows/_SUCCESS")
    again.compact(spark)
    again.probes(part(3), 1)
    again.probes(part(3), 1)
    again.compact(spark)
    again.probes(part(3), 1)
    for width, res in ((tiers.MINUTE, 60), (tiers.HOUR, 3600)):
        assert kept_rows(spark, again, res) == wanted_rows(every, no_gaps(spark), width)
    batches = {(r.run, r.batch) for r in spark.read.parquet(paths[0]).select("run", "batch").distinct().collect()}
    assert batches == {("first", -1), ("first", 1), ("second", -1), ("second", 1)} and not swap.children(spark, f"{paths[2]}-staged")


def test_upkeep_by_streams_of_two_checkpoints(spark, tmp_path):
    """Files of a stream are read by one checkpoint, further ones by a new one: nothing is lost."""
    from probelake.streaming.streams import RollupUpkeep

    data = [(1, i, 10 * i, 5, False, False, 1000) for i in range(20)]
    every = probe(spark, data)
    up = RollupUpkeep(*(str(tmp_path / x) for x in ("raw", "gaps", "rollups")))
    for k in (0, 1):
        every.where(F.col("sequence") % 2 == k).write.parquet(str(tmp_path / f"in{k}"))
        stream = spark.readStream.schema(every.schema).parquet(str(tmp_path / f"in{k}"))
        stream.writeStream.foreachBatch(up.probes).option("checkpointLocation", str(tmp_path / f"progress{k}")).trigger(availableNow=True).start().awaitTermination()
    assert kept_rows(spark, up, 60) == wanted_rows(every, no_gaps(spark), tiers.MINUTE)
    assert spark.read.parquet(up.raw_path).count() == 20 and spark.read.parquet(up.raw_path).select("run").distinct().count() == 2


def run_table(spark, items):
    """(trace, target, started second, ended second)"""
    return spark.createDataFrame([(i, t, int(a * S), int(b * S)) for i, t, a, b in items], "trace_id long, target_id long, started_at_us long, ended_at_us long")


def route_refs(spark, changes=(), current=()):
    c = spark.createDataFrame(list(changes), "target_id long, old_trace_id long, candidate_trace_id long, confirming_trace_id long, confirmed_at_us long")
    return c, spark.createDataFrame(list(current), "target_id long, current_trace_id long, candidate_trace_id long")


def test_traces_go_by_their_end_and_current_routes_stay(spark):
    day = 86_400
    runs = run_table(spark, [(1, 1, 10, 90), (2, 1, 20, 110), (3, 1, 30, 40), (4, 1, 50, 60), (5, 2, 10, 20), (6, 1, day, day + 1), (7, 1, day + 5, day + 9)])
    changes, current = route_refs(spark, [(1, 3, None, None, 0)], [(1, 4, None)])
    cut = 100 * S
    assert rows(retention.unreferenced_traces(runs, changes, current, cut).select("trace_id"), "trace_id") == [(1,), (5,)]
    # Under pressure the first trace of a target and day stays, and so do current routes and traces of changes.
    late = 2 * day * S
    assert rows(retention.later_of_day(runs, changes, current, late).select("trace_id"), "trace_id") == [(2,), (7,)]


def test_raw_rows_that_were_sent_late_stay(spark):
    items = probe(spark, [(1, 1, 10, 5, False, False, 100), (1, 2, 20, 5, False, False, 100)]).withColumn("sent_at_us", F.when(F.col("sequence") == 2, 70 * S).otherwise(F.col("sent_at_us")))
    minutes = tiers.minute_rollup(items, no_gaps(spark))
    none = minutes.select("target_id", "bucket_us").limit(0)
    assert rows(retention.covered_raw(items, minutes, none, 60 * S).select("sequence")) == [(1,)]
    assert retention.pruned_through(60 * S, items.where("sequence = 2"), 5).first()[0] == 60 * S
    assert retention.pruned_through(60 * S, items, 5).first()[0] == 5


def test_long_timeouts_hold_raw_rows_back_under_pressure(spark):
    now, day = 10**15, 86_400 * S
    assert retention.pressure_cutoffs(now, 10**9)["raw"] == (now - day) // (60 * S) * 60 * S
    assert retention.pressure_cutoffs(now, 2 * 86_400 * 10**9)["raw"] == (now - 2 * day - 60 * S) // (60 * S) * 60 * S


def test_gaps_stay_with_dirty_minutes_inside(spark):
    day = 86_400
    runs = spark.createDataFrame([(1, 10 * S, 10**9, 2 * day), (1, 3 * day * S, 10**9, 10), (2, 10 * S, 10**9, 5)], "target_id long, first_us long, interval_ns long, missed_count long")
    spots = spark.createDataFrame([(1, day * S), (2, 60 * S)], "target_id long, bucket_us long")
    got = retention.covered_gaps(runs, spots, 4 * day * S).select("target_id", "first_us")
    assert rows(got, "target_id") == [(1, 3 * day * S), (2, 10 * S)]


def test_a_pass_is_done_wholly_or_not_at_all(spark, tmp_path, monkeypatch):
    """Killed before the marker, between two swaps and before the watermark: the next pass leaves what one pass leaves."""
    from probelake.plans import swap

    day = 86_400
    every = probe(spark, [(t, t * 1000 + d * 100 + i, d * day + 40 * i, 5, False, False, 100) for t in (1, 2) for d in range(4) for i in range(5)])
    minutes, changes_current = stored.minutes(every, no_gaps(spark)), route_refs(spark, [(1, None, None, 9, 5 * S)], [(1, 4, None)])
    empty = lambda schema: spark.createDataFrame([], schema)
    keys, iface = "target_id long, bucket_us long", "name long, generation long, bucket_us long"
    base = {
        "raw": every, "gap": no_gaps(spark).unionByName(spark.createDataFrame([(1, 5 * S, 10**9, 3)], no_gaps(spark).schema)), "minute": minutes, "hour": stored.widen(minutes, tiers.HOUR),
        "iface_raw": spark.createDataFrame([(1, 0, 5 * S, 1)], "name long, generation long, sampled_at_us long, event_id long"), "iface_minute": spark.createDataFrame([(1, 0, 0)], iface), "iface_hour": spark.createDataFrame([(1, 0, 0)], iface),
        "trace": run_table(spark, [(1, 1, 10, 20), (4, 1, 10, 20)]), "route_change": changes_current[0],
    }
    cut = {"raw": 3 * day * S, "minute": 2 * day * S, "hour": day * S, "trace": day * S, "change": day * S}
    some = ["raw", "minute", "trace"]  # those that are stored here

    def store(name):
        p = retention.Pruner(spark, str(tmp_path / name), some)
        for tier in some:
            p.write(tier, base[tier])
        return p

    def gone(mine):
        found = retention.expired(retention.Tables(**base | mine, dirty_minute=spark.createDataFrame([(1, 0)], keys), dirty_hour=empty(keys), iface_dirty_minute=empty(iface), iface_dirty_hour=empty(iface), current_route=changes_current[1]), cut)
        return {t: found[t] for t in some}

    def state(p):
        return {t: p.read(t).count() for t in some}, sorted(r[0] for r in p.read("raw").select("sequence").collect()), p.watermark()

    def died(*_, **__):
        raise OSError("killed")

    whole = store("whole")
    whole.run(gone, cut["raw"])
    want = state(whole)
    whole.run(gone, cut["raw"])
    assert state(whole) == want and want[0] == {"raw": 12, "minute": 12, "trace": 1} and want[2] == 0
    real = swap.swap
    for place in ("marker", "swaps", "watermark"):
        p = store(place)
        with monkeypatch.context() as m:
            if place == "marker":
                p.finish()
                m.setattr(spark, "range", died)
            elif place == "swaps":
                m.setattr(swap, "swap", lambda s, path, *a: died() if path.endswith("/minute") else real(s, path, *a))
            else:
                m.setattr(p, "watermark", died)
            with pytest.raises(OSError):
                p.run(gone, cut["raw"])
        p.run(gone, cut["raw"])
        assert state(p) == want, place


def test_a_pass_done_again_keeps_the_traces_of_changes_that_it_deleted(spark, tmp_path):
    """Traces 1 to 3 are named by an old change: it goes in a pass, they go in the next one of a later cutoff."""
    none, gaps, minutes = probe(spark, []), no_gaps(spark), stored.minutes(probe(spark, []), no_gaps(spark))
    keys, iface = spark.createDataFrame([], "target_id long, bucket_us long"), spark.createDataFrame([], "name long, generation long, bucket_us long")
    changes, current = route_refs(spark, [(1, 1, 2, 3, 35 * S)], [(1, 5, None)])
    base = retention.Tables(raw=none, gap=gaps, minute=minutes, hour=minutes, dirty_minute=keys, dirty_hour=keys, iface_raw=counter_samples(spark, []), iface_minute=iface, iface_hour=iface, iface_dirty_minute=iface, iface_dirty_hour=iface, trace=run_table(spark, [(i, 1, 10 * i, 10 * i + 5) for i in range(1, 6)]), route_change=changes, current_route=current)
    some = ["raw", "trace", "route_change"]
    pruner = retention.Pruner(spark, str(tmp_path / "tiers"), some)
    for tier in some:
        pruner.write(tier, getattr(base, tier))

    def gone(mine):
        found = retention.expired(dataclasses.replace(base, **mine), {"raw": 60 * S, "minute": 0, "hour": 0, "trace": 100 * S, "change": 100 * S})
        return {tier: found[tier] for tier in some}

    left = lambda: rows(pruner.read("trace").select("trace_id"), "trace_id")
    for _ in range(3):
        pruner.run(gone, 60 * S)
        assert left() == [(1,), (2,), (3,), (5,)] and pruner.read("route_change").count() == 0
    pruner.run(gone, 120 * S)
    assert left() == [(5,)]


def counter_samples(spark, items):
    """(name, generation, event, second, rx)"""
    data = [(n, g, e, int(t * S), rx, rx // 2, None) for n, g, e, t, rx in items]
    return spark.createDataFrame(data, "name long, generation long, event_id long, sampled_at_us long, rx_bytes long, tx_bytes long, reset_reason string")


def test_incidents_do_not_depend_on_the_cuts():
    """200 random series, cut at random and put to rest between: the transitions of the whole."""
    from types import SimpleNamespace

    policy = O.Policy(baseline_window_us=20 * S, relative_pct=50.0, min_samples=5, recover_after_us=2 * S, fast_interval_us=S)
    told = 0
    for seed in range(200):
        r = random.Random(seed)
        series = []
        for i in range(150):
            rtt = None if r.random() < 0.03 else int(r.choice([10, 11, 12, 13, 40]) * MS * (60 if r.random() < 0.02 else 1))
            klass = None if rtt is None else "late" if rtt > 1000 * MS else "on_time"
            sent = i * S // 10
            series.append(SimpleNamespace(sequence=i, sent_at_us=sent, reply_at_us=None if rtt is None else sent + rtt // 1000, timeout_ns=1000 * MS, local_outcome="send_error" if r.random() < 0.01 else None, reply_class=klass, rtt_ns=rtt, endpoint=1 + (i > 120)))
        whole = O.Machine(policy)
        for x in series:
            O.feed(whole, x)
        whole.finish()
        cuts = set(r.sample(range(1, 150), 5))
        part, got = O.Machine(policy), []
        for i, x in enumerate(series):
            if i in cuts:
                got += part.take()
                part = O.Machine.resume(policy, part.rest())
            O.feed(part, x)
        part.finish()
        want = whole.take()
        assert got + part.take() == want
        told += len(want)
    assert told > 400


def test_history_evicts_beyond_its_capacity(spark):
    """The baseline is the mean of the newest replies that there is room for; a plain list agrees."""
    r = random.Random(5)
    rtts = [r.choice([10, 12, 14, 20]) for _ in range(60)]
    items = probe(spark, [(1, i, i, rtts[i], False, False, 1000) for i in range(60)])
    policy = O.Policy(baseline_window_us=30 * S, relative_pct=10_000.0, min_samples=1, capacity=8)
    got = rows(O.baselines(items, policy).select("sequence", "baseline_ns", "baseline_count"), "sequence")
    held = []
    for i in range(60):
        held = [(t, x) for t, x in held if t >= i - 30]
        held = held[len(held) >= 8 :]
        mean = sum(x for _, x in held) * MS / len(held) if held else None
        assert (got[i][0], got[i][2]) == (i, len(held)) and (got[i][1] is None) == (mean is None) and abs((got[i][1] or 0) - (mean or 0)) < 1e-3
        held.append((i, rtts[i]))
    assert max(g[2] for g in got) == 7
    wide = rows(O.baselines(items, O.Policy(baseline_window_us=30 * S, relative_pct=10_000.0, min_samples=1)).select("baseline_count"))
    assert max(w[0] for w in wide) == 30


def test_eviction_interrupts_a_recovery():
    """Healthy probes after a loss recover; with room for three they never do for long, as each eviction starts the run anew."""
    from types import SimpleNamespace

    def kinds(capacity):
        m = O.Machine(O.Policy(baseline_window_us=100 * S, relative_pct=100.0, min_samples=2, recover_after_us=5 * S, fast_interval_us=S, capacity=capacity))
        for i in range(20):
            lost = i == 5
            O.feed(m, SimpleNamespace(sequence=i, sent_at_us=i * S, reply_at_us=None if lost else i * S + 10_000, timeout_ns=500 * MS, local_outcome=None, reply_class=None if lost else "on_time", rtt_ns=None if lost else 10 * MS, endpoint=1))
        m.finish()
        return [t[1] for t in m.take()], m.state.limited

    assert kinds(None) == (["started", "recovered"], False) and kinds(3) == (["started"], True) and kinds(50) == (["started", "recovered"], False)


def test_route_walk_does_not_depend_on_the_cuts(spark):
    """Traces out of order by a few places, released in pieces: the changes of the batch fold."""
    rng = random.Random(10)
    items, status = [], lambda: rng.choice(["completed"] * 5 + ["error"])
    for i in range(300):
        items.append((i, i, rng.choice("aab"), rng.choice([1, 1, 1, 2]), status()))
    t = trace(spark, items)
    want = rows(R.route_changes(t).select("old_trace_id", "candidate_trace_id", "confirming_trace_id", "old_reached_hop", "new_reached_hop", "first_seen_us", "confirmed_at_us"), "confirming_trace_id")
    arrived = t.withColumn("signature", F.to_json("route")).collect()
    arrived.sort(key=lambda r: r.trace_id + rng.choice([0, 0, 5, 9]))
    for step in (1, 17, 300):
        walk, got = R.Walk(), []
        for i in range(0, 300, step):
            for r in arrived[i : i + step]:
                walk.add(r)
            got += walk.release(min((r.started_at_us for r in arrived[i + step :]), default=10**18))
        assert [g[1:] for g in got] == want and len(want) > 10
        assert walk.next_us() is None


def test_a_late_sample_redoes_the_next_ones_minute(spark):
    """Sample 2 comes late: its own minute and that of sample 3, hours later, change; other generations do not."""
    from probelake.plans import counter_tiers as T

    names = ["rx_bytes", "tx_bytes"]
    every = counter_samples(spark, [(1, 0, 1, 10, 100), (1, 0, 2, 130, 400), (1, 0, 3, 9000, 1000), (1, 1, 4, 9100, 5), (2, 0, 5, 20, 7), (2, 0, 6, 30, 9)])
    before, late = every.where("event_id <> 2"), every.where("event_id = 2")
    minutes = C.rollup(before, names, T.MINUTE)
    hours = C.merge_rollups(minutes, names, T.HOUR)
    dirty = T.dirty_buckets(late, every)
    assert rows(dirty, "bucket_us") == [(1, 0, 120 * S), (1, 0, 9000 * S)]
    for got, width in zip(T.update(minutes, hours, dirty, every, names), (T.MINUTE, T.HOUR)):
        want = C.rollup(every, names, width)
        assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(map(str, want.select(sorted(got.columns)).collect()))
    # A minute is sealed by a later sample of its generation or by the generation's end.
    found = T.sealable(T.dirty_buckets(every, every), every, spark.createDataFrame([(1, 0)], "name long, generation long"), 10_000 * S)
    assert rows(found, "name", "bucket_us") == [(1, 0, 0), (1, 0, 120 * S), (1, 0, 9000 * S)]
    none = T.update(minutes, hours, dirty.limit(0), every, names)
    assert none[0].count() == minutes.count() and none[1].count() == hours.count()


# Generation 0 of interface 1: sample 2 comes late between two samples of its minute, sample 5 as the last of its own; the following samples are minutes and an hour away.
CROWDED = [(1, 0, 1, 10, 100), (1, 0, 2, 20, 150), (1, 0, 3, 30, 200), (1, 0, 4, 130, 400), (1, 0, 5, 140, 500), (1, 0, 6, 9000, 1000), (1, 1, 7, 9100, 5)]


def test_only_a_minutes_last_sample_dirties_the_next_minute(spark):
    from probelake.plans import counter_tiers as T

    names = ["rx_bytes", "tx_bytes"]
    every = counter_samples(spark, CROWDED)
    inner, last = every.where("event_id = 2"), every.where("event_id = 5")
    assert rows(T.dirty_buckets(inner, every), "bucket_us") == [(1, 0, 0)]
    assert rows(T.dirty_buckets(last, every), "bucket_us") == [(1, 0, 120 * S), (1, 0, 9000 * S)]
    for late in (inner, last):
        minutes = C.rollup(every.join(late, "event_id", "left_anti"), names, T.MINUTE)
        got = T.update(minutes, C.merge_rollups(minutes, names, T.HOUR), T.dirty_buckets(late, every), every, names)[0]
        want = C.rollup(every, names, T.MINUTE)
        assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(map(str, want.select(sorted(got.columns)).collect()))


def test_minutes_that_no_late_sample_changed_are_not_sealable(spark):
    from probelake.plans import counter_tiers as T

    every = counter_samples(spark, CROWDED)
    closed = spark.createDataFrame([(1, 0)], "name long, generation long")
    dirty = T.dirty_buckets(every.where("event_id = 2"), every)
    assert rows(T.sealable(dirty, every, closed, 10_000 * S)) == [(1, 0, 0)]


def test_hours_that_no_late_sample_changed_are_not_eligible(spark):
    from probelake.plans import counter_tiers as T

    every = counter_samples(spark, CROWDED)
    dirty = T.dirty_buckets(every.where("event_id = 4"), every)
    assert rows(T.sealable_hours(T.parents(dirty), dirty.limit(0), 20_000 * S)) == [(1, 0, 0)]
    dirty = T.dirty_buckets(every.where("event_id = 5"), every)
    assert rows(T.sealable_hours(T.parents(dirty), dirty.limit(0), 20_000 * S), "bucket_us") == [(1, 0, 0), (1, 0, 7200 * S)]


def against_sql(spark, folder, name, changed):
    """Differences of a query from its SQL on the smallest events with some columns changed."""
    import duckdb

    from probelake.queries import ORACLES, QUERIES
    from tests.oracle import differences

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    con.sql(f"copy (select * replace ({changed}) from '/root/testdata/sf0.001/events.parquet') to '{folder}/events.parquet' (format parquet)")
    con.sql(f"create view events as select * from '{folder}/events.parquet'")
    return differences(spark, con, QUERIES[name], ORACLES[name], str(folder))


@pytest.mark.parametrize("name", ["iface_sealable", "iface_dirty_buckets", "iface_latest"])
def test_samples_without_a_time_come_last(spark, tmp_path, name):
    # The last two generations of one interface have no time at all.
    changed = "case when event_id % 101 = 0 or user_id % 10 = 3 and ts >= '2024-01-28' then null else ts end as ts"
    assert against_sql(spark, tmp_path, name, changed) == ([], [])


@pytest.mark.parametrize("name", ["iface_dirty_eligible", "iface_dirty_buckets", "iface_incremental_minute", "iface_incremental_hour"])
def test_samples_without_a_name_are_of_one_interface(spark, tmp_path, name):
    assert against_sql(spark, tmp_path, name, "case when user_id % 10 = 3 then null else user_id end as user_id") == ([], [])


def test_eligible_hours_need_not_be_over_in_the_query(spark, tmp_path):
    from probelake.plans import counter_tiers as T

    assert against_sql(spark, tmp_path, "iface_dirty_eligible", "ts + interval 3 day as ts") == ([], [])
    hours = spark.createDataFrame([(1, 0, 0), (1, 0, 3600 * S), (None, 0, 3600 * S)], "name long, generation long, bucket_us long")
    assert rows(T.sealable_hours(hours, hours.limit(0), 7199 * S)) == [(1, 0, 0)]
    assert rows(T.sealable_hours(hours, hours.where("name is null"), 7200 * S), "bucket_us") == [(1, 0, 0), (1, 0, 3600 * S)]


def test_route_fold_against_a_plain_walk(spark):
    """Windows and the walk over few traces against a walk over all."""
    rng = random.Random(9)
    items, status = [], lambda: rng.choice(["completed"] * 5 + ["error"])
    for i in range(400):
        items.append((i, i, rng.choice("aab"), rng.choice([1, 1, 1, 2]), status()))
    t = trace(spark, items)
    cur = cand = None
    want = []
    for i, _, who, hop, st in items:
        if st != "completed":
            continue
        if cur is None:
            cur = (i, who, hop)
        elif (who, hop) == cur[1:]:
            cand = None
        elif cand and cand[1:] == (who, hop):
            want.append((cur[0], cand[0], i))
            cur, cand = (i, who, hop), None
        else:
            cand = (i, who, hop)
    got = [(r.old_trace_id, r.candidate_trace_id, r.confirming_trace_id) for r in R.route_changes(t).orderBy("confirmed_at_us").collect()]
    assert got == want and len(want) > 5
    assert (R.current_routes(t).first().current_trace_id, R.current_routes(t).first().candidate_trace_id) == (cur[0], cand and cand[0])


def test_silence_restarts_recovery(spark):
    policy = O.Policy(relative_pct=50.0, baseline_window_us=MIN, min_samples=3, fast_interval_us=S // 10, recover_after_us=S // 5)
    start = [(0, None, False)]
    assert [m.kind for m in walk(spark, start + [(120, 1, False), (120.2, 1, False)], policy)] == ["started", "recovered"]
    assert [m.kind for m in walk(spark, start + [(120, 1, False), (120.200001, 1, False)], policy)] == ["started"]


def test_two_rollups_write_the_same(spark, tmp_path):
    p = probe(spark, [(1, i, i * 30, 5, False, False, 100) for i in range(6)])
    agg = tiers.minute_rollup(p, no_gaps(spark))
    for _ in range(2):
        tiers.write_rollup(agg, str(tmp_path / "r"), 60)
    assert tiers.read_rollup(spark, str(tmp_path / "r"), 60).count() == agg.count() == 3


@pytest.mark.parametrize("maker", [lambda p, g: probes.raw_agg(p, g, MIN, 0), lambda p, g: tiers.minute_rollup(p, g), lambda p, g: series.worst_samples(p, MIN), lambda p, g: O.baselines(p, POLICY)])
def test_empty_tables(spark, maker):
    assert maker(probe(spark, []), no_gaps(spark)).count() == 0


def test_timeline_numbers_over_all_days(spark):
    day = 86_400 * S
    found = spark.createDataFrame([(n, t) for t in (3 * day + S, 5, day, 3 * day) for n in (2, 1)], "name long, bucket_us long")
    want = [(i + 1, n, t) for i, (t, n) in enumerate((t, n) for t in (5, day, 3 * day, 3 * day + S) for n in (1, 2))]
    assert rows(C.timeline(found), "place") == want and rows(C.timeline(found.limit(0))) == []


def test_whole_days_and_sentences_are_registered(spark):
    from probelake.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    days = QUERIES["signal_timeline"](spark, sf).select(F.floor(F.col("bucket_us") / (86_400 * S))).distinct()
    assert days.count() > 1
    text = [r.detail for r in QUERIES["incident_log_full"](spark, sf).where("trigger = 'latency_spike'").collect()]
    assert text and all("; the limit is " in t and t.endswith(" ms.") for t in text)


def test_two_places_round_the_exact_value(spark):
    values = [0.0, 0.001, 0.005, 0.015, 0.125, 0.995, 1.005, 1.115, 2.675, 84.585, 99.995, 0.375, 1e6 + 0.625, 12345678.5] + [k / 1000 for k in range(5, 20_000, 10)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", O.two_places(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == [f"{r.v:.2f}" for r in got]


def changed_tables(folder, changed):
    """DuckDB with the smallest tables, copied, and some columns of events changed."""
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t, what in (("events", f"* replace ({changed})"), ("orders", "*"), ("nation", "*")):
        con.sql(f"copy (select {what} from '/root/testdata/sf0.001/{t}.parquet') to '{folder}/{t}.parquet' (format parquet)")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def test_kinds_without_events_are_told_of(spark, tmp_path):
    from probelake.queries import ORACLES, QUERIES
    from tests.oracle import differences

    con = changed_tables(tmp_path, "timestamp '2024-01-01' + to_seconds(event_id) as ts")
    assert differences(spark, con, QUERIES["probe_events"], ORACLES["probe_events"], str(tmp_path)) == ([], [])


def test_totals_beyond_64_bits(spark, tmp_path):
    from probelake.queries import ORACLES, QUERIES

    con = changed_tables(tmp_path, "ts + interval 100000 year as ts")
    want = con.sql(ORACLES["probe_events"].replace(" as bigint)", " as hugeint)")).fetchall()
    got = [(r.kind, r.n, None if r.total is None else int(r.total)) for r in QUERIES["probe_events"](spark, str(tmp_path)).collect()]
    assert max(t for _, _, t in want) > 2**63 and sorted(got) == sorted(want)


#: Unanswered probes stand open at the evaluation time, 2024-01-31: one in 15 is sent 50 ms before it.
OPEN = "case when event_id % 15 = 0 then timestamp '2024-01-30 23:59:59.95' else ts end as ts"
NAMELESS = "case when user_id % 10 = 3 then null else user_id end as user_id"
#: A third of all times lies after the evaluation time.
AFTER = "ts + interval 10 day as ts"


@pytest.mark.parametrize("changed", [OPEN, NAMELESS])
def test_open_probes_hold_no_hours_back(spark, tmp_path, changed):
    assert against_sql(spark, tmp_path, "dirty_eligible", changed) == ([], [])


@pytest.mark.parametrize("changed", [OPEN, AFTER])
def test_open_probes_are_not_unanswered_in_redone_minutes(spark, tmp_path, changed):
    assert against_sql(spark, tmp_path, "incremental_rollup", changed) == ([], [])


@pytest.mark.parametrize("changed", [OPEN, AFTER])
def test_open_probes_are_not_unanswered_in_redone_hours(spark, tmp_path, changed):
    assert against_sql(spark, tmp_path, "incremental_rollup_hours", changed) == ([], [])


@pytest.mark.parametrize("changed", [OPEN, AFTER])
def test_open_probes_are_not_unanswered_in_hours(spark, tmp_path, changed):
    assert against_sql(spark, tmp_path, "ping_rollup_hour", changed) == ([], [])


@pytest.mark.parametrize("changed", [OPEN, AFTER])
def test_open_probes_are_not_unanswered_in_minutes(spark, tmp_path, changed):
    assert against_sql(spark, tmp_path, "ping_rollup_minute", changed) == ([], [])


@pytest.mark.parametrize("changed", [OPEN, AFTER])
def test_open_probes_are_not_unanswered_in_stored_hours(spark, tmp_path, changed):
    assert against_sql(spark, tmp_path, "stored_hours", changed) == ([], [])


@pytest.mark.parametrize("changed", [OPEN, AFTER])
def test_open_probes_are_not_unanswered_in_an_overlay(spark, tmp_path, changed):
    assert against_sql(spark, tmp_path, "tier_overlay", changed) == ([], [])


@pytest.mark.parametrize("changed", [OPEN, AFTER])
def test_open_probes_are_not_unanswered_in_a_sink(spark, tmp_path, changed):
    assert against_sql(spark, tmp_path, "rollup_sink", changed) == ([], [])


def test_open_probes_are_not_unanswered_in_minutes_of_streams(spark, tmp_path):
    assert against_sql(spark, tmp_path, "stream_rollup", AFTER) == ([], [])


def test_open_probes_are_not_unanswered_in_hours_of_streams(spark, tmp_path):
    assert against_sql(spark, tmp_path, "stream_rollup_hours", AFTER) == ([], [])


def test_open_probes_are_not_unanswered_in_minutes_of_replies(spark, tmp_path):
    assert against_sql(spark, tmp_path, "stream_replies_rollup", AFTER) == ([], [])


def test_incidents_of_streams_whose_batches_have_many_files(spark, tmp_path):
    """Each batch is written as several files that are not in order of time: the batch fold's transitions."""
    from probelake.queries import QUERIES

    (tmp_path / "in").mkdir()
    changed_tables(tmp_path / "in", "ts as ts")
    rows_ = spark.read.parquet(str(tmp_path / "in" / "events.parquet"))
    rows_.repartition(8, "event_id").write.option("maxRecordsPerFile", 50).parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = QUERIES["stream_incidents"](spark, str(tmp_path)).collect()
        want = QUERIES["transitions"](spark, str(tmp_path)).select("target_id", "at_us", "kind", "reason").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert want and sorted(got, key=str) == sorted(want, key=str)


def test_batches_of_traces_grow_in_number_not_in_size(spark, monkeypatch):
    """Each batch's traces wait in state, so a larger table comes in more batches; the changes are the batch fold's."""
    from probelake.queries import QUERIES
    from probelake.queries import stream_queries as Q

    sf, paths, made = "/root/testdata/sf0.001", {}, Q.scratch
    monkeypatch.setattr(Q, "BATCH_TRACES", 200, raising=False)
    monkeypatch.setattr(Q, "scratch", lambda spark, name: paths.setdefault(name, made(spark, name)))
    got = QUERIES["stream_route_changes"](spark, sf)
    got, names = got.collect(), got.columns
    sizes = [r["count"] for r in spark.read.parquet(paths["traces"]).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 8 and max(sizes) < 400
    want = QUERIES["route_changes"](spark, sf).select(names).collect()
    assert want and sorted(got) == sorted(want)
