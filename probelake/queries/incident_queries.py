"""Queries of incident detection."""

from probelake.operators import incidents as O
from probelake.queries.base import query, view
from probelake.sources import adapters as A

POLICY = O.Policy()
W, FAST, RECOVER = POLICY.baseline_window_us, POLICY.fast_interval_us, POLICY.recover_after_us

view("epochs", "probes", """
    select *, cast(sum(moved) over (partition by target_id order by sent_at_us, sequence) as bigint) as epoch
    from (select *, case when endpoint <> lag(endpoint) over (partition by target_id order by sent_at_us, sequence) then 1 else 0 end as moved from probes)""")
view("settles", "epochs", """
    select *, case when local_outcome is not null then 'send_error' when reply_class is null or reply_class = 'late' then 'loss' else 'good' end as raw,
           case when local_outcome is not null then sent_at_us when reply_class is null or reply_class = 'late' then sent_at_us + timeout_ns // 1000 else reply_at_us end as settle_us from epochs""")
view("ends", "epochs", "select target_id, epoch, lead(begin_us) over (partition by target_id order by epoch) as end_us from (select target_id, epoch, min(sent_at_us) as begin_us from epochs group by all)")
# What happens to an epoch's probes, in order: each is sent, settles, and is drained by the settlement that leaves no earlier one open.
view("triggers", "settles", """
    select *, max(r) over (partition by target_id, epoch order by sent_at_us, sequence) as by_r, row_number() over (partition by target_id, epoch order by sent_at_us, sequence) as q from (
        select *, case when settle_us > sent_at_us then 0 else 2 end as late_place, row_number() over (partition by target_id, epoch order by settle_us, case when settle_us > sent_at_us then 0 else 2 end, sent_at_us, sequence) as r from settles)""")
view("gap_steps", "epochs gaps", """
    select p.target_id, p.epoch, 'gap' as ev, g.at_us as t, 1 as place, g.at_us as s1, -1 as s2, 0 as phase, 0 as q, -1 as sequence, g.at_us as sent_at_us, g.at_us as settle_us, null::bigint as rtt_ns, null::varchar as raw
    from (select target_id, first_us + (missed_count - 1) * 1800000000 as at_us from gaps) g asof join epochs p on p.target_id = g.target_id and p.sent_at_us < g.at_us""")
PROBE_STEPS = """
    select target_id, epoch, 'send' as ev, sent_at_us as t, 1 as place, sent_at_us as s1, sequence as s2, 0 as phase, 0 as q, sequence, sent_at_us, settle_us, rtt_ns, raw from triggers
    union all select target_id, epoch, 'settle', settle_us, late_place, sent_at_us, sequence, 0, 0, sequence, sent_at_us, settle_us, rtt_ns, raw from triggers
    union all select d.target_id, d.epoch, 'drain', s.settle_us, s.late_place, s.sent_at_us, s.sequence, 1, d.q, d.sequence, d.sent_at_us, d.settle_us, d.rtt_ns, d.raw
              from triggers d join triggers s on s.target_id = d.target_id and s.epoch = d.epoch and s.r = d.by_r"""
# Probes that are still open when the endpoint changes are forgotten.
ORDERED = """
    select s.*, row_number() over (partition by target_id, epoch order by t, place, s1, s2, phase, q) as k
    from ({}) s join ends using (target_id, epoch) where ev = 'send' or end_us is null or t < end_us or t = end_us and place < 2"""
MACHINE = f"""
    select * from (with recursive m as (
        select target_id, epoch, 0::bigint as k, false as active, null::varchar as reason, -1::bigint as last_bad, null::bigint as hs, null::bigint as ht, null::double as lim, null::double as base, 0::bigint as cnt,
               []::struct(s bigint, r bigint)[] as hist, []::struct(q bigint, b double, c bigint, l double, f varchar)[] as pend, null::bigint as t, null::varchar as ev, null::bigint as sequence,
               null::double as b, null::bigint as c, null::double as l, null::bigint as held, null::varchar as fault,
               null::varchar as kind, null::varchar as why, null::double as rtt_ns, null::double as out_base, null::bigint as out_cnt, null::double as out_lim
        from (select distinct target_id, epoch from STEPS)
        union all
        select target_id, epoch, k, starts or active and not done, case when starts then f when done then null else reason end,
               case when hit then greatest(last_bad, hit_at) when cut then greatest(last_bad, sent_at_us) else last_bad end,
               case when done or hit and (active or starts) then null else hs2 end, case when done or hit and (active or starts) then null else ht2 end,
               case when starts then me.l else lim end, case when starts then me.b else base end, case when starts then me.c else cnt end,
               list_concat(case when cut or hit and (active or starts) then [] else hist end, case when f in ('counts', 'keeps') then [{{'s': sent_at_us, 'r': rtt_ns}}] else [] end),
               case ev when 'send' then list_append(pend, {{'q': sequence, 'b': b, 'c': c, 'l': l, 'f': null::varchar}})
                       when 'settle' then list_transform(pend, lambda x: case when x.q = sequence then {{'q': x.q, 'b': x.b, 'c': x.c, 'l': x.l, 'f': f}} else x end)
                       when 'drain' then list_filter(pend, lambda x: x.q <> sequence) else pend end,
               t, ev, sequence, b, c, l, n, case when ev = 'drain' then case when f = 'latency' then f else me.f end end,
               case when starts then 'started' when done then 'recovered' end, case when starts then f else reason end, rtt_ns::double,
               case when starts then me.b else base end, case when starts then me.c else cnt end, case when starts then me.l else lim end
        from (select *, coalesce(f = 'counts' and ht2 - hs2 >= {RECOVER}, false) as done from (
            select *, ev = 'settle' and f in ('loss', 'latency') and not active as starts, ev = 'gap' or ev = 'settle' and f <> 'good' or ev = 'drain' and f = 'latency' as hit,
                   case when ev = 'drain' then settle_us else t end as hit_at, coalesce(f = 'counts' and sent_at_us - ht > {2 * FAST}, false) as cut,
                   case when f = 'counts' then case when hs is null or sent_at_us - ht > {2 * FAST} then sent_at_us else hs end else hs end as hs2, case when f = 'counts' then sent_at_us else ht end as ht2
            from (select *, case when active then base else mean end as b, case when active then cnt else n end as c, case when active then lim when n >= 3 then mean * 2.0::double end as l,
                         case ev when 'settle' then case when raw = 'good' and rtt_ns > case when active then lim else me.l end then 'latency' else raw end
                                 when 'drain' then case when me.f <> 'good' then 'bad' when not active then 'keeps' when rtt_ns > lim then 'latency' when sent_at_us < last_bad then 'skipped' else 'counts' end else ev end as f
                from (select *, len(hist) as n, list_sum(list_transform(hist, lambda x: x.r))::double / nullif(len(hist), 0) as mean from (
                    select o.*, m.active, m.reason, m.last_bad, m.hs, m.ht, m.lim, m.base, m.cnt, m.pend, list_filter(m.pend, lambda x: x.q = o.sequence)[1] as me,
                           case when o.ev = 'send' then list_filter(m.hist, lambda x: x.s >= o.sent_at_us - {W}) else m.hist end as hist
                    from m join STEPS o on o.target_id = m.target_id and o.epoch = m.epoch and o.k = m.k + 1)))))) select * from m)"""
FINAL = "select * from MACHINE qualify k = max(k) over (partition by target_id, epoch)"
MOVES = """
    select target_id, epoch, t as at_us, kind, why as reason, sequence, rtt_ns, out_base as baseline_ns, out_cnt as baseline_count, out_lim as limit_ns from MACHINE where kind is not null
    union all select target_id, epoch, end_us, 'endpoint_changed', reason, null, null, base, cnt, lim from FINAL join ends using (target_id, epoch) where active and end_us is not null"""
view("ordered", "triggers ends", ORDERED.format(PROBE_STEPS))
view("machine", "ordered", MACHINE.replace("STEPS", "ordered"))
view("final", "machine", FINAL.replace("MACHINE", "machine"))
view("moves", "machine final ends", MOVES.replace("MACHINE", "machine").replace("FINAL", "final"))
view("gap_ordered", "triggers gap_steps ends", ORDERED.format(PROBE_STEPS + " union all select * from gap_steps"))
view("gap_machine", "gap_ordered", MACHINE.replace("STEPS", "gap_ordered"))
view("gap_final", "gap_machine", FINAL.replace("MACHINE", "gap_machine"))
view("gap_moves", "gap_machine gap_final ends", MOVES.replace("MACHINE", "gap_machine").replace("FINAL", "gap_final"))
view("limits", "machine", "select target_id, sequence, b as baseline_ns, c as baseline_count, l as limit_ns, held from machine where ev = 'send'")


def judged(spark, sf_dir):
    return O.baselines(A.probes(spark, sf_dir), POLICY)


def folded(spark, sf_dir):
    return O.fold(A.probes(spark, sf_dir), POLICY)


def moves(spark, sf_dir):
    return O.transitions(folded(spark, sf_dir))


@query("limits", "select sequence, baseline_ns, baseline_count from limits")
def baseline_mean(spark, sf_dir):
    return judged(spark, sf_dir).select("sequence", "baseline_ns", "baseline_count")


@query("limits", "select sequence, limit_ns from limits")
def latency_limit(spark, sf_dir):
    return judged(spark, sf_dir).select("sequence", "limit_ns")


@query("epochs machine", "select e.sequence, m.fault from epochs e left join (select sequence, fault from machine where ev = 'drain') m using (sequence)")
def probe_fault(spark, sf_dir):
    return judged(spark, sf_dir).select("sequence", "fault")


@query("settles", "select sequence, settle_us, max(settle_us) over (partition by target_id, epoch order by sent_at_us, sequence) as eff_settle_us from settles")
def send_order_settle(spark, sf_dir):
    return O.settle_times(A.probes(spark, sf_dir)).select("sequence", "settle_us", "eff_settle_us")


@query("moves", "select * from moves")
def transitions(spark, sf_dir):
    return moves(spark, sf_dir)


@query("moves", """
    select target_id, epoch, at_us as started_at_us, reason, ended_at_us, ended_by, limit_ns from (
        select *, lead(at_us) over w as ended_at_us, lead(kind) over w as ended_by from moves window w as (partition by target_id, epoch order by at_us, case when kind = 'started' then 1 else 0 end, sequence nulls first))
    where kind = 'started'""")
def incidents(spark, sf_dir):
    return O.incidents(moves(spark, sf_dir))


@query("gap_moves", "select * from gap_moves")
def transitions_with_gaps(spark, sf_dir):
    """Transitions when slots that were missed interrupt recoveries too."""
    from probelake.operators import gaps as G

    return O.transitions(O.fold(A.probes(spark, sf_dir), POLICY, gaps=G.infer_gaps(A.probes_sent(spark, sf_dir), A.INTERVAL_NS)))


@query("final ends", f"""
    select target_id, case when target_id in (9) then 'disabled' when active then 'obsessing' when len(list_filter(hist, lambda x: x.s >= t - {W})) < 3 then 'warming' else 'normal' end as state,
           case when active then reason end as reason, coalesce(case when active then ht - hs end, 0) as healthy_for_us
    from final join ends using (target_id, epoch) where end_us is null""")
def incident_status(spark, sf_dir):
    return O.status(folded(spark, sf_dir), [9])


@query("moves", f"select target_id, at_us, case when kind = 'started' then {FAST} else 10800000000 end as interval_us from moves")
def cadence_changes(spark, sf_dir):
    return O.cadence(moves(spark, sf_dir), 3 * A.HOUR, POLICY)


@query("limits", "select target_id, sequence, least(held, 8) as held, held > 8 as limited from limits")
def bounded_history(spark, sf_dir):
    return O.bounded_history(judged(spark, sf_dir), 8)


MESSAGE = """
    select *, case kind when 'recovered' then 'Probes were healthy for the whole recovery time.' when 'endpoint_changed' then 'The target''s address changed; its baseline starts anew.' else
        case trigger when 'latency_spike' then 'A reply took ' || printf('%.2f', rtt_ns / 1e6::double) || ' ms; the limit is ' || printf('%.2f', limit_ns / 1e6::double) || ' ms.'
                     when 'late_reply' then 'A reply came after its deadline: ' || printf('%.2f', rtt_ns / 1e6::double) || ' ms.' else 'No reply came by the deadline.' end end as detail,
        case when trigger = 'latency_spike' and baseline_ns > 0 then (rtt_ns / baseline_ns - 1) * 100 end as increase_pct
    from (select *, case when kind = 'started' then case when reason = 'latency' then 'latency_spike' when rtt_ns is not null then 'late_reply' else 'timeout' end end as trigger from moves)"""
view("told", "moves", MESSAGE)


@query("told", "select target_id, at_us, kind, trigger, increase_pct, detail from told")
def transition_message(spark, sf_dir):
    return O.message(moves(spark, sf_dir), POLICY).select("target_id", "at_us", "kind", "trigger", "increase_pct", "detail")


@query("told targets", "select name, at_us, kind, detail from told join targets using (target_id)")
def incident_log(spark, sf_dir):
    told = O.message(moves(spark, sf_dir), POLICY).join(A.targets(spark, sf_dir), "target_id")
    return told.select("name", "at_us", "kind", "detail")


@query("told targets", "select name, target_id, at_us, kind, trigger, increase_pct, detail from told join targets using (target_id)")
def incident_log_full(spark, sf_dir):
    """Transitions with target, trigger, increase and sentence."""
    told = O.message(moves(spark, sf_dir), POLICY).join(A.targets(spark, sf_dir), "target_id")
    return told.select("name", "target_id", "at_us", "kind", "trigger", "increase_pct", "detail")
