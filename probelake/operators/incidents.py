"""Incidents by an adaptive baseline of healthy replies: faults, transitions, status, log.

A target's probes between two endpoint changes are an *epoch*.  What a probe is
held against depends on how all earlier ones were judged, so limits, faults and
transitions come from one fold.  Spark sorts each target's probes; a task walks
them in the order of sending and holds only the probes that are still open and the
healthy replies of the baseline window, so a target's history may be of any
length.  Batch and stream share the fold.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.functions.scalars import whole
from probelake.operators.gaps import gap_end


@dataclass(frozen=True)
class Policy:
    """Settings of incident detection; times in microseconds."""

    relative_pct: float | None = 100.0
    absolute_ns: int | None = None
    baseline_window_us: int = 12 * 3_600_000_000
    min_samples: int = 3
    fast_interval_us: int = 2 * 3_600_000_000
    recover_after_us: int = 3 * 3_600_000_000
    #: Probes on their way and healthy replies held for a target at most; beyond it the oldest reply goes.
    capacity: int | None = None


MAX_NS = float(2**63 - 1)


def with_epoch(probes: DataFrame) -> DataFrame:
    w = Window.partitionBy("target_id").orderBy("sent_at_us", "sequence")
    moved = F.coalesce(F.col("endpoint") != F.lag("endpoint").over(w), F.lit(False))
    return probes.withColumn("epoch", F.sum(moved.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def settle_times(probes: DataFrame) -> DataFrame:
    """Probes with settle_us, the reply's time or the deadline, and eff_settle_us, that of the
    slowest so far in their epoch, as good results count in the order of sending."""
    deadline = F.col("sent_at_us") + whole(F.col("timeout_ns"), 1000)
    lost = F.col("reply_class").isNull() | (F.col("reply_class") == "late")
    settle = F.when(F.col("local_outcome").isNotNull(), F.col("sent_at_us")).when(lost, deadline).otherwise(F.col("reply_at_us"))
    w = Window.partitionBy("target_id", "epoch").orderBy("sent_at_us", "sequence").rowsBetween(Window.unboundedPreceding, 0)
    return with_epoch(probes).withColumn("settle_us", settle).withColumn("eff_settle_us", F.max("settle_us").over(w))


@dataclass
class State:
    """What a target's fold carries on; -1 stands for no time and no value."""

    endpoint: int = -1
    epoch: int = 0
    now_us: int = -1
    active: bool = False
    reason: str = ""
    last_bad_us: int = -1
    healthy_since_us: int = -1
    healthy_through_us: int = -1
    baseline_ns: float = -1.0
    baseline_count: int = 0
    limit_ns: float = -1.0
    sent: deque = field(default_factory=deque)
    rtts: deque = field(default_factory=deque)
    total_ns: int = 0
    limited: bool = False


STATE = "endpoint long, epoch long, now_us long, active boolean, reason string, last_bad_us long, healthy_since_us long, healthy_through_us long, baseline_ns double, baseline_count long, limit_ns double, sent array<long>, rtts array<long>, total_ns long, limited boolean"


@dataclass
class Probe:
    """A probe on its way: what it is held against is fixed when it is sent."""

    sequence: int
    sent_at_us: int
    settle_us: int
    lost: str
    rtt_ns: int
    baseline_ns: float = -1.0
    baseline_count: int = 0
    limit_ns: float = -1.0
    held: int = 0
    fault: str = ""


#: A machine at rest: its state, and a list for each field of the probes on their way, in the order of sending.
RESTING = STATE + "".join(f", open_{f.name} array<{ {'int': 'long', 'float': 'double', 'str': 'string'}[f.type] }>".replace("< ", "<").replace(" >", ">") for f in fields(Probe))


FOLDED = "epoch long, kind string, at_us long, reason string, sequence long, rtt_ns double, baseline_ns double, baseline_count long, limit_ns double, held long, active boolean, healthy_for_us long"
TRANSITION = "at_us long, kind string, reason string, sequence long, rtt_ns double, baseline_ns double, baseline_count long, limit_ns double"


class Machine:
    """The fold of one target.  Faults count at once, good results when every earlier probe has settled.

    Settlements of one moment come in the order of sending, before the probes sent
    at that moment; those that settle as they are sent come after these.
    """

    def __init__(self, policy: Policy, state: State | None = None, each: bool = False):
        self.policy, self.state, self.each = policy, state or State(), each
        self.line: deque[Probe] = deque()
        self.due: list[tuple] = []
        self.seen = 0
        self.out: list[tuple] = []

    def send(self, p: Probe, endpoint: int | None) -> None:
        s = self.state
        self.advance(p.sent_at_us)
        if endpoint is not None:
            if s.endpoint not in (-1, endpoint):
                self._move(p.sent_at_us)
                s = self.state
            s.endpoint = endpoint
        self._prune(p.sent_at_us)
        if not self._room(p.sent_at_us):
            # Its result will not be seen, so no recovery may reach over it.
            self._interrupt(p.settle_us)
            return
        p.held = len(s.rtts)
        p.baseline_ns, p.baseline_count, p.limit_ns = (s.baseline_ns, s.baseline_count, s.limit_ns) if s.active else self._limit()
        self.line.append(p)
        self.seen += 1
        heapq.heappush(self.due, (p.settle_us, 0 if p.settle_us > p.sent_at_us else 2, p.sent_at_us, p.sequence, self.seen, p))

    def gap(self, at_us: int) -> None:
        self.advance(at_us)
        self._interrupt(at_us)

    def advance(self, to_us: int) -> None:
        while self.due and self.due[0][:2] <= (to_us, 0):
            self._settle(heapq.heappop(self.due)[-1])

    def finish(self) -> None:
        while self.due:
            self._settle(heapq.heappop(self.due)[-1])

    def close(self) -> None:
        """The last probes settle; then a row of kind ``state``."""
        self.finish()
        s = self.state
        self._prune(s.now_us)
        base, n, limit = (s.baseline_ns, s.baseline_count, s.limit_ns) if s.active else self._limit()
        healthy = s.healthy_through_us - s.healthy_since_us if s.active and s.healthy_since_us >= 0 else 0
        self._add("state", s.now_us, s.reason, -1, -1.0, base, n, limit, len(s.rtts), s.active, healthy)

    def rest(self) -> tuple:
        """What ``resume`` needs, as a row of ``RESTING``."""
        state = [list(v) if isinstance(v, deque) else v for v in (getattr(self.state, f.name) for f in fields(State))]
        return (*state, *[[getattr(p, f.name) for p in self.line] for f in fields(Probe)])

    @classmethod
    def resume(cls, policy: Policy, row: tuple) -> Machine:
        n = len(fields(State))
        state = State(*row[:n])
        state.sent, state.rtts = deque(state.sent), deque(state.rtts)
        machine = cls(policy, state)
        for values in zip(*row[n:], strict=True):
            p = Probe(*values)
            machine.line.append(p)
            machine.seen += 1
            if not p.fault:
                heapq.heappush(machine.due, (p.settle_us, 0 if p.settle_us > p.sent_at_us else 2, p.sent_at_us, p.sequence, machine.seen, p))
        return machine

    def next_us(self) -> int | None:
        """When the next probe on its way settles."""
        return self.due[0][0] if self.due else None

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def _add(self, kind: str, at_us: int, reason: str, sequence: int, rtt_ns: float, base: float, n: int, limit: float, held: int = 0, active: bool = False, healthy: int = 0) -> None:
        none = lambda v: None if v < 0 else v
        self.out.append((self.state.epoch, kind, at_us, reason or None, none(sequence), none(float(rtt_ns)), none(base), n, none(limit), held, active, healthy))

    def _limit(self) -> tuple[float, int, float]:
        """Mean and number of the healthy replies held, and the limit; -1 while unknown."""
        s, n = self.state, len(self.state.rtts)
        mean = s.total_ns / n if n else -1.0
        if self.policy.absolute_ns:
            return mean, n, float(self.policy.absolute_ns)
        return mean, n, min(mean * (1 + self.policy.relative_pct / 100), MAX_NS) if n >= self.policy.min_samples else -1.0

    def _prune(self, now_us: int) -> None:
        s, cutoff = self.state, now_us - self.policy.baseline_window_us
        while s.sent and s.sent[0] < cutoff:
            s.sent.popleft()
            s.total_ns -= s.rtts.popleft()

    def _room(self, now_us: int) -> bool:
        """Whether one more probe or reply may be held; the oldest reply gives way, which interrupts a recovery."""
        s, most = self.state, self.policy.capacity
        if most is None or len(self.line) + len(s.rtts) < most:
            return True
        s.limited = True
        if not s.rtts:
            return False
        s.sent.popleft()
        s.total_ns -= s.rtts.popleft()
        self._interrupt(now_us)
        return True

    def _keep(self, p: Probe) -> None:
        s = self.state
        if not self._room(s.now_us):
            return
        s.sent.append(p.sent_at_us)
        s.rtts.append(p.rtt_ns)
        s.total_ns += p.rtt_ns

    def _interrupt(self, at_us: int) -> None:
        s = self.state
        s.last_bad_us = max(s.last_bad_us, at_us)
        if s.active:
            s.healthy_since_us = s.healthy_through_us = -1
            s.sent.clear()
            s.rtts.clear()
            s.total_ns = 0

    def _fault(self, p: Probe, reason: str) -> None:
        s, p.fault = self.state, reason
        if not s.active:
            s.active, s.reason = True, reason
            s.baseline_ns, s.baseline_count, s.limit_ns = p.baseline_ns, p.baseline_count, p.limit_ns
            self._add("started", p.settle_us, reason, p.sequence, p.rtt_ns, p.baseline_ns, p.baseline_count, p.limit_ns)
        self._interrupt(p.settle_us)

    def _settle(self, p: Probe) -> None:
        s = self.state
        s.now_us = p.settle_us
        if p.lost == "send_error":
            p.fault = p.lost
            self._interrupt(p.settle_us)
        elif p.lost:
            self._fault(p, p.lost)
        elif 0 <= (s.limit_ns if s.active else p.limit_ns) < p.rtt_ns:
            self._fault(p, "latency")
        else:
            p.fault = "good"
        while self.line and self.line[0].fault:
            self._count(self.line.popleft(), p.settle_us)

    def _count(self, p: Probe, now_us: int) -> None:
        """A probe before which all have settled."""
        s = self.state
        if p.fault == "good" and not s.active:
            self._keep(p)
        elif p.fault == "good" and 0 <= s.limit_ns < p.rtt_ns:
            self._fault(p, "latency")  # an incident began meanwhile; its limit is frozen
        elif p.fault == "good" and p.sent_at_us >= s.last_bad_us:
            if 0 <= s.healthy_through_us < p.sent_at_us - 2 * self.policy.fast_interval_us:
                self._interrupt(p.sent_at_us)
            if s.healthy_since_us < 0:
                s.healthy_since_us = p.sent_at_us
            s.healthy_through_us = p.sent_at_us
            self._keep(p)
            if s.healthy_through_us - s.healthy_since_us >= self.policy.recover_after_us:
                self._add("recovered", now_us, s.reason, p.sequence, p.rtt_ns, s.baseline_ns, s.baseline_count, s.limit_ns)
                s.active, s.reason, s.healthy_since_us, s.healthy_through_us = False, "", -1, -1
        self._tell(p)

    def _tell(self, p: Probe) -> None:
        if self.each:
            self._add("probe", p.settle_us, p.fault, p.sequence, p.rtt_ns, p.baseline_ns, p.baseline_count, p.limit_ns, p.held)

    def _move(self, at_us: int) -> None:
        """A change of endpoint: probes on their way are forgotten, an incident ends, and all starts anew."""
        s = self.state
        for p in self.line:
            p.fault = ""
            self._tell(p)
        self.line.clear()
        self.due.clear()
        if s.active:
            self._add("endpoint_changed", at_us, s.reason, -1, -1.0, s.baseline_ns, s.baseline_count, s.limit_ns)
        self.state = State(epoch=s.epoch + 1, now_us=at_us)


NEEDED = ["sequence", "sent_at_us", "reply_at_us", "timeout_ns", "local_outcome", "reply_class", "rtt_ns", "endpoint"]


def feed(machine: Machine, r) -> None:
    """Let a machine see a row of ``NEEDED`` columns; one without a sequence is a missed slot."""
    sent = int(r.sent_at_us)
    if pd.isna(r.sequence):
        machine.gap(sent)
        return
    lost = "send_error" if not pd.isna(r.local_outcome) else "loss" if pd.isna(r.reply_class) or r.reply_class == "late" else ""
    settle = sent if lost == "send_error" else sent + int(r.timeout_ns) // 1000 if lost else int(r.reply_at_us)
    machine.send(Probe(int(r.sequence), sent, settle, lost, -1 if pd.isna(r.rtt_ns) else int(r.rtt_ns)), None if pd.isna(r.endpoint) else int(r.endpoint))


def _integers(frame: DataFrame) -> DataFrame:
    return frame.select("target_id", *[c if c in ("local_outcome", "reply_class") else F.col(c).cast("long").alias(c) for c in NEEDED])


def fold(probes: DataFrame, policy: Policy, each: bool = False, gaps: DataFrame | None = None) -> DataFrame:
    """Transitions of every target and its last state in a row of kind ``state``; with ``each``, a row of kind ``probe`` for every probe.

    ``gaps`` (runs of missed slots) interrupt recoveries.  A probe still on its way
    when the endpoint changes is forgotten: its fault is null.
    """
    rows = _integers(probes)
    if gaps is not None:
        none = [F.lit(None).cast("string" if c in ("local_outcome", "reply_class") else "long").alias(c) for c in NEEDED if c != "sent_at_us"]
        rows = rows.unionByName(gaps.select("target_id", gap_end().cast("long").alias("sent_at_us"), *none))
    ordered = rows.repartition("target_id").sortWithinPartitions("target_id", "sent_at_us", F.asc_nulls_first("sequence"))
    names = ["target_id", *[c.split()[0] for c in FOLDED.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        target, machine = None, None
        frame = lambda made: pd.DataFrame([(target, *m) for m in made], columns=names).astype({"sequence": "Int64"})
        for batch in batches:
            for r in batch.itertuples(index=False):
                if machine is None or r.target_id != target:
                    if machine is not None:
                        machine.close()
                        yield frame(machine.take())
                    target, machine = r.target_id, Machine(policy, each=each)
                feed(machine, r)
                if len(machine.out) >= 10_000:
                    yield frame(machine.take())
        if machine is not None:
            machine.close()
            yield frame(machine.take())

    return ordered.mapInPandas(run, f"target_id {probes.schema['target_id'].dataType.simpleString()}, {FOLDED}")


def baselines(probes: DataFrame, policy: Policy, gaps: DataFrame | None = None) -> DataFrame:
    """Every probe's target_id, epoch, sequence, what it is held against (baseline_ns and baseline_count of the healthy
    replies before it, in an incident those that it froze; limit_ns, null while unknown), the healthy replies held, and its fault:
    send_error, loss, latency (strictly over the limit) or good."""
    rows = fold(probes, policy, each=True, gaps=gaps).where("kind = 'probe'")
    return rows.select("target_id", "epoch", "sequence", F.when(F.col("baseline_count") > 0, F.col("baseline_ns")).alias("baseline_ns"), "baseline_count", "limit_ns", "held", F.col("reason").alias("fault"))


def transitions(folded: DataFrame) -> DataFrame:
    return folded.where("kind not in ('state', 'probe')").select("target_id", "epoch", "at_us", "kind", "reason", "sequence", "rtt_ns", "baseline_ns", "baseline_count", "limit_ns")


def incidents(moves: DataFrame) -> DataFrame:
    """[started, ended) of every incident, why it began and how it ended."""
    w = Window.partitionBy("target_id", "epoch").orderBy("at_us", F.when(F.col("kind") == "started", 1).otherwise(0), "sequence")
    out = moves.withColumn("ended_at_us", F.lead("at_us").over(w)).withColumn("ended_by", F.lead("kind").over(w)).where("kind = 'started'")
    return out.select("target_id", "epoch", F.col("at_us").alias("started_at_us"), "reason", "ended_at_us", "ended_by", "limit_ns")


def status(folded: DataFrame, disabled: list[int]) -> DataFrame:
    """Each target's state after its last probe: disabled, obsessing, warming (no limit is known yet) or normal."""
    last = folded.where("kind = 'state'")
    state = F.when(F.col("target_id").isin(disabled), "disabled").when(F.col("active"), "obsessing").when(F.col("limit_ns").isNull(), "warming").otherwise("normal")
    return last.select("target_id", state.alias("state"), "reason", "healthy_for_us")


def cadence(moves: DataFrame, normal_us: int, policy: Policy) -> DataFrame:
    """The interval asked for from each transition on: fast inside incidents."""
    return moves.select("target_id", "at_us", F.when(F.col("kind") == "started", policy.fast_interval_us).otherwise(normal_us).cast("long").alias("interval_us"))


def bounded_history(rows: DataFrame, capacity: int) -> DataFrame:
    """How many healthy replies each probe's history holds, and whether the capacity cut it; rows as ``baselines`` gives them."""
    return rows.select("target_id", "sequence", F.least("held", F.lit(capacity)).alias("held"), (F.col("held") > capacity).alias("limited"))


def two_places(value: Column) -> Column:
    """A double from 0 up as "%.2f" of C and Go gives it: its exact value rounded (``format_string`` rounds its shortest decimal)."""
    whole = F.floor(value)
    part = ((value - whole) * float(1 << 60)).cast("long")  # exact from 2**-8 up; less is 0.00
    low = part.bitwiseAND((1 << 20) - 1) * 100
    high = F.shiftright(part, 20) * 100 + F.shiftright(low, 20)
    cents, rest, half = F.shiftright(high, 40), high.bitwiseAND((1 << 40) - 1), 1 << 39
    up = (rest > half) | ((rest == half) & ((low.bitwiseAND((1 << 20) - 1) > 0) | (cents % 2 == 1)))
    total = whole * 100 + cents + up.cast("long")
    return F.concat(F.floor(total / 100).cast("string"), F.lit("."), F.lpad((total % 100).cast("string"), 2, "0"))


def message(moves: DataFrame, policy: Policy) -> DataFrame:
    """Transitions with trigger, increase in percent and a sentence."""
    ms = lambda c: two_places(F.col(c) / 1e6)
    trigger = F.when(F.col("kind") == "started", F.when(F.col("reason") == "latency", "latency_spike").when(F.col("rtt_ns").isNotNull(), "late_reply").otherwise("timeout"))
    text = (
        F.when(F.col("kind") == "recovered", F.lit("Probes were healthy for the whole recovery time."))
        .when(F.col("kind") == "endpoint_changed", F.lit("The target's address changed; its baseline starts anew."))
        .when(trigger == "latency_spike", F.concat(F.lit("A reply took "), ms("rtt_ns"), F.lit(" ms; the limit is "), ms("limit_ns"), F.lit(" ms.")))
        .when(trigger == "late_reply", F.concat(F.lit("A reply came after its deadline: "), ms("rtt_ns"), F.lit(" ms.")))
        .otherwise(F.lit("No reply came by the deadline."))
    )
    rise = F.when((trigger == "latency_spike") & (F.col("baseline_ns") > 0), (F.col("rtt_ns") / F.col("baseline_ns") - 1) * 100)
    return moves.select("*", trigger.alias("trigger"), rise.alias("increase_pct"), text.alias("detail"))
