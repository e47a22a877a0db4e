"""Traceroute routes: signatures, confirmed changes, differences and histories.

A route is an array of (ttl, responders), sorted by ttl, each with its sorted
distinct responders.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUTE = "array<struct<ttl:int,responders:array<string>>>"


def responders(probes: DataFrame) -> DataFrame:
    """Distinct responders of each trace and ttl; probes without a reply are left out."""
    return probes.where("responder is not null").groupBy("trace_id", "ttl").agg(F.array_sort(F.collect_set("responder")).alias("responders"))


def signatures(probes: DataFrame) -> DataFrame:
    """(trace_id, route, signature) of every trace that has probes; silent ones have an empty route."""
    hops = responders(probes).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("ttl", "responders"))).alias("route"))
    every = probes.select("trace_id").distinct().join(hops, "trace_id", "left")
    route = F.coalesce("route", F.array().cast(ROUTE))
    return every.select("trace_id", route.alias("route"), F.to_json(route).alias("signature"))


def parse(signature: Column) -> Column:
    return F.from_json(signature, ROUTE)


def reached_hops(probes: DataFrame, destination: Column, reached: Column) -> DataFrame:
    """The smallest ttl at which the destination itself answered; 0 without one."""
    return probes.groupBy("trace_id").agg(F.coalesce(F.min(F.when(reached & (F.col("responder") == destination), F.col("ttl"))), F.lit(0)).alias("reached_hop"))


def prefer_method(attempts: DataFrame) -> DataFrame:
    """One attempt per round: the paris one if any of its probes was answered, else the classic one."""
    rank = F.when((F.col("method") == "paris-udp") & F.col("answered"), 2).when(F.col("method") == "classic-udp", 1).otherwise(0)
    return attempts.groupBy("round").agg(F.max_by(F.struct("method", "trace_id", "answered"), rank).alias("a")).select("round", "a.*")


def differs(old: Column, new: Column) -> Column:
    """Whether some ttl has responders in both routes and none in common."""
    return F.exists(
        new,
        lambda b: F.exists(old, lambda a: (a["ttl"] == b["ttl"]) & (F.size(a["responders"]) > 0) & (F.size(b["responders"]) > 0) & ~F.arrays_overlap(a["responders"], b["responders"])),
    )


def _unlike(old: dict, old_hop: int, new: dict, new_hop: int) -> bool:
    """Whether a trace reaches another hop or differs in a meaningful way: ``differs`` for routes as sets by ttl."""
    return old_hop != new_hop or any(b and a and b.isdisjoint(a) for ttl, b in new.items() if (a := old.get(ttl)))


FOLDED = f"endpoint_id long, context long, kind string, old_trace_id long, candidate_trace_id long, confirming_trace_id long, old_route {ROUTE}, new_route {ROUTE}, old_reached_hop int, new_reached_hop int, first_seen_us long, confirmed_at_us long"


def folded(traces: DataFrame) -> DataFrame:
    """Confirmed changes (``changes_of``), and a row of kind ``state`` at the end of every context, that is of every stretch of one endpoint, method and flow (``current_of``).

    A trace with another route than the current one, by reached hop or by a
    meaningful difference, is a candidate; the next one in turn that has the very
    same route and hop confirms it.  A trace that agrees with the current route
    clears the candidate.  So only three kinds of traces matter: a context's first,
    the second of a run of equal ones, and its last.  Windows find these; a task
    then walks them in order and holds the current route alone.
    """
    fit = traces.where("status = 'completed' and route is not null")
    w = Window.partitionBy("target_id").orderBy("started_at_us", "trace_id")
    moved = F.coalesce(F.struct("endpoint_id", "method", "flow_id") != F.lag(F.struct("endpoint_id", "method", "flow_id")).over(w), F.lit(True))
    # Routes are compared by 128 bits of hash; the windows carry no second route.
    mark = F.struct("reached_hop", F.xxhash64("route"), F.xxhash64(F.lit(1), "route"))
    fit = fit.withColumn("mark", mark)
    same = F.coalesce(~moved & (F.col("mark") == F.lag("mark").over(w)), F.lit(False))
    marked = fit.select("target_id", "endpoint_id", "trace_id", "route", "reached_hop", "started_at_us", "ended_at_us", moved.alias("first"), same.alias("same"), F.lag("trace_id").over(w).alias("before"), F.lag("started_at_us").over(w).alias("before_us"))
    marked = marked.select("*", (F.col("same") & ~F.lag("same", 1, False).over(w)).alias("second"), F.lead("first", 1, True).over(w).alias("last"), F.sum(F.col("first").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("context"))
    # The windows have brought each target's traces together and in order; neither is done again.
    kept = marked.where("first or second or last").sortWithinPartitions("target_id", "started_at_us", "trace_id")
    names = ["target_id", *[c.split()[0] for c in FOLDED.split(", ")]]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur = hops = None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                sets = {h["ttl"]: set(h["responders"]) for h in r.route}
                candidate = None
                if r.first:
                    cur, hops = r, sets
                elif _unlike(hops, cur.reached_hop, sets, r.reached_hop):
                    candidate = r.trace_id
                    if r.second:
                        out.append((r.target_id, r.endpoint_id, r.context, "change", cur.trace_id, r.before, r.trace_id, cur.route, r.route, cur.reached_hop, r.reached_hop, r.before_us, r.ended_at_us))
                        cur, hops, candidate = r, sets, None
                if r.last:
                    out.append((r.target_id, r.endpoint_id, r.context, "state", cur.trace_id, candidate, None, cur.route, None, cur.reached_hop, None, None, None))
            longs = [c.split()[0] for c in FOLDED.split(", ") if c.endswith((" long", " int"))]
            yield pd.DataFrame(out, columns=names).astype(dict.fromkeys(longs, "Int64"))

    return kept.mapInPandas(walk, f"target_id {traces.schema['target_id'].dataType.simpleString()}, {FOLDED}")


CHANGE = ["old_trace_id", "candidate_trace_id", "confirming_trace_id", "old_route", "new_route", "old_reached_hop", "new_reached_hop", "first_seen_us", "confirmed_at_us"]


def changes_of(folded: DataFrame) -> DataFrame:
    return folded.where("kind = 'change'").select("target_id", "endpoint_id", *CHANGE)


def current_of(folded: DataFrame) -> DataFrame:
    last = folded.where("kind = 'state'").groupBy("target_id").agg(F.max_by(F.struct("old_trace_id", "old_route", "old_reached_hop", "candidate_trace_id"), "context").alias("s"))
    return last.select("target_id", F.col("s.old_trace_id").alias("current_trace_id"), F.col("s.old_route").alias("route"), F.col("s.old_reached_hop").alias("reached_hop"), F.col("s.candidate_trace_id").alias("candidate_trace_id"))


def route_changes(traces: DataFrame) -> DataFrame:
    """Confirmed route changes; a new context begins anew without one, other than completed traces are passed over."""
    return changes_of(folded(traces))


def current_routes(traces: DataFrame) -> DataFrame:
    """Each target's current route and open candidate."""
    return current_of(folded(traces))


def hop_diff(changes: DataFrame) -> DataFrame:
    """Per change and ttl of either route: old and new responders, whether they differ, and whether that is evidence."""
    side = lambda c, name: changes.select("confirming_trace_id", F.explode(c).alias("h")).select("confirming_trace_id", "h.ttl", F.col("h.responders").alias(name))
    both = side("old_route", "old").join(side("new_route", "new"), ["confirming_trace_id", "ttl"], "full")
    none = F.array().cast("array<string>")
    both = both.withColumn("old", F.coalesce("old", none)).withColumn("new", F.coalesce("new", none)).withColumn("different", F.col("old") != F.col("new"))
    return both.withColumn("evidence", F.col("different") & (F.size("old") > 0) & (F.size("new") > 0) & ~F.arrays_overlap("old", "new"))


def change_labels(changes: DataFrame) -> DataFrame:
    """A sentence per change: hops with evidence, and whether the destination is reached otherwise."""
    hops = hop_diff(changes).where("evidence").groupBy("confirming_trace_id").agg(F.array_sort(F.collect_list("ttl")).alias("hops"))
    rows = changes.select("confirming_trace_id", (F.col("old_reached_hop") != F.col("new_reached_hop")).alias("moved")).join(hops, "confirming_trace_id", "left")
    named = F.when(F.size("hops") > 0, F.concat(F.when(F.size("hops") == 1, F.lit("Hop ")).otherwise(F.lit("Hops ")), F.array_join(F.col("hops").cast("array<string>"), ", "), F.lit(" changed")))
    text = F.concat_ws(" · ", named, F.when(F.col("moved"), F.lit("Destination observation changed")))
    return rows.select("confirming_trace_id", F.when(text == "", F.lit("Confirmed route change")).otherwise(text).alias("label"))


def history_buckets(traces: DataFrame, changes: DataFrame, from_us: int, to_us: int, points: int) -> DataFrame:
    """Buckets anchored at ``from_us``, dense, per target: traces, reached, unreached, errors and confirmed changes."""
    width = -(-(to_us - from_us) // points)
    number = lambda c: F.floor((F.col(c) - from_us) / width).cast("long")
    inside = lambda c: (F.col(c) >= from_us) & (F.col(c) < to_us)
    done = F.col("status") == "completed"
    seen = traces.where(inside("started_at_us")).groupBy("target_id", number("started_at_us").alias("i")).agg(
        F.count("*").alias("traces"), F.count_if(done & F.col("reached")).alias("reached"), F.count_if(done & ~F.col("reached")).alias("unreached"), F.count_if(~done).alias("errors")
    )
    moved = changes.where(inside("confirmed_at_us")).groupBy("target_id", number("confirmed_at_us").alias("i")).agg(F.count("*").alias("changes"))
    slots = traces.select("target_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(-(-(to_us - from_us) // width) - 1)).cast("array<bigint>")))
    out = slots.join(seen, ["target_id", "i"], "left").join(moved, ["target_id", "i"], "left")
    start = F.lit(from_us) + F.col("i") * width
    return out.select("target_id", "i", start.alias("from_us"), F.least(start + width, F.lit(to_us)).alias("to_us"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("traces", "reached", "unreached", "errors", "changes")])


def newest(rows: DataFrame, order: list, limit: int, by: str = "target_id") -> DataFrame:
    """The newest rows of each target, and whether some are left out."""
    w = Window.partitionBy(by)
    ranked = rows.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("truncated", F.count("*").over(w) > limit)
    return ranked.where(F.col("place") <= limit)


def trace_detail(runs: DataFrame, probes: DataFrame) -> DataFrame:
    """Runs with their probes nested in order."""
    nested = probes.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("ttl", "probe_index", "token", "responder"))).alias("probes"))
    return runs.join(nested, "trace_id", "left")


def change_detail(changes: DataFrame, targets: DataFrame, runs: DataFrame) -> DataFrame:
    """Changes with their target's name, and the method of the confirming, else candidate, else old run."""
    run = lambda p: runs.select(F.col("trace_id").alias(f"{p}_trace_id"), F.col("method").alias(f"{p}_method"))
    out = changes.join(targets.select("target_id", "name"), "target_id")
    for p in ("old", "candidate", "confirming"):
        out = out.join(run(p), f"{p}_trace_id", "left")
    return out.withColumn("method", F.coalesce("confirming_method", "candidate_method", "old_method"))


@dataclass
class Walk:
    """The fold of one target's traces, for streams: current route, candidate, and traces held back until their turn.

    Routes are JSON texts (``to_json`` of a route); held has [started_at_us, trace_id, endpoint_id, reached_hop, ended_at_us]
    of each trace and notes its [route, method, flow_id].
    """

    context: list = field(default_factory=list)
    current: list = field(default_factory=list)
    route: str = ""
    candidate: list = field(default_factory=list)
    candidate_route: str = ""
    held: list = field(default_factory=list)
    notes: list = field(default_factory=list)

    def add(self, r) -> None:
        if r.status == "completed" and r.signature is not None:
            self.held.append([int(r.started_at_us), int(r.trace_id), int(r.endpoint_id), int(r.reached_hop), int(r.ended_at_us)])
            self.notes.append([r.signature, r.method, r.flow_id])

    def release(self, before_us: int) -> list[tuple]:
        """The changes that traces started before this time confirm, in the order of their starts."""
        order = sorted(range(len(self.held)), key=lambda i: tuple(self.held[i]))
        due = [i for i in order if self.held[i][0] < before_us]
        out = [x for i in due if (x := self._step(self.held[i], self.notes[i]))]
        kept = [i for i in range(len(self.held)) if self.held[i][0] >= before_us]
        self.held, self.notes = [self.held[i] for i in kept], [self.notes[i] for i in kept]
        return out

    def next_us(self) -> int | None:
        return min((h[0] for h in self.held), default=None)

    def _step(self, trace: list, note: list) -> tuple | None:
        started, trace_id, endpoint, hop, ended = trace
        route, context = note[0], [str(endpoint), *map(str, note[1:])]
        if not self.current or self.context != context:
            self.context, self.current, self.route, self.candidate = context, [trace_id, hop], route, []
        elif not _unlike(_sets(self.route), self.current[1], _sets(route), hop):
            self.candidate = []
        elif self.candidate and (self.candidate_route, self.candidate[1]) == (route, hop):
            made = (endpoint, self.current[0], self.candidate[0], trace_id, self.current[1], hop, self.candidate[2], ended)
            self.current, self.route, self.candidate = [trace_id, hop], route, []
            return made
        else:
            self.candidate, self.candidate_route = [trace_id, hop, started], route
        return None


@lru_cache(maxsize=10_000)
def _sets(route: str) -> dict:
    return {h["ttl"]: frozenset(h.get("responders") or ()) for h in json.loads(route)}


WALK = "context array<string>, current array<long>, route string, candidate array<long>, candidate_route string, held array<array<long>>, notes array<array<string>>"
STREAMED = "endpoint_id long, old_trace_id long, candidate_trace_id long, confirming_trace_id long, old_reached_hop int, new_reached_hop int, first_seen_us long, confirmed_at_us long"
