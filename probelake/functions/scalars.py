"""Column functions of probes, series and charts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The steps of a decade that a chart's scale may end on.
NICE_STEPS = [1.0, 1.2, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0]


def whole(a: Column, b: Column | int) -> Column:
    """Whole division, towards negative infinity, of longs."""
    b = F.lit(b) if isinstance(b, int) else b
    return ((a - F.pmod(a, b)) / b).cast("long")


def epoch_bucket(t: Column, width_us: int | Column) -> Column:
    """Start of the epoch-aligned bucket that holds a time."""
    return t - F.pmod(t, F.lit(width_us) if isinstance(width_us, int) else width_us)


def anchored_bucket(t: Column, start_us: int, width_us: int) -> Column:
    """Number of the bucket that holds a time, counted from ``start_us``."""
    return whole(t - F.lit(start_us), width_us)


def deadline(sent: Column, timeout_ns: Column) -> Column:
    return sent + whole(timeout_ns, 1000)


def outcome(as_of_us: int | Column) -> Column:
    """send_error, on_time, late, unanswered or pending of a probe row."""
    as_of = F.lit(as_of_us) if isinstance(as_of_us, int) else as_of_us
    return (
        F.when(F.col("local_outcome").isNotNull(), F.lit("send_error"))
        .when(F.col("reply_class").isNotNull(), F.col("reply_class"))
        .when(deadline(F.col("sent_at_us"), F.col("timeout_ns")) > as_of, F.lit("pending"))
        .otherwise(F.lit("unanswered"))
    )


def percent(part: Column, whole_: Column) -> Column:
    """100 * part / whole; null where the whole is zero or null."""
    return F.when(whole_ > 0, 100.0 * part / whole_)


def ms(ns: Column) -> Column:
    return ns / 1e6


def nice_ceil(x: Column) -> Column:
    """The least of ``NICE_STEPS`` times a power of ten that reaches ``x``, with a slack of 1e-9; other than positive finite numbers stay."""
    k = F.floor(F.log10(x)).cast("int")
    scale = F.pow(F.lit(10.0), k)
    # Put together from its decimal digits, so that 3 tenths are 0.3 exactly.
    spelled = lambda step, shift=0: F.concat(F.lit(f"{step:g}E"), (k + shift).cast("string")).cast("double")
    pick = reduce(lambda c, s: c.when(x <= s * scale * (1 + 1e-9), spelled(s)), NICE_STEPS[1:], F.when(x <= NICE_STEPS[0] * scale * (1 + 1e-9), spelled(NICE_STEPS[0])))
    return F.when((x > 0) & (x < float("inf")), pick.otherwise(spelled(1.0, 1))).otherwise(x)


def nice_ceil_sql(x: str) -> str:
    """The same in SQL."""
    scale = f"pow(10.0::double, floor(log10({x})))"
    arms = " ".join(f"when {x} <= {s}::double * {scale} * (1 + 1e-9) then cast('{s:g}e' || cast(floor(log10({x})) as int) as double)" for s in NICE_STEPS)
    return f"case when {x} > 0 then case {arms} else cast('1e' || cast(floor(log10({x})) + 1 as int) as double) end else {x} end"


def point_width(span_us: Column, max_points: Column) -> Column:
    """Width of a series point: one point is kept back for the bucket that straddles both ends."""
    parts = F.when(max_points > 1, max_points - 1).otherwise(max_points)
    return F.greatest(-whole(-span_us, parts), F.lit(100_000).cast("long"))


def round_up(width: Column, base: int) -> Column:
    return -whole(-width, base) * base


def normalise_address(address: Column) -> Column:
    """An address without zone, IPv4 taken out of its IPv6 mapping, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(address), "%.*$", ""), r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", "$1")


def any_positive(*names: str) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(n) > 0, F.lit(False)) for n in names])


def trace_outcome() -> Column:
    return F.when(F.col("status") != "completed", F.col("status")).when(F.col("reached"), F.lit("reached")).otherwise(F.lit("unreached"))


def settled_at() -> Column:
    """When a probe row's deadline passes."""
    return deadline(F.col("sent_at_us"), F.col("timeout_ns"))
