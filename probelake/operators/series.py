"""Chart series: distributions, tails, worst samples, windows and outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.functions import sketch
from probelake.functions.scalars import epoch_bucket, ms, nice_ceil, outcome

DISTRIBUTION_CAP, TAIL_CAP, WORST_CAP, EXACT_BUDGET = 17, 24, 5, 30_000
KEYS = ["target_id", "bucket_us"]


def window_stats(hist: DataFrame, agg: DataFrame, seam_of: str = "p95_ns") -> DataFrame:
    """Per target over all buckets: replies, pooled quantiles, exact maximum and the seam, 2 * p95 rounded up.

    ``seam_of`` names another quantile for charts that should split lower.
    """
    q = sketch.quantiles(sketch.merge(hist, ["target_id"]), ["target_id"], {"p50_ns": 0.5, "p95_ns": 0.95, "p99_ns": 0.99})
    total = agg.groupBy("target_id").agg(F.sum("rtt_count").alias("rtt_count"), F.max("rtt_max_ns").alias("max_ns"))
    out = q.join(total, "target_id")
    return out.select("target_id", "rtt_count", *[ms(F.col(f"{p}_ns")).alias(f"{p}_ms") for p in ("p50", "p95", "p99")], ms(F.col("max_ns")).alias("max_ms"), nice_ceil(2 * ms(F.col(seam_of))).alias("seam_ms"))


def distribution(hist: DataFrame, agg: DataFrame) -> DataFrame:
    """Up to 17 evenly spaced quantiles of a bucket, each held between its minimum and maximum: one row per element."""
    run = sketch.running(hist, KEYS)
    k = F.least(F.col("total"), F.lit(DISTRIBUTION_CAP))
    # The elements whose rank falls into a bin, for all bins at once.
    i = F.explode(F.sequence(F.lit(0).cast("long"), k - 1)).alias("i")
    asked = run.select(*KEYS, "total").distinct().select(*KEYS, i, F.lit(1).alias("one"), "total")
    asked = asked.withColumn("rank", sketch.rank((F.col("i") + 0.5) / F.least(F.col("total"), F.lit(DISTRIBUTION_CAP)), F.col("total")))
    held = run.join(asked.select(*KEYS, "i", "rank"), KEYS).where((F.col("cum") >= F.col("rank")) & (F.col("cum") - F.col("n") < F.col("rank")))
    value = sketch.bin_value(F.col("bin"))
    joined = held.join(agg.select(*KEYS, "rtt_min_ns", "rtt_max_ns"), KEYS)
    return joined.select(*KEYS, "i", ms(F.greatest(F.col("rtt_min_ns"), F.least(value, F.col("rtt_max_ns")))).alias("value_ms"))


def tail(hist: DataFrame, agg: DataFrame, seam_ms: DataFrame) -> DataFrame:
    """Tail bins of every bucket, highest first: place, value_ms, n, late and whether bins were left out.

    A bin is in the tail if it lies above the seam, or in buckets of more than 17
    replies at or above max(4 * p50, p95).  It is late while the running count stays
    within the bucket's late replies and one timeout holds, or it lies above all.
    """
    q = sketch.quantiles(hist, KEYS, {"p50_ns": 0.5, "p95_ns": 0.95})
    info = agg.select(*KEYS, "rtt_count", "late", "rtt_min_ns", "rtt_max_ns", "timeout_min_ns", "timeout_max_ns").join(q, KEYS).join(seam_ms.select("target_id", "seam_ms"), "target_id")
    seam = F.when(F.col("seam_ms") > 0, F.floor(F.col("seam_ms") * 1e6).cast("long") + 1)
    body = F.when(F.col("rtt_count") > DISTRIBUTION_CAP, F.greatest(4 * F.col("p50_ns"), F.col("p95_ns")))
    info = info.withColumn("threshold", F.least(seam, body)).where("threshold is not null")
    bins = sketch.top_bins(hist.join(info, KEYS), KEYS, F.col("threshold"), TAIL_CAP)
    run = F.sum("n").over(Window.partitionBy(*KEYS).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    late = (run <= F.col("late")) & ((F.col("timeout_min_ns") == F.col("timeout_max_ns")) | (F.col("low") > F.col("timeout_max_ns")))
    value = F.greatest(F.col("rtt_min_ns"), F.least(F.col("value"), F.col("rtt_max_ns")))
    return bins.withColumn("late_flag", late).select(*KEYS, "place", ms(value).alias("value_ms"), "n", F.col("late_flag").alias("late"), "truncated")


def worst_samples(probes: DataFrame, width_us: int) -> DataFrame:
    """The five slowest replies of every bucket, the earlier first of equal ones."""
    keyed = probes.where("rtt_ns is not null and local_outcome is null").withColumn("bucket_us", epoch_bucket(F.col("scheduled_at_us"), width_us))
    w = Window.partitionBy(*KEYS).orderBy(F.desc("rtt_ns"), "scheduled_at_us", "sequence")
    return keyed.withColumn("place", F.row_number().over(w)).where(F.col("place") <= WORST_CAP).select(*KEYS, "place", "scheduled_at_us", "rtt_ns", (F.col("reply_class") == "late").alias("late"))


def missed_samples(probes: DataFrame, width_us: int, as_of_us: int) -> DataFrame:
    """The five earliest unanswered probes of every bucket."""
    lost = probes.where(outcome(as_of_us) == "unanswered").withColumn("bucket_us", epoch_bucket(F.col("scheduled_at_us"), width_us))
    w = Window.partitionBy(*KEYS).orderBy("scheduled_at_us", "sequence")
    return lost.withColumn("place", F.row_number().over(w)).where(F.col("place") <= WORST_CAP).select(*KEYS, "place", "scheduled_at_us")


def exact_buckets(agg: DataFrame, budget: int = EXACT_BUDGET, horizon_us: int | None = None) -> DataFrame:
    """Buckets whose samples may be read exactly: those of targets within the budget, not before the raw horizon."""
    eligible = agg if horizon_us is None else agg.where(F.col("bucket_us") >= horizon_us)
    total = F.sum("attempted").over(Window.partitionBy("target_id"))
    return eligible.withColumn("total", total).where(F.col("total") <= budget).select(*KEYS, "attempted")


def exact_samples(probes: DataFrame, agg: DataFrame, width_us: int, as_of_us: int, budget: int = EXACT_BUDGET, horizon_us: int | None = None) -> DataFrame:
    """Worst and missed samples of the buckets that the budget lets be read exactly: kind, place, time, round trip and whether it was late.

    The budget is settled on the aggregates first, so raw rows of other buckets are dropped before they are ranked.
    """
    held = exact_buckets(agg, budget, horizon_us).select(*KEYS)
    raw = probes.withColumn("bucket_us", epoch_bucket(F.col("scheduled_at_us"), width_us)).join(held, KEYS, "left_semi").drop("bucket_us")
    worst = worst_samples(raw, width_us).select(F.lit("worst").alias("kind"), *KEYS, "place", "scheduled_at_us", "rtt_ns", "late")
    missed = missed_samples(raw, width_us, as_of_us).select(F.lit("missed").alias("kind"), *KEYS, "place", "scheduled_at_us", F.lit(None).cast("long").alias("rtt_ns"), F.lit(None).cast("boolean").alias("late"))
    return worst.unionByName(missed)


def outlier_scale(window: DataFrame) -> DataFrame:
    """Whether a window reaches three times its seam (sky), and the rounded top of its scale."""
    sky = (F.col("seam_ms") > 0) & (F.col("max_ms") >= 3 * F.col("seam_ms"))
    return window.select("target_id", "seam_ms", sky.alias("sky"), nice_ceil(F.when(sky, 1.15).otherwise(1.08) * F.col("max_ms")).alias("top_ms"))


def severity(value: Column, seam: Column, top: Column) -> Column:
    return F.least(F.greatest(F.log(value / seam) / F.log(F.greatest(top / seam, F.lit(20.0))), F.lit(0.0)), F.lit(1.0))


def embers(tails: DataFrame, scale: DataFrame) -> DataFrame:
    """Tail bins above the seam of windows with a sky, with severity; mild ones are on time and under 0.35."""
    joined = tails.join(scale, "target_id").where(F.col("sky") & (F.col("value_ms") > F.col("seam_ms")))
    s = severity(F.col("value_ms"), F.col("seam_ms"), F.col("top_ms"))
    return joined.select(*KEYS, "place", "value_ms", "n", "late", s.alias("severity"), (~F.col("late") & (s < 0.35)).alias("mild"))


def labelled(embers_: DataFrame, worst: DataFrame) -> DataFrame:
    """The highest ember that is not mild of each of a target's three worst buckets; the exact worst reply where known."""
    top = embers_.where("not mild").groupBy(*KEYS).agg(F.max("value_ms").alias("value_ms"))
    ranked = top.withColumn("place", F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("value_ms"), "bucket_us"))).where("place <= 3")
    exact = worst.where("place = 1").select(*KEYS, F.col("rtt_ns").alias("exact_ns"))
    return ranked.join(exact, KEYS, "left").select(*KEYS, "place", F.coalesce(ms(F.col("exact_ns")), F.col("value_ms")).alias("label_ms"), F.col("exact_ns").isNotNull().alias("exact"))
