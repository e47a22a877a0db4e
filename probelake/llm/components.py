"""Connected components by repeated minimum labels, for any number of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelake.llm.common import stored


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, root) for every node of ``edges`` (a, b): root is the smallest node of its component.

    Each round replaces every node's parent by the smallest among its
    neighbours' parents, then lets it take its parent's parent; rounds end when
    nothing changes.  Each round's table is written to the shared folder.  Labels are
    unique on one side of every join, so a large component's rows may be split (AQE).
    """
    # Both directions from one pass: a union of the two would make the edges twice.
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(edges.select(F.explode(ways).alias("e")).select("e.a", "e.b").distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("root")))
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        low = labels.join(near, "id").select("id", F.least("root", "near").alias("low"), "root")
        up = labels.select(F.col("id").alias("low"), F.col("root").alias("up"))
        step = stored(low.join(up, "low").select("id", F.least("low", "up").alias("new"), "root"))
        changed = step.where("new <> root").limit(1).count()
        labels = step.select("id", F.col("new").alias("root"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
