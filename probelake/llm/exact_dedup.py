"""Exact deduplication by a tree-merge of sorted digest runs.

Each partition turns its documents into a run of digest rows, sorted and with
equal digests folded.  Runs are then exchanged in rounds: in round ``r`` the
partitions whose numbers differ only in base-``fan_in`` digit ``r`` form a
group, and a row goes to the member whose digit equals digit ``r`` of the row's
digest.  Every receiver merges the runs that reach it and folds equal digests
again, so a digest of which there are a million copies crosses the network at
most once per partition in the first round and ``fan_in`` times less often in
each later one.  After the last round each digest lives in one partition and no
task ever saw more than its share of the distinct digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.llm.common import cut, packed, shuffle_width, unpacked

#: digest: SHA-256 of the normalised text; check: an independent hash and the length, which verify it.
RUN = "digest binary, check long, size long, keep_chars int, keep_id long, n long, n_kept long, slot int"
KEY = ["digest", "check", "size"]
#: A group is hot if it holds over one in ``HOT`` of all rows; so fewer than ``HOT`` groups are.
HOT = 1000
#: Groups that may be sent to every task at once (some 150 bytes each); more are joined by a shuffle.
SENT_GROUPS = 100_000


def normalised(text: Column) -> Column:
    """The text without blanks and ASCII line controls (code points 32 and 9 to 13); null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest, check, size (bytes) and chars (code points of the original) of every row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select("doc_id", F.char_length("t").alias("chars"), normalised(F.col("t")).alias("t"))
    return rows.select(
        "doc_id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.xxhash64("t").alias("check"),
        F.octet_length("t").cast("long").alias("size"),
        "chars",
    )


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge a stream of rows sorted by key, then by most characters and smallest id: one row per key."""
    open_row = None
    for batch in batches:
        if open_row is not None:
            batch = pd.concat([open_row, batch], ignore_index=True)
        if batch.empty:
            continue
        new = (batch[KEY] != batch[KEY].shift()).any(axis=1)
        run = new.cumsum()
        first = batch[new].set_index(run[new])
        same = (batch["keep_chars"] == run.map(first["keep_chars"])) & batch["keep_id"].fillna(-1).eq(run.map(first["keep_id"]).fillna(-1))
        first["n"] = batch["n"].groupby(run).sum()
        first["n_kept"] = batch["n_kept"].where(same, 0).groupby(run).sum()
        first = first.reset_index(drop=True)
        open_row = first.tail(1)
        if len(first) > 1:
            yield first.iloc[:-1]
    if open_row is not None:
        yield open_row


def _sorted_fold(runs: DataFrame) -> DataFrame:
    order = [*KEY, F.desc("keep_chars"), F.asc_nulls_last("keep_id")]
    return runs.sortWithinPartitions(*order).mapInPandas(_fold, RUN)


def merge_runs(rows: DataFrame, fan_in: int = 4, partitions: int | None = None) -> DataFrame:
    """One row per distinct digest: keep_id, keep_chars, n (rows), n_kept (rows that equal the kept one).

    ``partitions`` is rounded up to a power of ``fan_in``; the rounds are its logarithm.
    """
    width, rounds = fan_in, 1
    while width < (partitions or shuffle_width(rows.sparkSession)):
        width, rounds = width * fan_in, rounds + 1
    one = F.lit(1).cast("long")
    slot = F.pmod(F.spark_partition_id(), F.lit(width)).cast("int")
    runs = _sorted_fold(rows.select(*KEY, F.col("chars").alias("keep_chars"), F.col("doc_id").alias("keep_id"), one.alias("n"), one.alias("n_kept"), slot.alias("slot")))
    for r in range(rounds):
        unit = fan_in**r
        own = (F.col("slot") / unit).cast("int") % fan_in
        wanted = F.pmod(F.shiftright("check", 2 * r) if fan_in == 4 else (F.floor(F.col("check") / unit)), F.lit(fan_in)).cast("int")
        runs = runs.withColumn("slot", (F.col("slot") + (wanted - own) * unit).cast("int"))
        runs = _sorted_fold(runs.repartitionById(width, F.col("slot")))
    return runs.drop("slot")


def _with_groups(rows: DataFrame, groups: DataFrame, total: int, spread: Column) -> DataFrame:
    """``rows`` with keep_id, keep_chars, n and n_kept of their group (null without one).

    At most ``SENT_GROUPS`` groups are all broadcast, and no row moves.  Of more, the
    hot ones (fewer than ``HOT``) still are.  Rows of theirs have found their group
    then, so the join of all others scatters them by ``spread``.
    """
    values = ["keep_id", "keep_chars", "n", "n_kept"]
    hot = groups.where(F.col("n") * HOT > total).select(*KEY, *[F.col(c).alias(f"hot_{c}") for c in values])
    cold = groups.where(F.col("n") * HOT <= total).select(*KEY, *values, F.lit(0).alias("lane"))
    if groups.count() <= SENT_GROUPS:
        cold = F.broadcast(cold)
    lane = F.when(F.col("hot_n").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1).cast("int")
    out = rows.join(F.broadcast(hot), KEY, "left").withColumn("lane", lane).join(cold, [*KEY, "lane"], "left")
    return out.select(*rows.columns, *[F.coalesce(f"hot_{c}", c).alias(c) for c in values])


def exact_groups(docs: DataFrame, fan_in: int = 4) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text).

    Texts are equal when their normalised forms are.  Of a group the row with the
    most code points stays, then the smallest doc_id (a null id comes last).
    Null and blank texts form one group.  Rows that repeat an id and text are
    each reported, all as kept or none.  Other columns are ignored.
    """
    rows = cut(digests(docs))
    groups = cut(merge_runs(rows, fan_in).where("n > 1"))
    joined = _with_groups(rows, groups, rows.count(), F.col("doc_id"))
    alone = F.col("n").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars")))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, fan_in: int = 4) -> DataFrame:
    """``docs`` without all but the kept row of each group; of rows that repeat the kept id and text one stays."""
    rows = cut(digests(docs))
    groups = cut(merge_runs(rows, fan_in).where("n > 1"))
    text = normalised(F.col("_doc.text"))
    keyed = packed(docs).select("_doc", F.unhex(F.sha2(text, 256)).alias("digest"), F.xxhash64(text).alias("check"), F.octet_length(text).cast("long").alias("size"))
    joined = _with_groups(keyed, groups, rows.count(), F.col("_doc.doc_id"))
    chars = F.char_length(F.coalesce(F.col("_doc.text"), F.lit("")))
    best = F.col("_doc.doc_id").eqNullSafe(F.col("keep_id")) & (chars == F.col("keep_chars"))
    stays = unpacked(joined.where(F.col("n_kept").isNull() | (best & (F.col("n_kept") == 1))))
    if groups.where("n_kept > 1").isEmpty():
        return stays
    again = joined.where(best & (F.col("n_kept") > 1)).withColumn("id", F.col("_doc.doc_id")).dropDuplicates(["id", *KEY])
    return stays.unionByName(unpacked(again))
