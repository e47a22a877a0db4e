"""N-gram Jaccard join by MinHash banding.

1. Documents of equal word-window sets form a *set class*; only classes go on.
2. Each class has ``bands * rows`` minimum hashes; bands are as many as the
   target recall at the threshold asks for.  Classes that agree in a band are
   drawn to that bucket's smallest class, never to each other, so the number of
   candidate edges is linear.  Components of these edges are the candidate groups;
   of large ones that unlike classes chain together, the buckets are.
3. Within a group every pair is verified on its full sets, block against block:
   a group of any size becomes block pairs, bounded in classes and in bytes of text
   (one text is never split), each a task's work,
   which returns only each class's number of links and a spanning forest.
4. Components of the forests are the near-duplicate classes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probelake.llm.common import packed, stored, unpacked, whole_texts
from probelake.llm.components import components
from probelake.llm.hashing import U, mix, shingles, slices

WORDS, THRESHOLD, ROWS, RECALL, BLOCK = 5, 0.8, 8, 0.999, 512
#: Bytes of text that a block holds, but for chance and for single texts that are longer.
BLOCK_BYTES = 4 << 20
#: Members of candidate groups (some 60 bytes each) that may be sent to the documents; more are joined with them.
SENT_MEMBERS = 100_000
#: Sets with more than this part of all rows as copies are sent, not joined: fewer than this many.
HOT_SETS = 10_000


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """Bands after which a pair of just ``threshold`` is met with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, n, dtype=U) * U(2) + U(1), rng.integers(1, 1 << 63, n, dtype=U)


def distinct_sets(parts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct windows of each part, one part after the other, and their numbers."""
    h, n = shingles(parts, words)
    part = np.repeat(np.arange(len(parts)), n)
    order = np.lexsort((h, part))
    h, part = h[order], part[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (part[1:] != part[:-1])
    return h[new], np.bincount(part[new], minlength=len(parts))


def sliced_sets(texts: Sequence[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """``distinct_sets`` of the texts, hashed slice by slice, as hashing takes many times their bytes."""
    some = [distinct_sets(parts, words) for _, parts in slices(texts)]
    return np.concatenate([h for h, _ in some]), np.concatenate([n for _, n in some])


def set_digest(h: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    """A 128-bit digest of each set; null for an empty one."""
    full = n > 0
    at = (np.cumsum(n) - n)[full]
    two = [np.add.reduceat(mix(h + U(k)), at) if len(at) else np.zeros(0, U) for k in (1, 2)]
    both = np.stack(two, 1).astype(">u8")
    out: list[bytes | None] = [None] * len(n)
    for i, row in zip(np.flatnonzero(full), both, strict=True):
        out[i] = row.tobytes()
    return out


def signatures(text: pd.Series, bands: int, rows: int, words: int) -> pd.DataFrame:
    """Set digest and band hashes of each text."""
    a, b = coefficients(bands * rows)
    digests, buckets = [], []
    for _, parts in slices(text.tolist()):
        h, n = distinct_sets(parts, words)
        digests += set_digest(h, n)
        full = np.flatnonzero(n > 0)
        at = (np.cumsum(n) - n)[full]
        out = np.zeros((len(parts), bands), "int64")
        for k in range(bands if len(at) else 0):
            band = np.full(len(at), k + 1, U)
            for j in range(k * rows, (k + 1) * rows):
                band = (band ^ (np.minimum.reduceat(h * a[j] + b[j], at) >> U(8))) * U(0x9FB21C651E98DF25)
                band ^= band >> U(35)
            out[full, k] = band.view("int64")
        buckets += [r if f else None for r, f in zip(out, n > 0, strict=True)]
    return pd.DataFrame({"digest": digests, "bands": buckets})


def _links(h: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix: which of the left sets reaches the threshold with which of the right ones."""
    _, column = np.unique(h, return_inverse=True)
    owner = np.repeat(np.arange(len(n)), n)
    degree = np.bincount(column)
    inter = np.zeros((len(n), len(n)), "int32")
    common = np.flatnonzero(degree > 8)
    rank = np.full(len(degree), -1)
    rank[common] = np.arange(len(common))
    dense = rank[column]
    order = np.argsort(dense, kind="stable")
    lo = np.searchsorted(dense[order], np.arange(0, len(common) + 2048, 2048))
    for k, (s, e) in enumerate(zip(lo[:-1], lo[1:], strict=True)):
        block = np.zeros((len(n), 2048), "float32")
        own = order[s:e]
        block[owner[own], dense[own] - 2048 * k] = 1
        inter += (block @ block.T).astype("int32")  # 2048 at most, so exact in float32
    # Rare windows: each meets in at most 28 pairs.
    few = np.flatnonzero((degree[column] > 1) & (degree[column] <= 8))
    few = few[np.argsort(column[few], kind="stable")]
    col, own = column[few], owner[few]
    for step in range(1, 8):
        same = np.flatnonzero(col[step:] == col[:-step]) if len(col) > step else np.zeros(0, int)
        np.add.at(inter, (own[same], own[same + step]), 1)
        np.add.at(inter, (own[same + step], own[same]), 1)
    return _reached(inter[np.ix_(left, right)], n[left][:, None] + n[right][None, :], threshold)


def _reached(inter: np.ndarray, total: np.ndarray, threshold: float) -> np.ndarray:
    """Whether Jaccard = i / (total - i) >= threshold, in whole numbers: the threshold is taken as the simple fraction that it is."""
    t = Fraction(threshold).limit_denominator(10_000)
    return inter.astype("int64") * (t.numerator + t.denominator) >= t.numerator * total.astype("int64")


def _forest(pairs: np.ndarray, size: int) -> np.ndarray:
    """Smallest member of each one's component, from pairs of places."""
    root = np.arange(size)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        before = root.copy()
        np.minimum.at(root, pairs[:, 0], low)
        np.minimum.at(root, pairs[:, 1], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def block_pairs(docs: DataFrame, groups: DataFrame, nodes: DataFrame, block: int, block_bytes: int, sent: int = SENT_MEMBERS) -> DataFrame:
    """The classes of each candidate group (id, root, bands) with their texts, once for each pair of blocks (low, high) that each is in."""
    member = stored(groups.join(nodes.select(F.col("node").alias("id"), "set_id", "check", "copies", "size"), "id"))
    n = F.count("*")
    # A group of middling size makes some blocks too, so that no task is far larger than the others.
    blocks = F.greatest(F.ceil(n / block), F.least(F.ceil(n / min(256, block)), F.lit(8)), F.ceil(F.sum("size") / block_bytes)).cast("int")
    member = member.join(member.groupBy("root").agg(blocks.alias("blocks")), "root").drop("size")
    member = member.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # The class's text: of the document with its smallest id, checked by its digest in the task.  Copies without an id are one row.
    texts = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_check"), F.col("text").alias("_text"))
    bare = texts.where("_doc is null").groupBy("_doc", "_check").agg(F.first("_text").alias("_text"))
    texts = texts.where("_doc is not null").unionByName(bare)
    # Rows that repeat an id and its text are one row too; only classes with such rows pay for that.
    again = texts.where("_doc is not null").groupBy("_doc", "_check").count().where("count > 1").select("_doc", "_check", F.lit(True).alias("again"))
    member = stored(member.join(again, (F.col("set_id") == F.col("_doc")) & (F.col("check") == F.col("_check")), "left").drop("_doc", "_check"))
    few = member.count() <= sent  # then documents need not be shuffled to meet them
    repeats = not member.where("again").isEmpty()
    member = texts.join(F.broadcast(member) if few else member, F.col("set_id").eqNullSafe(F.col("_doc")) & (F.col("check") == F.col("_check"))).drop("_doc", "_check")
    if repeats:
        others = [c for c in member.columns if c not in ("root", "id")]
        one = member.where("again").groupBy("root", "id").agg(*[F.first(c).alias(c) for c in others])
        member = member.where("again is null").unionByName(one.select(*member.columns))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = member.select("*", other).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    return pairs.select("root", "low", "high", "id", "own", "copies", "bands", "_text")


def candidate_groups(nodes: DataFrame, whole: int, sent: int = SENT_MEMBERS) -> DataFrame:
    """(id, root, bands): groups in which every pair of classes that agree in a band meets.

    A component of ties between bucket members and their bucket's smallest class is a
    group, bands null.  Ties are not verified, so unlike classes may chain into one;
    of a component of over ``whole`` classes that has fewer pairs bucket by bucket,
    each bucket is a group instead, whose members bring their bands along.
    """
    entries = nodes.select("node", F.explode("bands").alias("bucket"))
    leaders = entries.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Leaders are not sent even where they are few, so that the plan is the same at every size.
    edges = entries.join(leaders.hint("shuffle_hash"), "bucket").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    groups = components(edges)
    large = stored(groups.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > whole))
    none = groups.select("id", "root", F.lit(None).cast("array<bigint>").alias("bands"))
    if large.isEmpty():
        return none
    member = stored(groups.join(large, "root"))
    few = member.count() <= sent  # then the bands of all classes need not be shuffled to meet them
    inside = stored(nodes.select(F.col("node").alias("id"), "bands").join(F.broadcast(member) if few else member, "id"))
    buckets = inside.select("root", "n", F.explode("bands").alias("bucket")).groupBy("root", "n", "bucket").agg(F.count("*").alias("k")).where("k > 1")
    apart = stored(buckets.groupBy("root", "n").agg(F.sum(F.col("k").cast("double") * F.col("k")).alias("cost")).where(F.col("cost") < F.col("n").cast("double") * F.col("n")).select("root"))
    used = stored(buckets.join(apart, "root", "left_semi").select("root", "bucket"))
    # Bands come to the members that are left, instead of along with each of their own bands.
    split = inside.join(apart, "root", "left_semi").select("id", "root", F.explode("bands").alias("bucket")).join(used, ["root", "bucket"])
    split = split.select("id", F.unhex(F.lpad(F.hex("bucket"), 16, "0")).alias("root")).join(inside.select("id", "bands"), "id").select("id", "root", "bands")
    return none.join(apart, "root", "left_anti").select("id", "root", "bands").unionByName(split)


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, rows: int = ROWS, recall: float = RECALL, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, whole: int = BLOCK) -> DataFrame:
    """One row for every row of ``docs`` (doc_id, text): doc_id, class_id, n_links, set_id.

    n_links counts the other documents whose word-window sets have a Jaccard
    similarity of at least ``threshold`` (documents of the same set among them).
    class_id is the smallest doc_id of those that links connect, directly or by
    way of others; set_id that of the documents of the very same set.  A document
    without words has no link and is its own class.  Null ids: class_id and set_id
    are null for classes with no other id.  Repeated rows count as documents; only
    one of them is compared.
    """
    whole_texts(docs.sparkSession)
    bands = bands_for(threshold, rows, recall)
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    @F.pandas_udf(schema)
    def sign(text: pd.Series) -> pd.DataFrame:
        return signatures(text, bands, rows, words)

    signed = docs.select("doc_id", F.octet_length("text").cast("long").alias("size"), F.xxhash64("text").alias("check"), sign("text").alias("s"))
    signed = stored(signed.select("doc_id", "size", "check", F.col("s.digest").alias("node"), "s.bands"))
    first = F.coalesce("doc_id", F.lit(2**63 - 1))
    nodes = stored(signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("set_id"), F.min_by("check", first).alias("check"), F.count("*").alias("copies"), F.max("size").alias("size"), F.first("bands").alias("bands")))

    def verify(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        h, n = sliced_sets(part["_text"].tolist(), words)
        digests = set_digest(h, n)
        seen, keep = set(), np.zeros(len(part), bool)
        for i, (mine, wanted) in enumerate(zip(digests, part["id"], strict=True)):
            wanted = bytes(wanted)
            if mine == wanted and wanted not in seen:
                seen.add(wanted)
                keep[i] = True
        h, n, part = h[np.repeat(keep, n)], n[keep], part[keep].reset_index(drop=True)
        side = part["own"].to_numpy()
        left, right = np.flatnonzero(side == key[1]), np.flatnonzero(side == key[2])
        hit = _links(h, n, left, right, threshold)
        if key[1] == key[2]:
            np.fill_diagonal(hit, False)
        if len(part) and part["bands"].iloc[0] is not None:  # a pair counts in the first of the buckets that it shares
            band, bucket = np.stack(part["bands"].to_numpy()), int.from_bytes(key[0], "big", signed=True)
            for r, i in enumerate(left):
                there = np.flatnonzero(hit[r])
                same = band[right[there]] == band[i]
                hit[r, there] = band[i][same.argmax(axis=1)] == bucket
        copies = part["copies"].to_numpy()
        links = np.zeros(len(part), "int64")
        links[left] += hit @ copies[right]
        if key[1] != key[2]:
            links[right] += hit.T @ copies[left]
        i, j = np.nonzero(hit)
        root = _forest(np.stack([left[i], right[j]], 1), len(part))
        ids = part["id"]
        return pd.DataFrame({"id": ids, "links": links, "up": ids.iloc[root].to_numpy()})

    pairs = block_pairs(docs, candidate_groups(nodes, whole), nodes, block, block_bytes)
    found = pairs.groupBy("root", "low", "high").applyInPandas(verify, "id binary, links long, up binary")
    found = stored(found.where("links > 0"))
    near = components(found.where("id <> up").select(F.col("id").alias("a"), F.col("up").alias("b")))
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = near.join(nodes.select(F.col("node").alias("id"), "set_id"), "id").groupBy("root").agg(F.min("set_id").alias("class_id"))
    by_node = nodes.select(F.col("node").alias("id"), "set_id", "copies").join(linked, "id", "left").join(near.join(classes, "root").drop("root"), "id", "left")
    by_node = by_node.select(F.col("id").alias("_node"), "copies", "set_id", F.coalesce("class_id", "set_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # Rows of a set with very many copies do not move to meet it: such sets are few and are sent.
    by_node, hot = stored(by_node), max(64, (nodes.agg(F.sum("copies")).first()[0] or 0) // HOT_SETS)
    out = signed.select("doc_id", "node").join(F.broadcast(by_node.where(F.col("copies") > hot)), F.col("node") == F.col("_node"), "left")
    rest = out.where("_node is null").select("doc_id", "node").join(by_node.where(F.col("copies") <= hot), F.col("node") == F.col("_node"), "left")
    bare = F.col("node").isNull()
    return out.where("_node is not null").unionByName(rest).select("doc_id", F.when(bare, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(bare, F.col("doc_id")).otherwise(F.col("set_id")).alias("set_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with the document of the smallest id of each near-duplicate class.

    Documents without an id or without words stay, as do rows that repeat a kept id
    (the exact stage before this one leaves one of those).
    """
    dropped = near_classes(docs).where("class_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return unpacked(packed(docs).join(dropped, F.col("_doc.doc_id") == F.col("gone"), "left_anti"))
