"""Hierarchical multi-length packing.

A document is routed to the largest context size that it fills and is cut into
exactly full windows of that size; those need no padding.  What remains is a
filler piece.  Fillers are packed into windows of the longest size, longest
first, and each window's gap is filled from ever shorter fillers (best fit).
Documents are dealt to pack groups of a bounded number of documents, so that a
task never holds more than one group's piece lengths; ids stay in the first
stage, which has already turned each piece into its checksum.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelake.llm.common import whole_texts
from probelake.llm.token_counts import ByWord, Splitter, byte_symbols

TIERS = (256, 512, 1024)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, tier int"
PACKED = PIECES + ", sequence_id long, offset long, context int, step_group long"


@lru_cache(maxsize=4)
def _ids(path: str, split: Splitter) -> tuple[ByWord, dict[str, bytes], re.Pattern | None]:
    """Little-endian 32-bit ids by word, those of the added tokens, and the pattern that finds these."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {s: b for b, s in enumerate(byte_symbols())}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in added}
    piece = tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
    words = ByWord(split, lambda tokens: b"".join(array("I", piece(t.encode("utf-8"))).tobytes() for t in tokens), 300_000)
    return words, {s: array("I", [i]).tobytes() for s, i in added.items()}, special


def encode(text: str | None, path: str, split: Splitter) -> bytes:
    """The text's ids as little-endian 32-bit numbers; equal to those of the tokenizers library."""
    if not text:
        return b""
    words, added, special = _ids(path, split)
    if special is None or not special.search(text):
        return b"".join(words.parts(text))
    out, at = [], 0
    for m in special.finditer(text):
        out += [*words.parts(text[at : m.start()]), added[m[0]]]
        at = m.end()
    return b"".join([*out, *words.parts(text[at:])])


def cut_points(n: int, tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, int]]:
    """(start, length, tier) of a document's pieces; tier 0 is a filler."""
    fit = [t for t in tiers if t <= n]
    if not fit:
        return [(0, n, 0)]
    tier = fit[-1]
    out = [(i * tier, tier, tier) for i in range(n // tier)]
    return [*out, (n - n % tier, n % tier, 0)] if n % tier else out


def fill_windows(lengths: list[int], size: int) -> list[list[int]]:
    """Windows of at most ``size``, as lists of indices: the longest piece first, then what best fits the gap."""
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], -i))
    keys = [lengths[i] for i in order]
    out = []
    while order:
        window, gap = [order.pop()], size - keys.pop()
        while gap and (k := bisect_right(keys, gap)):
            gap -= keys.pop(k - 1)
            window.append(order.pop(k - 1))
        out.append(window)
    return out


def pack(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, group_docs: int = 2048, step_tokens: int = 65536) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text); one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens (with the closing id 0),
    tier (0: filler), sequence_id, offset, context (the padded size of its
    sequence) and step_group (sequences of one pack group whose padded tokens
    come to about ``step_tokens``).  A null or empty text is the id 0 alone.
    Repeated rows are packed once each.  Other columns are ignored.
    """
    whole_texts(docs.sparkSession)
    longest, split = max(tiers), Splitter.of(path)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                data = encode(text, path, split) + b"\0\0\0\0"
                n = len(data) // 4
                rows += [(doc_id, s, k, zlib.crc32(data[4 * s : 4 * (s + k)]), n, t) for s, k, t in cut_points(n, tiers)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
            yield out.astype({"doc_id": "Int64"})

    def windows(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "start", "length", "ids_crc32"], kind="stable", ignore_index=True)
        filler = np.flatnonzero(part["tier"].to_numpy() == 0)
        lengths = part["length"].to_numpy()
        parts = [[i] for i in np.flatnonzero(part["tier"].to_numpy() != 0)]
        parts += [[int(filler[i]) for i in w] for w in fill_windows(lengths[filler].tolist(), longest)]
        seq, off, ctx = (np.zeros(len(part), "int64") for _ in range(3))
        sizes = []
        for s, window in enumerate(parts):
            at = 0
            for i in window:
                seq[i], off[i] = s, at
                at += int(lengths[i])
            size = at if at & (at - 1) == 0 else longest
            ctx[window] = size
            sizes.append(size)
        # Step groups: each takes sequences of every size in turn until its padded tokens reach the aim.
        sizes = np.array(sizes)
        turn = np.empty(len(sizes))
        for size in np.unique(sizes):
            own = np.flatnonzero(sizes == size)
            turn[own] = (np.arange(len(own)) + 0.5) / len(own)
        order = np.argsort(turn, kind="stable")
        step = np.empty(len(sizes), "int64")
        step[order] = (np.cumsum(sizes[order]) - sizes[order]) // step_tokens
        base = int(key[0]) << 32
        part = part.drop(columns="pack_group")
        return part.assign(sequence_id=base + seq, offset=off, context=ctx.astype("int32"), step_group=base + step[seq])

    groups = max(1, -(-docs.count() // group_docs))
    cut = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInPandas(pieces, PIECES)
    # A document's pieces need not meet: each goes where its own values send it, so a repeated id is spread too.
    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)).alias("pack_group")
    return cut.select("*", group).groupBy("pack_group").applyInPandas(windows, PACKED)
