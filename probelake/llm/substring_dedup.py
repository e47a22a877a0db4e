"""Repeated-substring removal by hashes of sampled anchors and of their contexts.

A byte goes if it is covered by a ``LENGTH``-byte string that also starts in a
document of a smaller id.  External induced sorting would move a tuple for every
suffix, many times the input (see the README).  Here there is no suffix order,
common-prefix value, recursion or queue: strings are found equal by 128-bit hashes, in
three levels, each of which settles most of what is left:

* Level 1.  Every ``LENGTH``-byte string has an anchor, the place of its least
  ``K``-byte hash.  Equal strings have equal anchors, so strings whose anchor
  occurs in one document only are settled: nothing of them is repeated.
* Level 2.  For the other anchors, the *context* is all bytes of all strings
  with that anchor.  Of equal contexts, all but those of the smallest id are
  settled (they go).  Anchors with one distinct context are settled too.
  Contexts meet by their own hash; each slice tells of an anchor one context and
  how many it has, whence come whether there are several and whether it is *hot*.
* Level 3.  What is left are contexts that differ though their anchors are equal;
  each travels once, and its strings are sorted among those of the same anchor.
  Of hot anchors, strings travel by their own hash instead of contexts by the
  anchor's, so that one phrase amid very many different neighbours is spread.

Documents travel in slices of about 4 MB.  A slice sends each level's keys as
sorted runs, each key once, to buckets, which merge their runs and answer each
with one or two bits per key.  Runs lie on Spark's shuffle disks.  A task holds
a slice, or a bucket: its even share of the keys, besides which a key that a
third of all documents hold comes once per slice (4 to 24 bytes), and at most
``hot`` contexts of any one anchor in level 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelake.llm.common import shuffle_width
from probelake.llm.hashing import U, mix, powers, running

LENGTH, K = 50, 24
SLICE_BYTES, BUCKET_BYTES = 4 << 20, 4 << 20
#: An anchor of more contexts, counted once per slice, has its strings sent apart in level 3.
HOT_CONTEXTS = 4096
NO_ID = np.iinfo("int64").max
SLICE = "slice long, doc_ids array<long>, sizes array<long>, data binary"
RUN = "bucket int, slice long, keys binary"
ANSWER = "slice long, bucket int, bits binary"
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def to_slices(docs: DataFrame) -> DataFrame:
    """(slice, doc_ids, sizes, data): the documents' bytes, deflated, some thousands to a row."""
    import zstandard

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=1).compress
        ids, held, size = [], [], 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame({"slice": [base], "doc_ids": [ids], "sizes": [[len(x) for x in held]], "data": [pack(b"".join(held))]})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                ids.append(None if doc_id is pd.NA else int(doc_id))
                held.append(text.encode("utf-8", "surrogatepass") if text else b"")
                size += len(held[-1])
                if size >= SLICE_BYTES or len(held) >= 20_000:
                    yield flush()
                    base += 1
                    ids, held, size = [], [], 0
        if held:
            yield flush()

    return docs.select("doc_id", "text").mapInPandas(cut, SLICE)


def ranked(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by bucket, and each one's place in it."""
    order = np.argsort(bucket, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return order, place


def bits_of(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


class Slice:
    """A slice's documents, their anchors, and the keys of each level in the order in which they are sent."""

    def __init__(self, doc_ids, sizes, data: bytes, buckets: int):
        import zstandard

        self.buckets = buckets
        self.sizes = np.array(sizes, "int64")
        self.raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=int(self.sizes.sum()) or 1)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.doc_ids = [None if pd.isna(d) else int(d) for d in doc_ids]
        self.ids = np.array([NO_ID if d is None else d for d in self.doc_ids], "int64")
        self.ends = np.cumsum(self.sizes)
        self.run = running(self.data)
        self._anchors()

    def _stretch(self, starts: np.ndarray, ends: np.ndarray, run: np.ndarray | None = None) -> np.ndarray:
        run = self.run if run is None else run
        return (run[ends] - run[starts]) * powers(len(run))[1][starts]

    def _anchors(self) -> None:
        n, width = len(self.data), LENGTH - K + 1
        if n < LENGTH:
            self.pl = self.pr = self.at = self.doc = np.zeros(0, "int64")
            self.hash = np.zeros(0, U)
        else:
            kh = mix((self.run[K:] - self.run[:-K]) * powers(n + 1)[1][: n - K + 1])
            low = U(n.bit_length())
            least = kh >> low << low | np.arange(len(kh), dtype=U)
            span = 1
            while span * 2 <= width:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
            inside = np.zeros(n + 1, "int32")
            long = self.sizes >= LENGTH
            starts = (self.ends - self.sizes)[long]
            np.add.at(inside, starts, 1)
            np.add.at(inside, self.ends[long] - LENGTH + 1, -1)
            p = np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)
            at = (least[p] & U((1 << int(low)) - 1)).astype("int64")
            new = np.ones(len(p), bool)
            new[1:] = (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)
            first = np.flatnonzero(new)
            self.at, self.pl = at[first], p[first]
            self.pr = p[np.r_[first[1:], len(p)] - 1] if len(p) else p
            self.hash = kh[self.at]
            self.doc = np.searchsorted(self.ends, self.pl, side="right")
        # Level 1 keys: a bucket and 32 bits; what two anchors share by chance, level 2 tells apart.
        key = (self.hash >> U(40)) % U(self.buckets) << U(32) | self.hash & U(0xFFFFFFFF)
        self.key1, self.key_of = np.unique(key, return_inverse=True)

    # Each level: the keys to send, by bucket, and what the answers settle.

    def level1(self) -> Iterator[tuple[int, bytes]]:
        bucket = (self.key1 >> U(32)).astype("int64")
        yield from self._by_bucket(bucket, (self.key1 & U(0xFFFFFFFF)).astype("<u4")[:, None].view("u1"))

    def take1(self, elsewhere: np.ndarray) -> None:
        """elsewhere: which level 1 keys other slices have too."""
        pairs = np.unique(self.key_of * len(self.sizes) + self.doc) // max(1, len(self.sizes))
        shared = elsewhere | (np.bincount(pairs, minlength=len(self.key1)) > 1)
        own = np.flatnonzero(shared[self.key_of])
        ctx = mix(self._stretch(self.pl[own], self.pr[own] + LENGTH) + (self.at - self.pl)[own].astype(U) * U(0x9E3779B97F4A7C15) + (self.pr - self.pl)[own].astype(U))
        h, ids = self.hash[own], self.ids[self.doc[own]]
        bucket = (mix(h + ctx) >> U(20)) % U(self.buckets)
        order = np.lexsort((ids, ctx, h, bucket))
        own, h, ctx, ids, bucket = own[order], h[order], ctx[order], ids[order], bucket[order]
        new = np.ones(len(own), bool)
        new[1:] = (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])
        self.own, self.ctx_of = own, np.cumsum(new) - 1
        self.ctx_least = ids[new]
        self.bucket2 = bucket[new].astype("int64")
        self.rows2 = np.stack([h[new], ctx[new], ids[new].view(U)], 1)
        anchor, first, of, n = np.unique(h[new], return_index=True, return_inverse=True, return_counts=True)
        bucket = self._anchor_bucket(anchor) + self.buckets
        order, place = ranked(bucket)
        self.anchor_of, self.bucket_a = place[of], bucket[order]
        self.rows_a = np.stack([anchor, ctx[new][first], n.astype(U)], 1)[order]

    def _anchor_bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> U(20)) % U(self.buckets)).astype("int64")

    def level2(self) -> Iterator[tuple[int, bytes]]:
        """Contexts to buckets below ``buckets``, anchors to those from there on."""
        yield from self._by_bucket(self.bucket2, np.ascontiguousarray(self.rows2).view("u1"))
        yield from self._by_bucket(self.bucket_a, np.ascontiguousarray(self.rows_a).view("u1"))

    def take2(self, gone: np.ndarray, several: np.ndarray, hot: np.ndarray) -> None:
        """gone: contexts that a smaller id has; several, hot: anchors of two or more contexts, of very many."""
        later = self.ids[self.doc[self.own]] > self.ctx_least[self.ctx_of]
        settled = gone[self.ctx_of] | later
        self.whole = self.own[settled]
        # One occurrence of each open context stands for all of the smallest id.
        left = np.flatnonzero(~settled & several[self.anchor_of[self.ctx_of]])
        which, first, of = np.unique(self.ctx_of[left], return_index=True, return_inverse=True)
        bucket = self._anchor_bucket(self.hash[self.own[left[first]]])
        bucket[hot[self.anchor_of[which]]] = self.buckets
        order, place = ranked(bucket)
        which, rep = which[order], self.own[left[first[order]]]
        self.open_h, self.open_ids = self.hash[rep], self.ctx_least[which]
        self.open_from, self.open_n = self.pl[rep], self.pr[rep] - self.pl[rep] + 1
        begin = np.cumsum(self.open_n) - self.open_n
        n = (self.pr - self.pl + 1)[self.own[left]]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.places = np.repeat(self.pl[self.own[left]], n) + within
        self.place_of = np.repeat(begin[place[of]], n) + within
        self.open_bucket = bucket[order][bucket[order] < self.buckets]
        self._hot_strings(len(self.open_bucket))

    def _hot_strings(self, k: int) -> None:
        """The distinct strings of the open contexts from the k-th on, which are those of hot anchors."""
        n = self.open_n[k:]
        at = np.repeat(self.open_from[k:] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        string, h, ids = mix(self._stretch(at, at + LENGTH)), np.repeat(self.open_h[k:], n), np.repeat(self.open_ids[k:], n)
        order, group, least = _first_of([h, string], ids)
        head = order[np.flatnonzero(np.diff(group, prepend=-1))]
        bucket = self._anchor_bucket(string[head]) + self.buckets
        by, place = ranked(bucket)
        self.bucket_s, self.rows_s = bucket[by], np.stack([h[head], string[head], least.view(U)], 1)[by]
        self.string_of, self.string_later = np.zeros(len(at), "int64"), np.zeros(len(at), bool)
        self.string_of[order], self.string_later[order] = place[group], ids[order] > least[group]

    def level3(self) -> Iterator[tuple[int, bytes]]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        edge = np.flatnonzero(np.diff(self.open_bucket, prepend=-1)) if len(self.open_bucket) else self.open_bucket
        for s, e in zip(edge, [*edge[1:], len(self.open_bucket)], strict=False):
            size = self.open_n[s:e] + LENGTH - 1
            at = np.repeat(self.open_from[s:e] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            head = np.array([e - s], "<i8").tobytes() + self.open_h[s:e].tobytes() + self.open_ids[s:e].tobytes() + self.open_n[s:e].astype("<i4").tobytes()
            yield int(self.open_bucket[s]), pack(head + self.data[at].tobytes())
        yield from self._by_bucket(self.bucket_s, np.ascontiguousarray(self.rows_s).view("u1"))

    def take3(self, got: dict[int, bytes]) -> np.ndarray:
        """Which strings of open contexts a smaller id has."""
        n = self.open_n[: len(self.open_bucket)]
        cold = self.answers(got, self.open_bucket, 1, n)[0]
        return np.r_[cold, self.answers(got, self.bucket_s)[0][self.string_of] | self.string_later]

    def kept(self, gone: np.ndarray) -> pd.DataFrame:
        """The documents' results; gone: strings of open contexts that a smaller id has."""
        cover = np.zeros(len(self.data) + 1, "int32")
        np.add.at(cover, self.pl[self.whole], 1)
        np.add.at(cover, self.pr[self.whole] + LENGTH, -1)
        p = self.places[gone[self.place_of]]
        np.add.at(cover, p, 1)
        np.add.at(cover, p + LENGTH, -1)
        covered = np.cumsum(cover)[:-1] > 0
        begins = covered.copy()
        begins[1:] &= ~covered[:-1]
        starts = self.ends - self.sizes
        some = starts[self.sizes > 0]
        begins[some] = covered[some]
        total, firsts = np.r_[0, np.cumsum(covered)], np.r_[0, np.cumsum(begins)]
        out = {"doc_id": pd.array(self.doc_ids, "Int64"), "n_bytes": self.sizes, "n_removed": total[self.ends] - total[starts], "n_spans": firsts[self.ends] - firsts[starts]}
        digests = []
        for s, e, r in zip(starts, self.ends, out["n_removed"], strict=True):
            own = self.data[s:e][~covered[s:e]].tobytes() if r else self.raw[s:e]
            digests.append(hashlib.sha256(own).hexdigest())
        return pd.DataFrame(out | {"kept_sha256": digests})

    def _by_bucket(self, bucket: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
        edge = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else bucket
        for s, e in zip(edge, [*edge[1:], len(bucket)], strict=False):
            yield int(bucket[s]), rows[s:e].tobytes()

    def answers(self, got: dict[int, bytes], bucket: np.ndarray, bits: int = 1, each: np.ndarray | None = None) -> np.ndarray:
        """The flags that the buckets answered, in the order of the keys: bits x keys; ``each``: flags per key."""
        n = np.bincount(bucket, each).astype("int64") if len(bucket) else np.zeros(0, "int64")
        out = []
        for b in np.flatnonzero(n):
            flags = np.unpackbits(np.frombuffer(got[int(b)], np.uint8), count=int(n[b]) * bits).astype(bool)
            out.append(flags.reshape(bits, -1))
        return np.concatenate(out, 1) if out else np.zeros((bits, 0), bool)


def _merge1(blobs: list[bytes]) -> list[np.ndarray]:
    """Which keys are in more than one run."""
    runs = [np.frombuffer(b, "<u4") for b in blobs]
    every, n = np.unique(np.concatenate(runs), return_counts=True)
    twice = every[n > 1]
    return [np.isin(r, twice, assume_unique=True) for r in runs]


def _first_of(columns: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the columns, number of each row's group in it, and each group's smallest id."""
    order = np.lexsort((ids, *columns[::-1]))
    new = np.ones(len(ids), bool)
    new[1:] = reduce(np.logical_or, [c[order][1:] != c[order][:-1] for c in columns])
    return order, np.cumsum(new) - 1, ids[order][new]


def _smaller(blobs: list[bytes]) -> list[np.ndarray]:
    """Per run of contexts or strings, each with its anchor and its smallest id there: which of them a smaller id has."""
    runs = [np.frombuffer(b, U).reshape(-1, 3) for b in blobs]
    rows = np.concatenate(runs)
    ids = np.ascontiguousarray(rows[:, 2]).view("int64")
    order, group, least = _first_of([rows[:, 0], rows[:, 1]], ids)
    gone = np.zeros(len(rows), bool)
    gone[order] = ids[order] > least[group]
    return np.split(gone, np.cumsum([len(r) for r in runs])[:-1])


def _merge_anchors(blobs: list[bytes], hot: int) -> list[np.ndarray]:
    """Per run: which anchors have several contexts, and which more than ``hot``."""
    runs = [np.frombuffer(b, U).reshape(-1, 3) for b in blobs]
    rows = np.concatenate(runs)
    _, first, of = np.unique(rows[:, 0], return_index=True, return_inverse=True)
    unlike = (rows[:, 2] > 1) | (rows[:, 1] != rows[first[of], 1])
    several, many = np.bincount(of, unlike) > 0, np.bincount(of, rows[:, 2].astype(float)) > hot
    cuts = np.cumsum([len(r) for r in runs])[:-1]
    return [np.concatenate(x) for x in zip(np.split(several[of], cuts), np.split(many[of], cuts), strict=True)]


def _merge3(blobs: list[bytes]) -> list[np.ndarray]:
    """Per run: which strings of its contexts a smaller id has."""
    import zstandard

    h, ids, count, texts, sizes = [], [], [], [], []
    for b in blobs:
        raw = zstandard.ZstdDecompressor().decompress(b)
        k = int(np.frombuffer(raw, "<i8", 1)[0])
        h.append(np.frombuffer(raw, U, k, 8))
        ids.append(np.frombuffer(raw, "<i8", k, 8 + 8 * k))
        count.append(np.frombuffer(raw, "<i4", k, 8 + 16 * k).astype("int64"))
        texts.append(np.frombuffer(raw, np.uint8, offset=8 + 20 * k))
        sizes.append(int(count[-1].sum()))
    h, ids, n, data = map(np.concatenate, (h, ids, count, texts))
    size = n + LENGTH - 1
    at = np.repeat(np.cumsum(size) - size - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    run = running(data)
    string = mix((run[at + LENGTH] - run[at]) * powers(len(run))[1][at])
    own = np.repeat(ids, n)
    order, group, least = _first_of([np.repeat(h, n), string], own)
    gone = np.zeros(len(at), bool)
    gone[order] = own[order] > least[group]
    return np.split(gone, np.cumsum(sizes)[:-1])


def remove_repeats(docs: DataFrame, hot: int = HOT_CONTEXTS) -> DataFrame:
    """One row for every row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null counts as empty.  Rows that share an id do not remove each other's
    bytes; a null id counts as larger than all others.  Texts shorter than
    ``LENGTH`` bytes are kept whole.  Other columns are ignored.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, round(size / 14 * 4 / BUCKET_BYTES))
    width = shuffle_width(docs.sparkSession)
    slices = to_slices(docs).repartition(width, "slice")
    view = lambda r: Slice(r.doc_ids, r.sizes, bytes(r.data), buckets)
    dicts = lambda x: {a["bucket"]: bytes(a["bits"]) for a in x} if x is not None else {}

    def replay(r, level: int) -> Slice:
        own = view(r)
        if level >= 1:
            own.take1(own.answers(dicts(r.a1), (own.key1 >> U(32)).astype("int64"))[0])
        if level >= 2:
            got = dicts(r.a2)
            own.take2(own.answers(got, own.bucket2)[0], *own.answers(got, own.bucket_a, 2))
        return own

    def send(level: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples(index=False):
                    own = replay(r, level - 1)
                    rows = [(b, r.slice, k) for b, k in getattr(own, f"level{level}")()]
                    yield pd.DataFrame(rows, columns=["bucket", "slice", "keys"])

        return run

    def merge(of):
        def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("slice", ignore_index=True)
            flags = of(key[0], [bytes(k) for k in part["keys"]])
            return pd.DataFrame({"slice": part["slice"], "bucket": part["bucket"], "bits": [bits_of(f) for f in flags]})

        return run

    def answered(with_slices: DataFrame, level: int, of) -> DataFrame:
        back = with_slices.mapInPandas(send(level), RUN).groupBy("bucket").applyInPandas(merge(of), ANSWER)
        return back.groupBy("slice").agg(F.collect_list(F.struct("bucket", "bits")).alias(f"a{level}"))

    def result(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                own = replay(r, 2)
                yield own.kept(own.take3(dicts(r.a3)))

    keys = lambda bucket, runs: _merge1(runs)
    contexts = lambda bucket, runs: _smaller(runs) if bucket < buckets else _merge_anchors(runs, hot)
    strings = lambda bucket, runs: _merge3(runs) if bucket < buckets else _smaller(runs)
    one = slices.join(answered(slices, 1, keys), "slice", "left")
    two = one.join(answered(one, 2, contexts), "slice", "left")
    three = two.join(answered(two, 3, strings), "slice", "left")
    return three.mapInPandas(result, KEPT)
