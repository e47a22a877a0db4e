"""Alignment of two tokenizers' tokens by lockstep vectorised merging.

Both tokenizers cut the same bytes.  One NumPy state vector holds a pointer into
the A tokens and one into the B tokens of every stretch of a batch of documents;
each step compares the byte ends that they point to, advances whichever lies
behind, and where both end together emits a link and a cut and advances both.
Finished stretches are compacted away.  A stretch is a document or, in long ones,
some hundred tokens of it: a space between two other characters opens a token in
both tokenizers, so that all of them can start there.

How often an id pair is linked is counted over the whole corpus and goes back to
the documents by a join on the pair; the most frequent pairs are sent to all
tasks, up to a bound, and only links of the others are shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelake.llm.common import stored, whole_texts
from probelake.llm.token_counts import Splitter, byte_symbols

#: Pairs of largest counts that are sent to all tasks (about 40 bytes each).
SENT_PAIRS = 1_000_000
DOCS = "_row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>"
_SHARED_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Tokenizers:
    """A (byte-level BPE file) and B (SentencePiece model) by part of text, each as it stands after a space; numbers of parts met and their ids.

    A part is what lies between spaces that other characters stand on both sides of.
    Ids of a part do not depend on what surrounds it: A's split starts anew at such a
    space, and no piece of B goes on past one (else the whole text is one part).
    """

    def __init__(self, a_path: str, b_path: str, split: Splitter, held: int = 400_000):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in added}
        self.a = tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.by_part = not any("▁" in p.lstrip("▁") for p in pieces) and self.b.encode("a  b", out_type=str) == [*self.b.encode("a ", out_type=str), *self.b.encode("b", out_type=str)]
        self.a_size = np.zeros(max(ranks.values()) + 1, np.int32)
        self.a_size[list(ranks.values())] = [len(b) for b in ranks]
        self.b_size = np.array([len(b) for b in self.b_bytes], np.int32)
        self.pair = 1 << (len(self.b_size) - 1).bit_length()
        # Decimal ids with what follows them, as bytes: A's and B's inside a group, then A's last, then B's last.
        self.top = max(len(self.a_size), len(self.b_size))
        shown = [f"{i}{after}".encode() for after in ",|;" for i in range(self.top)]
        self.shown_size = np.array([len(x) for x in shown], np.int32)
        self.shown = np.array(shown).view(np.uint8).reshape(len(shown), -1)
        self.split, self.held = split, held
        self.forget()

    def forget(self) -> None:
        #: Parts between spaces: their number, or -1 if white space is at an edge, so that the text must be cut with more care.
        self.plain = _Numbers(self)
        self.odd: dict[str, int] = {}
        self.new: list[str] = []
        self.known = 0
        self.ids = array("i"), array("i")
        self.count = array("i"), array("i")
        self.same = array("b")

    def number(self, part: str) -> int:
        self.new.append(part)
        self.known += 1
        return self.known - 1

    def encode_new(self) -> None:
        """Ids of the parts that have got a number but no ids."""
        b_bytes = self.b_bytes.__getitem__
        for part, b in zip(self.new, self.b.encode(self.new), strict=True):
            a = [i for t in self.split(" " + part) for i in self.a(t.encode())]
            self.same.append(b"".join(map(b_bytes, b)) == (" " + part).encode())
            for k, ids in enumerate((a, b)):
                self.ids[k].extend(ids)
                self.count[k].append(len(ids))
        self.new = []

    def parts(self, text: str) -> list[int]:
        """Numbers of the parts of a text."""
        if self.by_part:
            found = list(map(self.plain.__getitem__, text.split(" ")))
            if -1 not in found:
                return found
        known = self.odd.get
        out = []
        for part in _SHARED_SPACE.split(text) if self.by_part else [text]:
            n = known(part)
            if n is None:
                n = self.odd[part] = self.number(part)
            out.append(n)
        return out


class _Numbers(dict):
    def __init__(self, owner: Tokenizers):
        super().__init__()
        self.owner = owner

    def __missing__(self, part: str) -> int:
        n = self[part] = self.owner.number(part) if part and not part[0].isspace() and not part[-1].isspace() else -1
        return n


@lru_cache(maxsize=2)
def _worker(a_path: str, b_path: str, split: Splitter) -> Tokenizers:
    return Tokenizers(a_path, b_path, split)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first: tuple[np.ndarray, np.ndarray], last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the A and of the B tokens that end where a token of the other does.

    ``first`` has the first A and B token of every stretch, ``last`` the end of its A
    tokens; A and B of a stretch cover the same bytes, so they finish together.
    """
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    some = first[0] < last
    a, b, last = first[0][some], first[1][some], last[some]
    while len(a):
        at_a, at_b = ends_a[a], ends_b[b]
        together = at_a == at_b
        cut_a[a[together]] = True
        cut_b[b[together]] = True
        a = a + (at_a <= at_b)
        b = b + (at_b <= at_a)
        going = a < last
        if not going.all():
            a, b, last = a[going], b[going], last[going]
    return cut_a, cut_b


def _gather(ids: array, count: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of these parts in order, and how many there are before each part and at the end."""
    begin = np.cumsum(count, dtype=np.int32) - count
    n = count[words]
    upto = np.zeros(len(n) + 1, np.int32)
    np.cumsum(n, out=upto[1:])
    return np.array(ids, np.int32)[np.repeat(begin[words] - upto[:-1], n) + np.arange(upto[-1], dtype=np.int32)], upto


def align(texts: list[str], tok: Tokenizers, lane: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of every text n_a, n_b, n_groups and the groups' digest; and of all linked id pairs the text's number, the pair and how often."""
    if tok.known > tok.held:
        tok.forget()
    per = [tok.parts(t) if t else [] for t in texts]
    tok.encode_new()
    docs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(p) for p in per], out=docs[1:])
    words = np.fromiter(chain.from_iterable(per), np.int32, int(docs[-1]))
    owner = np.repeat(np.arange(len(texts)), np.diff(docs))
    differ = np.zeros(len(texts), bool)
    differ[owner[np.array(tok.same)[words] == 0]] = True
    if differ.any():  # their texts have no tokens
        words, owner = words[~differ[owner]], owner[~differ[owner]]
        docs = np.searchsorted(owner, np.arange(len(texts) + 1))
    (a, upto_a), (b, upto_b) = (_gather(tok.ids[k], np.array(tok.count[k], np.int32), words) for k in (0, 1))
    # Stretches of about ``lane`` tokens, each of whole parts of one text.
    before = upto_a + upto_b
    piece = (before[:-1] - before[docs[owner]]) // lane
    first = np.flatnonzero(np.r_[len(words) > 0, (owner[1:] != owner[:-1]) | (piece[1:] != piece[:-1])])
    last = upto_a[np.r_[first[1:], [len(words)] * (len(first) > 0)].astype(np.int64)]
    cut_a, cut_b = lockstep(np.cumsum(tok.a_size[a], dtype=np.int32), np.cumsum(tok.b_size[b], dtype=np.int32), (upto_a[first], upto_b[first]), last)
    last_a, last_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)

    # Groups as text: a group's A tokens, then its B tokens.  A token comes after all of its own kind before it and the other kind's of earlier (A) or also its own (B) group.
    codes = np.empty(len(a) + len(b), np.int32)
    size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    codes[np.arange(len(a), dtype=np.int32) + np.repeat(np.cumsum(size_b, dtype=np.int32) - size_b.astype(np.int32), size_a)] = a + tok.top * cut_a.astype(np.int32)
    codes[np.arange(len(b), dtype=np.int32) + np.repeat(np.cumsum(size_a, dtype=np.int32), size_b)] = b + 2 * tok.top * cut_b.astype(np.int32)
    sizes = tok.shown_size[codes]
    shown = tok.shown[codes][np.arange(tok.shown.shape[1], dtype=np.int32) < sizes[:, None]].tobytes()
    at_a, at_b = upto_a[docs], upto_b[docs]
    at = np.r_[0, np.cumsum(sizes, dtype=np.int64)][at_a + at_b].tolist()
    digests = [hashlib.sha256(shown[s : e - 1]).hexdigest() if s < e else "" for s, e in zip(at, at[1:])]

    groups = np.searchsorted(last_a, at_a)
    key = np.sort(np.repeat(np.arange(len(texts)), np.diff(groups)) << 44 | a[last_a].astype(np.int64) * tok.pair + b[last_b])
    new = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
    return np.diff(at_a), np.diff(at_b), np.diff(groups), digests, key[new] >> 44, key[new] & ((1 << 44) - 1), np.diff(np.r_[new, len(key)])


def aligned(docs: DataFrame, a_path: str, b_path: str, slice_chars: int = 1 << 21) -> DataFrame:
    """Of every row of ``docs`` (doc_id, text) the columns of ``DOCS``: pairs are the id pairs linked in it, times how often."""
    whole_texts(docs.sparkSession)
    split = Splitter.of(a_path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _worker(a_path, b_path, split)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            size = np.cumsum([len(t) for t in texts])
            start = 0
            while start < len(texts):
                end = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + slice_chars, side="right")))
                n_a, n_b, groups, digests, doc, pair, times = align(texts[start:end], tok)
                at = np.searchsorted(doc, np.arange(end - start + 1)).astype(np.int32)
                own = batch.slice(start, end - start)
                columns = [own.column("_row"), own.column("doc_id"), *(x.astype(np.int64) for x in (n_a, n_b, groups)), pa.array(digests, pa.string()), pa.ListArray.from_arrays(at, pa.array(pair)), pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [c.split()[0] for c in DOCS.split(", ")])
                start = end

    known = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long"), "text")
    return known.mapInArrow(rows, DOCS)


def pair_base(b_path: str) -> int:
    """An id pair is a times this plus b."""
    import sentencepiece

    return 1 << (sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size() - 1).bit_length()


def pair_counts(linked: DataFrame, b_ids: int) -> DataFrame:
    """(pair, n, best): how often each id pair is linked in all of ``linked`` (pair, times), and whether no pair of its B id (pair modulo ``b_ids``) is linked more often."""
    counts = linked.groupBy("pair").agg(F.sum("times").alias("n"))
    # The pairs of one B id are at most as many as A has ids.
    most = counts.groupBy((F.col("pair") % b_ids).alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", F.col("pair") % b_ids).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def link_tokens(docs: DataFrame, a_path: str, b_path: str, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs`` (doc_id, text).

    A encodes a space and the text, B the text, which adds the space; special strings are
    plain text.  A text that is null or empty, or of which either's token bytes differ from
    space and text, has no tokens: zeros and an empty digest.  n_links counts the A and B tokens that
    end together, which is one a group, as no token is empty.  Repeated rows are aligned, and counted, once each; other
    columns are ignored; no rows give no rows.
    """
    found = stored(aligned(docs, a_path, b_path))
    linked = found.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    counts = stored(pair_counts(linked.select("pair", "times"), pair_base(b_path)))
    sizes = {r["k"]: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().collect()}  # at most 64 rows
    least, held = 64, 0
    while least and held + sizes.get(least - 1, 0) <= sent_pairs:
        least -= 1
        held += sizes.get(least, 0)
    frequent = F.floor(F.log2("n")) >= least
    met = linked.join(F.broadcast(counts.where(frequent)), "pair", "left")
    told = met.where("n is not null")
    if least:
        rare = met.where("n is null").select("pair", "_row", "times").join(counts.where(~frequent), "pair")
        told = told.unionByName(rare)
    sums = told.groupBy("_row").agg(F.sum(F.col("n") * F.col("times")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"))
    out = found.select("_row", "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups_sha256").join(sums, "_row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
