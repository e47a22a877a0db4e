"""Token counts by heap-and-linked-list byte-pair merging.

Every pre-token starts as its UTF-8 bytes, held in a doubly linked list.  A heap
holds the adjacent pairs that have a merge rank; the lowest rank is popped (the
leftmost pair of equal rank first), stale entries are skipped, and each merge
lowers the count by one.  The count is therefore ``initial symbols - merges``
and no token id is ever emitted.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Splitter:
    r"""The byte-level split ``'s|'t|... ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+`` of a tokenizer file.

    Each field is a regular-expression class body of code points.  They are asked of
    the installed library, as Unicode tables differ between versions.
    """

    letter: str
    number: str
    space: str

    @staticmethod
    @lru_cache(maxsize=4)
    def of(path: str) -> Splitter:
        """Derived on the driver, in a second or two; small enough to go to every task.

        In a string of all code points in order, the library's pre-tokens are runs of
        one class each (the blank, which it joins to what follows, is left out), and
        what a run's first code point stays together with tells its class.
        """
        from tokenizers import Tokenizer

        split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        points = [c for c in range(sys.maxunicode + 1) if c != 0x20 and not 0xD800 <= c < 0xE000]
        bodies = {"a": "", "1": "", "!": "", "": "\\x20"}
        for i in range(0, len(points), 1 << 14):
            part = points[i : i + (1 << 14)]
            for _, (s, e) in split("".join(map(chr, part))):
                alike = next((x for x in "a1!" if len(split(x + chr(part[s]))) == 1), "")
                bodies[alike] += f"\\U{part[s]:08x}-\\U{part[e - 1]:08x}"
        return Splitter(bodies["a"], bodies["1"], bodies[""])

    def __call__(self, text: str) -> list[str]:
        full, fast = _patterns(self)
        return (full if _SUSPECT.search(text) else fast).findall(text)


@lru_cache(maxsize=4)
def _patterns(s: Splitter) -> tuple[re.Pattern, re.Pattern]:
    r"""The split with the classes spelt out, and a faster one with ``\w`` and ``\d``, which holds for
    texts without the characters of ``_SUSPECT``, which these treat otherwise."""
    short = "'s|'t|'re|'ve|'m|'ll|'d"
    full = rf"{short}| ?[{s.letter}]+| ?[{s.number}]+| ?[^{s.space}{s.letter}{s.number}]+|[{s.space}]+(?![^{s.space}])|[{s.space}]+"
    fast = rf"{short}| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+"
    return re.compile(full), re.compile(fast)


_SUSPECT = re.compile(r"[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0300-\U0010ffff]")
_NOT_LONE = re.compile(r" \s|\s |^ | $")


class ByWord(dict):
    """What ``of(split(" " + word))`` gives, for words that a lone space precedes; keeps at most ``bound``.

    A space between two other characters always opens the pre-token that follows
    it, so such a text can be dealt with word by word, and words repeat.
    """

    def __init__(self, split: Splitter, of, bound: int = 600_000):
        super().__init__()
        self.split, self.of, self.bound = split, of, bound

    def __missing__(self, word: str):
        got = self.of(self.split(" " + word))
        if len(word) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[word] = got
        return got

    def parts(self, text: str) -> list:
        """The values of the text's parts, in order."""
        if _NOT_LONE.search(text):
            return [self.of(self.split(text))]
        first, *rest = text.split(" ")
        return [self.of(self.split(first)), *map(self.__getitem__, rest)]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Merge ranks of a byte-level BPE file, by packed pair of symbol numbers."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.first = [vocab[s] for s in byte_symbols()]
        #: left symbol << 20 | right symbol -> rank << 20 | merged symbol
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def count(self, word: str) -> int:
        """Symbols that stay after all merges of one pre-token."""
        sym = [self.first[b] for b in word.encode("utf-8")]
        n = left = len(sym)
        if n < 2:
            return n
        merge = self.merges.get
        # A heap entry holds rank, place and merged symbol; it is stale if its pair now merges to another.
        heap = [(m >> 20) << 52 | i << 20 | m & 0xFFFFF for i, a, b in zip(range(n), sym, sym[1:]) if (m := merge(a << 20 | b)) is not None]
        heapq.heapify(heap)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heapq.heappop(heap)
            i = top >> 20 & 0xFFFFFFFF
            a, j = sym[i], nxt[i]
            if a < 0 or j >= n or (m := merge(a << 20 | sym[j])) is None or m >> 20 != top >> 52:
                continue
            a = sym[i] = top & 0xFFFFF
            sym[j] = -1
            j = nxt[i] = nxt[j]
            left -= 1
            if j < n:
                prv[j] = i
                if (m := merge(a << 20 | sym[j])) is not None:
                    heapq.heappush(heap, (m >> 20) << 52 | i << 20 | m & 0xFFFFF)
            j = prv[i]
            if j >= 0 and (m := merge(sym[j] << 20 | a)) is not None:
                heapq.heappush(heap, (m >> 20) << 52 | j << 20 | m & 0xFFFFF)
        return left


@lru_cache(maxsize=4)
def _worker(path: str, split: Splitter) -> tuple[ByWord, re.Pattern | None]:
    """This Python worker's merge table and the counts of the words that it has met."""
    merges = MergeTable(path)
    count = lru_cache(maxsize=200_000)(merges.count)
    return ByWord(split, lambda tokens: sum(map(count, tokens))), merges.special


def count_text(text: str | None, path: str, split: Splitter) -> int:
    if not text:
        return 0
    words, special = _worker(path, split)
    if special is None or not special.search(text):
        return sum(words.parts(text))
    parts = special.split(text)
    return len(parts) - 1 + sum(sum(words.parts(p)) for p in parts)


def token_count(text: Column, path: str) -> Column:
    split = Splitter.of(path)

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([count_text(t, path, split) for t in texts], dtype="int64")

    return count(text)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as empty (0 bytes, 0 tokens).  Special strings of the
    file count one token each.  Repeated rows give repeated results; other
    columns of the input are ignored.  There is no shuffle: a map over the scan.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count(text, path).alias("n_tokens")
    ).withColumn("over_limit", F.col("n_tokens") > limit)
