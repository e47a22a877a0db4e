"""Spelling variants by dense prefix-suffix tiling.

Two words are near if one code point inserted, deleted or replaced turns one into
the other, which is so if the lengths of their common prefix and common suffix
reach the longer word's length minus one.  So one of the two reaches half of that,
and words meet in the bucket of that half: of its prefix, or of its suffix.  A
bucket's words are padded matrices of code points, which are compared tile by
tile.  A bucket of more than ``limit`` words is dealt out again by the place of the
edit and all that stands around it; such a bucket holds one word for each letter
and one that is shorter.  No pair leaves its task: a bucket returns for each word
how many near words it has there and the best of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.llm.common import shuffle_width, stored, whole_texts
from probelake.llm.hashing import mix, running, runs, stretches

LEAST_LETTERS, LEAST_COUNT, DAMAGE = 5, 3, 97
#: Runs of more letters than this are dealt with one by one.
PACKED_LETTERS = 16
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


def _crc_step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return _CRC[(state ^ byte) & np.uint32(0xFF)] ^ (state >> np.uint32(8))


def crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of the UTF-8 of each stretch of Latin-1 code points, going on from the checksum of what stands before it.

    All stretches advance together; the longest come first, so those still going are a prefix.
    """
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    state = before[order] ^ np.uint32(0xFFFFFFFF)
    going = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")
    for i, n in enumerate(going):
        c = data[at[:n] + i].astype(np.uint32)
        wide = np.flatnonzero(c >= 0x80)
        state[wide] = _crc_step(state[wide], np.uint32(0xC3))
        c[wide] -= np.uint32(0x40)
        state[:n] = _crc_step(state[:n], c)
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _damaged(word: bytes, h: int) -> bytes:
    i = h % len(word)
    return word[:i] + word[i + 1 :]


def count_words(ids: list, texts: list[str], into: dict[bytes, int]) -> None:
    """Adds the words of some texts, in Latin-1: runs of letters, ASCII in lower case, one in 97 damaged by its checksum."""
    prefixes = [zlib.crc32(b"%s:" % ("" if i is None else str(i)).encode()) for i in ids]
    parts = [t.encode("latin-1", "replace") for t in texts]  # a byte for every code point
    data = _LOWER[np.frombuffer(b"\n".join([*parts, b""]), np.uint8)]
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts, stops = runs(_LETTER[data])
    # A shorter run cannot become a word.
    long_enough = stops - starts >= LEAST_LETTERS
    starts, stops = starts[long_enough], stops[long_enough]
    length = stops - starts
    before = np.array(prefixes, np.uint32)[np.searchsorted(ends, starts, side="right")]

    def add(word: bytes, h: int) -> None:
        word = word if h % DAMAGE else _damaged(word, h)
        if len(word) >= LEAST_LETTERS:
            into[word] = into.get(word, 0) + 1

    short = length <= PACKED_LETTERS
    for i in np.flatnonzero(~short):
        word = data[starts[i] : stops[i]].tobytes()
        add(word, zlib.crc32(word.decode("latin-1").encode(), int(before[i])))
    starts, stops, length, before = starts[short], stops[short], length[short], before[short]
    h = crcs(data, starts, length, before)
    hit = h % np.uint32(DAMAGE) == 0
    for i in np.flatnonzero(hit):
        add(data[starts[i] : stops[i]].tobytes(), int(h[i]))
    starts, stops = starts[~hit], stops[~hit]
    # Equal runs come together by their hash and are told apart by their letters.
    order = np.argsort(mix(stretches(running(data), starts, stops) ^ (stops - starts).astype(np.uint64)), kind="stable")
    starts, stops = starts[order], stops[order]
    if not len(starts):
        return
    padded = np.r_[data, np.zeros(PACKED_LETTERS, np.uint8)]
    letters = np.zeros((len(starts), PACKED_LETTERS), np.uint8)
    for j in range(PACKED_LETTERS):
        letters[:, j] = padded[starts + j] * (starts + j < stops)
    wide = letters.view(np.uint64)
    new = np.r_[True, (wide[1:] != wide[:-1]).any(axis=1)]
    first = np.flatnonzero(new)
    get = into.get
    for word, k in zip(letters[first].view(f"S{PACKED_LETTERS}").ravel().tolist(), np.diff(np.r_[first, len(starts)]).tolist(), strict=True):
        into[word] = get(word, 0) + k


def word_counts(docs: DataFrame, slice_chars: int = 1 << 22, held_words: int = 400_000) -> DataFrame:
    """(word, n) of the words with at least 5 letters that occur at least 3 times in ``docs`` (doc_id, text).

    A null text has no words and a null doc_id is an empty string before the colon.  Each task adds up its own counts and lets go of them
    beyond ``held_words``, so a word's rows are few even where it is very frequent.
    """
    whole_texts(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, int] = {}
        told = lambda: pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": np.fromiter(held.values(), "int64", len(held))})
        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch["id"], batch["text"], strict=True):
                ids.append(i)
                texts.append(t or "")
                size += len(texts[-1])
                if size >= slice_chars:
                    count_words(ids, texts, held)
                    ids, texts, size = [], [], 0
            if ids:
                count_words(ids, texts, held)
            if len(held) > held_words:
                yield told()
                held.clear()
        if held:
            yield told()

    part = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(count, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _keys() -> Column:
    """The four buckets of a word: as the longer of two and as the shorter, by prefix and by suffix."""
    size, word = F.char_length("word"), F.col("word")

    def two(n: Column) -> list[Column]:
        half = F.floor(n / 2).cast("int")  # the least that reaches half of n - 1
        return [
            F.struct(n.alias("longer"), half.alias("lo"), n.alias("hi"), F.concat_ws(":", n, F.lit("p"), F.substring(word, F.lit(1), half)).alias("key")),
            F.struct(n.alias("longer"), F.lit(0).alias("lo"), (half - 1).alias("hi"), F.concat_ws(":", n, F.lit("s"), F.substring(word, size - half + 1, half)).alias("key")),
        ]

    return F.array(*two(size), *two(size + 1))


def _places() -> Column:
    """The finer buckets of a word in a large one: all of it but one place, for every place where the edit may be."""
    last = F.least(F.col("hi"), F.col("longer") - 1)
    word = F.col("word")

    def one(i: Column) -> Column:
        rest = F.when(F.char_length(word) == F.col("longer"), F.concat(F.substring(word, F.lit(1), i), F.substring(word, i + 2, F.col("longer")))).otherwise(word)
        return F.struct(F.col("longer").alias("longer"), i.alias("lo"), i.alias("hi"), F.concat_ws(":", F.col("longer"), i, rest).alias("key"))

    return F.transform(F.sequence(F.col("lo"), last), one)


def _matrices(words: np.ndarray, size: np.ndarray, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Code points of words of ``width`` letters or one fewer, a row each, left- and right-aligned; once padded with 0 and once with 1, so that paddings are never equal."""
    left = np.array([w.encode("latin-1") for w in words], f"S{width}").view(np.uint8).reshape(len(words), width)
    short = np.flatnonzero(size < width)
    right = left.copy()
    right[short, 1:], right[short, 0] = left[short, :-1], 0
    other = left.copy(), right.copy()
    other[0][short, -1] = other[1][short, 0] = 1
    return [left, right], list(other)


def _common(a: np.ndarray, b: np.ndarray, places: Iterator[int]) -> np.ndarray:
    """How many of these columns are equal before the first that is not."""
    alive = np.ones(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), bool)
    n = np.zeros(alive.shape, np.int32)
    for j in places:
        alive &= a[..., j] == b[..., j]
        n += alive
    return n


class _Class:
    """The words of one length class in a task, sorted by bucket, then the best first: matrices and results."""

    def __init__(self, part: pd.DataFrame, longer: int):
        words = part["word"].to_numpy()
        self.n = longer
        self.size = np.array([len(w) for w in words])
        self.a, self.b = _matrices(words, self.size, longer)
        self.lo, self.hi = part["lo"].to_numpy(), part["hi"].to_numpy()
        self.near = np.zeros(len(part), np.int64)
        self.best = np.full(len(part), len(part))

    def close(self, i, j) -> np.ndarray:
        """Which of these pairs of rows are near and this bucket's to report."""
        prefix = _common(self.a[0][i], self.b[0][j], range(self.n))
        suffix = _common(self.a[1][i], self.b[1][j], range(self.n - 1, -1, -1))
        place = np.minimum(prefix, self.n - 1)
        longer = np.maximum(self.size[i], self.size[j])
        return (longer == self.n) & (prefix + suffix >= self.n - 1) & (place >= self.lo[i]) & (place <= self.hi[i])

    def small(self, bucket: np.ndarray, last: np.ndarray) -> None:
        """All buckets of a few words at once: every row with the one ``step`` rows on, as long as that is in its bucket."""
        rows = bucket
        step = 1
        while len(rows := rows[rows + step < last[rows]]):
            i, j = rows, rows + step
            found = self.close(i, j)
            i, j = i[found], j[found]
            np.add.at(self.near, i, 1)
            np.add.at(self.near, j, 1)
            np.minimum.at(self.best, i, j)
            np.minimum.at(self.best, j, i)
            step += 1

    def tile(self, start: int, stop: int, block: int = 256) -> None:
        """One bucket, block against block."""
        every = np.arange(start, stop)
        for s in range(start, stop, block):
            rows = np.arange(s, min(stop, s + block))
            for t in range(start, stop, block):
                cols = every[t - start : t - start + block]
                found = self.close(rows[:, None], cols[None, :]) & (rows[:, None] != cols[None, :])
                self.near[rows] += found.sum(axis=1)
                some = found.any(axis=1)
                np.minimum.at(self.best, rows[some], cols[found[some].argmax(axis=1)])


NEAR = "word string, n_near long, form_n long, form string"


def compare(part: pd.DataFrame, dense: int = 24) -> pd.DataFrame:
    """For each word of whole buckets (word, n, longer, lo, hi, key) with near words there: their number and the best."""
    out = []
    part = part.sort_values(["longer", "key", "n", "word"], ascending=[True, True, False, True], ignore_index=True)
    for longer, own in part.groupby("longer", sort=False):
        own = own.reset_index(drop=True)
        key = own["key"].to_numpy()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[first, len(own)])
        c = _Class(own, int(longer))
        last = np.repeat(first + sizes, sizes)
        c.small(np.flatnonzero(np.repeat(sizes <= dense, sizes)), last)
        for s, n in zip(first[sizes > dense], sizes[sizes > dense], strict=True):
            c.tile(int(s), int(s + n))
        some = np.flatnonzero(c.near)
        best = c.best[some]
        out.append(pd.DataFrame({"word": own["word"].to_numpy()[some], "n_near": c.near[some], "form_n": own["n"].to_numpy()[best], "form": own["word"].to_numpy()[best]}))
    return pd.concat(out, ignore_index=True)  # no group of rows is empty


def near_words(words: DataFrame, limit: int = 2048, task_rows: int = 20_000) -> DataFrame:
    """(word, n_near, form_n, form) of every word of ``words`` (word, n; distinct) that has near words: their number and the one of largest n, ties in code-point order."""
    rows = words.select("word", "n", F.explode(_keys()).alias("k")).select("word", "n", "k.*")
    large = rows.groupBy("key").count().where(F.col("count") > limit).select("key", F.lit(True).alias("large"))
    told = stored(rows.join(large, "key", "left"))
    fine = told.where("large").select("word", "n", F.explode(_places()).alias("k")).select("word", "n", "k.*")
    dealt = told.where("large is null").select("word", "n", "longer", "lo", "hi", "key").unionByName(fine)
    tasks = max(shuffle_width(words.sparkSession), -(-told.count() // task_rows))
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks)))
    found = dealt.groupBy("task").applyInPandas(lambda part: compare(part.drop(columns="task")), NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    out = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return out.select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word of ``forms`` (word, form): the end of its chain, by doubling.  A form's n is at least twice the word's, so no chain is long."""
    links = stored(forms.select("word", F.col("form").alias("root")))
    for _ in range(64):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return links
    raise RuntimeError("a chain of forms does not end")


def variants(docs: DataFrame, limit: int = 2048) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of ``docs`` (doc_id, text).

    Words are maximal runs of ASCII and Latin-1 letters (U+00C0 to U+00FF, the two signs among
    them too) with A-Z in lower case, 5 letters or more, that occur 3 times or more; one run in 97, by
    the checksum of its document's id and itself, loses a letter first.  form is the near word of
    largest n (ties: the smallest in code-point order) if its n is at least twice the word's, else
    null, as is form_n; root is the last of the chain of forms, or the word itself.  Null and empty texts have no
    words; repeated rows count as often as they stand there; other columns are ignored; no rows
    give no rows.
    """
    words = stored(word_counts(docs))
    near = near_words(words, limit)
    strong = F.col("form_n") >= 2 * F.col("n")
    known = stored(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n")))
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
