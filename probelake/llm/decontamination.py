"""Benchmark decontamination by template canonicalisation.

A text becomes a template: letters in lower case, every number one <number>
(separators included, so 1,000 and 1,500 are two values), a unit after a number one <unit>, a capitalised word inside a sentence one
<name>; marks are left out.  Windows of a benchmark item's tokens, as template
(a run of names is one) and as they stand, are looked up in every document's.  They
are so short that no edits which leave the item covered can break them all.  A hit
fixes how item and document lie on each other; around it, in a band of a quarter of
the item, the whole texts are aligned with insertions and deletions.  Covered are
tokens that stand as they are, and slots that are consistent: one value of the item
stands for one value of the document, and where it stands for several, the most
frequent counts and the others are mismatches.  So verbatim and edited passages are found, and questions with other numbers, names or
units.

The windows of a benchmark whose text is within ``INDEX_BYTES`` (Spark sums its
bytes first) are hashed once and sent to every task, so documents are not
shuffled.  Those of a larger one are joined in Spark by their hashes, and each
pair of a document and an item that share a window is then compared in a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probelake.llm.common import cut, packed, unpacked, whole_texts
from probelake.llm.hashing import U, joined, lower, mix, running, runs, slices, stretches

#: The longest window that is looked up, and the furthest that an alignment may drift.
WINDOW, BAND, COVERAGE = 8, 256, 0.8
#: Words other than slots that an item needs to be looked for inside sentences; with fewer it must be whole sentences or lines, word for word.
LITERALS = 3
#: Benchmark text that may be sent to every task (some 40 bytes of index for each of its words).
INDEX_BYTES = 4 << 20
#: Parts that the documents of one window are spread over, as a third of all may hold it.
SALTS = 16
# Words that are units when a number precedes them.
UNITS = """
    mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs pound
    pounds oz ounce ounces ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days
    week weeks month months year years dollar dollars cent cents euro euros percent degree degrees volt volts watt watts
    ampere amperes joule joules newton newtons hz khz mhz ghz byte bytes kb mb gb tb mph kmh
""".split()
NUMBER, NAME, UNIT = U(1), U(2), U(3)

_CLASS = np.zeros(256, "uint8")  # 1: letter, 2: digit
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_INSIDE = np.zeros(256, bool)
_INSIDE[[*b".,"]] = True
_STOP = np.zeros(256, bool)
_STOP[[*b".!?:\n"]] = True


class Template:
    """Tokens of some texts: template codes, hashes of the words as they stand, and the text of each."""

    def __init__(self, parts: list[bytes]):
        data, ends = joined(parts)
        kind = _CLASS[data]
        low = lower(data)
        run = running(low)
        s1, e1 = runs(kind == 1)
        s2, e2 = runs(kind == 2)
        starts, stops = np.r_[s1, s2], np.r_[e1, e2]
        digit = np.r_[np.zeros(len(s1), bool), np.ones(len(s2), bool)]
        order = np.argsort(starts, kind="stable")
        starts, stops, digit = starts[order], stops[order], digit[order]
        raw = mix(stretches(run, starts, stops) ^ (stops - starts).astype(U)) | U(4)
        part = np.searchsorted(ends, starts, side="right")
        same = np.zeros(len(starts), bool)
        same[1:] = part[1:] == part[:-1]
        after = np.zeros(len(starts), bool)  # the token before is a number of the same text
        after[1:] = digit[:-1]
        after &= same
        unit = after & ~digit & np.isin(raw, _unit_hashes())
        # A name: a capital, then no other capital, and no sentence begins here.
        code = np.where(digit, NUMBER, np.where(unit, UNIT, raw))
        up = (data >= 65) & (data <= 90)
        up[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        total = np.r_[0, np.cumsum(up)]
        capital = up[starts] | ((data[starts] == 0xC3) & up[np.minimum(starts + 1, len(data) - 1)])
        one = (total[stops] - total[starts] == 1) & capital & ~digit
        stop = np.r_[0, np.cumsum(_STOP[data])]
        before = np.r_[0, stops[:-1]] if len(stops) else stops
        inside = same & (stop[starts] == stop[before])
        code = np.where(one & inside & ~unit, NAME, code)
        # 3.14 or 1,000: one number, whose value is all of it.
        keep = np.ones(len(starts), bool)
        keep[1:] = ~(digit[1:] & after[1:] & (starts[1:] == stops[:-1] + 1) & _INSIDE[data[np.minimum(stops[:-1], len(data) - 1)]])
        if not keep.all():
            whole = np.maximum.reduceat(stops, np.flatnonzero(keep))
            number = mix(stretches(run, starts[keep], whole) ^ (whole - starts[keep]).astype(U)) | U(4)
            raw[keep] = np.where(digit[keep], number, raw[keep])
        self.code, self.raw, self.part = code[keep], raw[keep], part[keep]
        # Tokens that begin a sentence, line or text, and those that end one.
        self.opens = ~inside[keep]
        self.closes = np.r_[self.opens[1:], np.ones(min(1, len(self.opens)), bool)]
        self.count = np.bincount(self.part, minlength=len(parts))
        self.first = np.cumsum(self.count) - self.count
        # Names with one byte between them are one: its tokens share a run and a value.
        name = self.code == NAME
        again = np.zeros(len(self.code), bool)
        again[1:] = name[1:] & name[:-1] & (self.part[1:] == self.part[:-1]) & (starts[keep][1:] == stops[keep][:-1] + 1)
        self.head = np.flatnonzero(~again)
        self.run = np.cumsum(~again) - 1
        self.value = self.raw
        if again.any():
            place = np.arange(len(self.code)) - self.head[self.run]
            whole = np.add.reduceat(mix(self.raw + place.astype(U)), self.head)
            self.value = np.where(name, whole[self.run], self.raw)
        self.heads = np.bincount(self.part[self.head], minlength=len(parts))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of ``size`` tokens that lie in one text, and where they start.

        Those of the template with a run of names as one; then those of the words as
        they stand, where a slot makes them others.  Of a negative size: windows of that
        many words as they stand, from the beginning of a sentence or line to the end of one.
        """
        if size < 0:
            h, at = _windows_of(self.raw, self.part, -size)
            whole = self.opens[at] & self.closes[at - size - 1]
            return h[whole], at[whole]
        h1, at1 = _windows_of(self.code[self.head], self.part[self.head], size)
        h2, at2 = _windows_of(self.raw, self.part, size)
        bare = np.r_[0, np.cumsum(self.code[self.head] < U(4))]
        some = bare[at1 + size] - bare[at1] < size  # windows of nothing but slots are everywhere
        h1, at1 = h1[some], at1[some]
        slots = np.r_[0, np.cumsum(self.code < U(4))]
        other = slots[at2 + size] > slots[at2]
        return np.r_[h1, h2[other]], np.r_[self.head[at1], at2[other]]


def _windows_of(code: np.ndarray, part: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, "int64")
    h = np.zeros(n, U)
    for k in range(size):
        h = h * U(0xD1342543DE82EF95) + code[k : k + n]
    at = np.flatnonzero(part[:n] == part[size - 1 :])
    return mix(h[at]), at


def window_sizes(t: Template, coverage: float) -> np.ndarray:
    """For each text the size of the windows to look up; the negative of all its words for one of fewer than ``LITERALS``
    words that are not slots, as such an item ("42", "Yes") stands in sentences of any kind.

    Of n tokens, k edits that leave ``coverage`` keep n - k in at most k + 1 runs,
    so one run has at least (n - k) / (k + 1).
    """
    def size(n: np.ndarray) -> np.ndarray:
        k = np.floor((1 - coverage) * n + 1e-9).astype("int64")
        return -(-(n - k) // (k + 1))

    literals = np.bincount(t.part[t.code >= U(4)], minlength=len(t.count))
    return np.where(literals < LITERALS, -t.count, np.minimum(WINDOW, np.minimum(size(t.count), size(t.heads))))


def _unit_hashes() -> np.ndarray:
    data, ends = joined([u.encode() for u in UNITS])
    starts = np.r_[0, ends[:-1]]
    return mix(stretches(running(data), starts, ends - 1) ^ (ends - 1 - starts).astype(U)) | U(4)


class Index:
    """The windows of benchmark items, each item's of its own size; empty ones have none."""

    def __init__(self, ids: Sequence[int | None], texts: Sequence[str | None], coverage: float = COVERAGE):
        self.ids, self.coverage = list(ids), coverage
        self.template = Template([(t or "").encode("utf-8", "surrogatepass") for t in texts])
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        wanted = window_sizes(self.template, coverage)
        #: Whether an item is found only whole.
        self.whole = wanted < 0
        for size in sorted({int(c) for c in wanted if c}):
            h, at = self.template.windows(size)
            fits = wanted[self.template.part[at]] == size
            order = np.argsort(h[fits], kind="stable")
            self.by_size[size] = h[fits][order], at[fits][order]

    def search(self, parts: list[bytes]) -> list[list[tuple[int, float, bool]]]:
        """Of ``leaks`` the items none of whose values stands for two values of the text."""
        return [[(k, c, v) for k, c, v, agree in f if agree] for f in self.leaks(parts)]

    def leaks(self, parts: list[bytes]) -> list[list[tuple[int, float, bool, bool]]]:
        """For each text (item, coverage, verbatim, whether all slots agree) of the items that it holds, best first."""
        doc, bench = Template(parts), self.template
        found: list[dict[int, tuple[float, bool, bool]]] = [{} for _ in parts]
        hits = []
        for size, (hashes, places) in self.by_size.items():
            h, at = doc.windows(size)
            lo = np.searchsorted(hashes, h)
            lo = np.minimum(lo, len(hashes) - 1)
            hit = np.flatnonzero(hashes[lo] == h)
            if not len(hit):
                continue
            lo = lo[hit]
            n = np.searchsorted(hashes, h[hit], side="right") - lo
            d = np.repeat(at[hit], n)
            b = places[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            item = bench.part[b]
            start = d - (b - bench.first[item])  # where the item's first token would lie
            hits.append(np.stack([doc.part[d], item, start], 1))
        if not hits:
            return [[] for _ in parts]
        every = np.concatenate(hits)
        every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
        edge = np.r_[np.flatnonzero(new), len(every)]
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            x, k = int(every[s, 0]), int(every[s, 1])
            band, starts = self._band(k), every[s:e, 2]
            at = 0
            while at < len(starts):  # starts within a band of each other are one alignment
                end = int(np.searchsorted(starts, starts[at] + band, side="right"))
                got = self._compare(doc, x, k, int(starts[at]) - band, int(starts[end - 1]) + band)
                if got and got > found[x].get(k, (0.0, False, False)):
                    found[x][k] = got
                at = end
        return [sorted(((k, *r) for k, r in f.items()), key=lambda r: (-r[1], r[0])) for f in found]

    def _band(self, item: int) -> int:
        return min(BAND, max(2, int(self.template.count[item]) // 4))

    def _compare(self, doc: Template, part: int, item: int, low: int, high: int) -> tuple[float, bool, bool] | None:
        """Coverage of the item, whether it is verbatim and whether all slots agree, if its first token lies
        from ``low`` to ``high``; None below the index's coverage."""
        bench, n, width = self.template, int(self.template.count[item]), high - low + 1
        own = slice(int(bench.first[item]), int(bench.first[item]) + n)
        begin, stop = int(doc.first[part]), int(doc.first[part] + doc.count[part])
        lo, hi = max(low, begin), min(high + n, stop)
        braw, bcode, slot = bench.raw[own], bench.code[own], bench.code[own] < U(4)
        here = np.isin(braw, doc.raw[lo:hi]) | (slot & np.isin(bcode, doc.code[lo:hi]))
        if here.sum() < self.coverage * n:
            return None
        # Row: token of the item; column: place of its first token.  No token of the document has code or hash 0.
        raw, code = np.zeros(n + width - 1, U), np.zeros(n + width - 1, U)
        raw[lo - low : hi - low], code[lo - low : hi - low] = doc.raw[lo:hi], doc.code[lo:hi]
        same = np.lib.stride_tricks.sliding_window_view(raw, width) == braw[:, None]
        if same.all(axis=0).any():
            return 1.0, True, True
        alike = same | (slot[:, None] & (np.lib.stride_tricks.sliding_window_view(code, width) == bcode[:, None]))
        column = int(alike.sum(axis=0).argmax())
        straight = np.flatnonzero(alike[:, column])
        ways = [self._covered(doc, item, straight, straight + low + column), self._covered(doc, item, *_aligned(alike, same, low))]
        best, agree = max(ways)
        return (best, False, agree) if best >= self.coverage else None

    def _covered(self, doc: Template, item: int, mine: np.ndarray, theirs: np.ndarray) -> tuple[float, bool]:
        """The share of an item's tokens that stand in the document, and whether all slots agree, from pairs of places."""
        bench, n = self.template, int(self.template.count[item])
        held = mine + bench.first[item]
        same = bench.raw[held] == doc.raw[theirs]
        slot = (bench.code[held] < U(4)) & (bench.code[held] == doc.code[theirs])
        slot &= ~same | (bench.value[held] == doc.value[theirs])  # a word of a longer name stands for itself
        pairs, of, often = np.unique(np.stack([bench.value[held[slot]], doc.value[theirs[slot]]], 1), axis=0, return_inverse=True, return_counts=True)
        order = np.lexsort((-often, pairs[:, 0]))
        chosen = np.zeros(len(pairs), bool)
        chosen[order] = np.diff(pairs[order, 0], prepend=U(0)) != 0
        fits = slot.copy()
        fits[slot] = chosen[of.ravel()]
        covered = np.zeros(n, bool)
        covered[mine[same | fits]] = True
        own = slice(int(bench.first[item]), int(bench.first[item]) + n)
        covered |= (bench.code[own] == NAME) & np.isin(bench.run[own], bench.run[held[fits]])  # a name of more or fewer words
        return float(covered.sum() / n), bool(chosen.all())


def _aligned(alike: np.ndarray, same: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an item's and a document's places: as many as can be alike in order, of these as many as can be the same."""
    n, width = alike.shape
    weight = alike * np.int64(n + 1) + same
    best = np.zeros((n + 1, width), "int64")
    for i in range(n):
        row = best[i] + weight[i]
        np.maximum(row[:-1], best[i, 1:], out=row[:-1])  # the item's token is left out
        np.maximum.accumulate(row, out=best[i + 1])  # the document's are
    mine, theirs, i, c = [], [], n, width - 1
    while i:
        value = best[i, c]
        if weight[i - 1, c] and value == best[i - 1, c] + weight[i - 1, c]:
            i -= 1
            mine.append(i)
            theirs.append(low + i + c)
        elif c and value == best[i, c - 1]:
            c -= 1
        elif c + 1 < width and value == best[i - 1, c + 1]:
            i, c = i - 1, c + 1
        else:
            i -= 1
    return np.array(mine, "int64"), np.array(theirs, "int64")


FOUND = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("verbatim", T.BooleanType()), T.StructField("whole", T.BooleanType()), T.StructField("lone", T.BooleanType())]))


def _sent(docs: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    """``all_leaks`` for items that one index may hold."""
    rows = items.orderBy("item_id", "text").collect()  # at most INDEX_BYTES of text
    shared = docs.sparkSession.sparkContext.broadcast(Index([r["item_id"] for r in rows], [r["text"] for r in rows], coverage))

    @F.pandas_udf(FOUND)
    def search(texts: pd.Series) -> pd.Series:
        own, out = shared.value, []
        for _, parts in slices(texts.tolist()):
            out += [[{"item_id": own.ids[k], "coverage": c, "verbatim": v, "whole": bool(own.whole[k]), "lone": bool(own.template.count[k] == 1)} for k, c, v, _ in f] for f in own.leaks(parts)]
        return pd.Series(out)

    return packed(docs).withColumn("_leaks", search("_doc.text"))


def _windows(texts: DataFrame, key: str, sizes: Sequence[int], coverage: float | None = None) -> DataFrame:
    """(key, size, hash) of the distinct windows of every text: of each size, or of an item's own size for ``coverage``."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch[key].to_numpy()
            for first, parts in slices(batch["text"].tolist()):
                t = Template(parts)
                for size in sizes:
                    h, at = t.windows(size)
                    if coverage is not None:
                        fits = window_sizes(t, coverage)[t.part[at]] == size
                        h, at = h[fits], at[fits]
                    out = pd.DataFrame({key: keys[first + t.part[at]], "size": np.int32(size), "hash": h.view("int64")})
                    yield out.drop_duplicates()

    return texts.select(key, "text").mapInPandas(cut_up, f"{key} {texts.schema[key].dataType.simpleString()}, size int, hash long")


def _joined(docs: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    """``all_leaks`` for items of any number, by a hash join of windows.

    A text has the key of its id and content, so that copies are spread.  The
    documents of a window are salted; its items, far fewer, go to every salt.
    """
    items = cut(items.where("text is not null").select(F.monotonically_increasing_id().alias("_item"), "item_id", "text"))

    @F.pandas_udf(T.IntegerType())
    def window_size(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([window_sizes(Template(parts), coverage) for _, parts in slices(texts.tolist())] or [np.zeros(0, "int64")]))

    sizes = sorted(r[0] for r in items.select(window_size("text")).distinct().collect() if r[0])  # at most WINDOW values
    id_text = F.coalesce(F.col("_doc.doc_id").cast("string"), F.lit("null"))
    keyed = packed(docs).withColumn("_key", F.unhex(F.sha2(F.concat(id_text, F.lit(":"), F.coalesce("_doc.text", F.lit(""))), 256)))
    texts = keyed.select("_key", F.coalesce("_doc.text", F.lit("")).alias("text"))
    salt = F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int").alias("salt")
    wanted = _windows(items, "_item", sizes, coverage).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = _windows(texts, "_key", sizes).select("*", salt).join(wanted, ["size", "hash", "salt"]).select("_key", "_item").distinct()
    passages = items.select("_item", "item_id", F.col("text").alias("_passage"))
    meeting = pairs.join(passages, "_item").join(texts, "_key").select("_key", "item_id", "_passage", "text")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, item_id, passage, text in zip(batch["_key"], batch["item_id"].astype("Int64"), batch["_passage"], batch["text"], strict=True):
                index = Index([item_id], [passage], coverage)
                rows += [(key, item_id, c, v, bool(index.whole[0]), bool(index.template.count[0] == 1)) for _, c, v, _ in index.leaks([text.encode("utf-8", "surrogatepass")])[0]]
            yield pd.DataFrame(rows, columns=["_key", "item_id", "coverage", "verbatim", "whole", "lone"]).astype({"item_id": "Int64"})

    found = meeting.mapInPandas(compare, "_key binary, item_id long, coverage double, verbatim boolean, whole boolean, lone boolean")
    found = found.groupBy("_key").agg(F.collect_set(F.struct("item_id", "coverage", "verbatim", "whole", "lone")).alias("_found"))
    return keyed.join(found, "_key", "left").select("_doc", F.coalesce("_found", F.array().cast(FOUND)).alias("_leaks"))


def all_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(_doc, _leaks): whole rows, and the items of the whole benchmark that each one's text holds to at least ``coverage``."""
    whole_texts(docs.sparkSession)
    items = benchmark.select("item_id", "text")
    size = items.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    return (_sent if size <= index_bytes else _joined)(docs, items, coverage)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row for every row of ``docs`` (doc_id, text): doc_id, contaminated, item_ids, coverage, verbatim, whole_ids.

    Items of fewer than ``LITERALS`` words besides slots are held only where they stand word for word
    as whole sentences or lines; whole_ids names those.  One that is a single word or number
    ("Yes") tells nothing of where a sentence is from: it is in whole_ids alone and makes no document contaminated.
    item_ids are the items held (in order, each once), coverage the largest share of
    an item's tokens, verbatim whether one stands there unchanged.  Null and empty
    texts, and an empty benchmark, give no item and coverage 0.
    """
    found = all_leaks(docs.select("doc_id", "text"), benchmark, coverage, index_bytes)
    told = _telling()
    return found.select(
        F.col("_doc.doc_id").alias("doc_id"),
        (F.size(told) > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.transform(told, lambda x: x["item_id"]))).alias("item_ids"),
        F.coalesce(F.array_max(F.transform(told, lambda x: x["coverage"])), F.lit(0.0)).alias("coverage"),
        F.exists(told, lambda x: x["verbatim"]).alias("verbatim"),
        F.array_sort(F.array_distinct(F.transform(F.filter("_leaks", lambda x: x["whole"]), lambda x: x["item_id"]))).alias("whole_ids"),
    )


def _telling() -> Column:
    """The leaks that make a document contaminated."""
    return F.filter("_leaks", lambda x: ~x["lone"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item; null and empty texts and repeated rows are rows like others."""
    return unpacked(all_leaks(docs, benchmark, coverage).where(F.size(_telling()) == 0))
