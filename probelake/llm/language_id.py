"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a sample of its labelled
text.  A text is parsed greedily into the longest phrases that occur in that
sample; with ``c`` phrases for ``n`` symbols and a sample of ``m`` symbols the
entropy estimate is ``c * log2(m) / n``, and the language with the least wins.

Texts are lower-cased, every run of other characters than letters becomes one
blank, and parsing starts anew every ``BLOCK`` symbols.  So a batch of texts of
any length is a matrix of blocks, which all automata walk column by column.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
PAD, OTHER, BLANK, FIRST = 0, 1, 2, 3
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def clean(text: str) -> str:
    """Lower case, with one blank for every run of characters that are not letters."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root.  OTHER breaks the sequence."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for s in symbols:
        if s == OTHER:
            last = 0
            continue
        if s in nxt[last] and length[nxt[last][s]] == length[last] + 1:
            last = nxt[last][s]
            continue
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and s not in nxt[p]:
            nxt[p][s] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][s]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(s) == q:
                    nxt[p][s] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


class Model:
    """Transition tables of all languages over one alphabet of all their letters; small enough to send to every task.

    The ``common`` letters (of most sampled texts) have a dense column each, fewer
    where the table would pass ``table_bytes``.  The edges of all others, which
    large scripts have many of, lie in one sorted list of 12 bytes an edge.  So for
    100 languages in samples of 2,000,000 characters the model takes some 200 MB.
    """

    def __init__(self, samples: dict[str, list[str]], sample_chars: int, common: int = 250, table_bytes: int = 128 << 20):
        self.langs = sorted(samples)
        parts = {}
        for lang in self.langs:
            left, own = sample_chars, []
            for t in map(clean, samples[lang]):
                own.append(t[:left])
                left -= len(own[-1])
                if left <= 0:
                    break
            parts[lang] = own
        seen = Counter(c for own in parts.values() for t in own for c in set(t) if c != " ")
        self.alphabet = {c: FIRST + i for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0])))} | {" ": BLANK}
        self.symbol = np.uint8 if FIRST + len(self.alphabet) <= 256 else np.uint32
        automata = {}
        for lang in self.langs:
            seq = [s for t in parts[lang] for s in [*(self.alphabet[c] for c in t), OTHER]]
            automata[lang] = len(seq), suffix_automaton(seq)
        affordable = table_bytes // (4 * max(1, sum(len(a) for _, a in automata.values()))) - FIRST
        self.width = width = FIRST + max(0, min(len(self.alphabet) - 1, common, affordable))
        rows, starts, sizes, rare = [], [], [], []
        at = 0
        for lang in self.langs:
            symbols, states = automata.pop(lang)
            dense = np.full((len(states), width), -1, "int32")
            for i, edges in enumerate(states):
                few = [s for s in edges if s < width]
                dense[i, few] = [(at + edges[s]) * width for s in few]
                if len(few) < len(edges):
                    rare += [(((at + i) * width) << 32 | s, (at + j) * width) for s, j in edges.items() if s >= width]
            dense[:, PAD] = (at + np.arange(len(states))) * width
            rows.append(dense)
            starts.append(at * width)
            sizes.append(max(2, symbols))
            at += len(states)
        self.table = np.concatenate(rows).ravel() if rows else np.zeros(0, "int32")
        self.rare = np.array([k for k, _ in sorted(rare)], "int64")
        self.rare_to = np.array([to for _, to in sorted(rare)], "int32")
        self.root, self.log_size = np.array(starts, "int32")[:, None], np.log2(sizes) if sizes else np.zeros(0)
        self._lut: np.ndarray | None = None

    def _step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Where the states go by one symbol for each column of theirs; -1 for nowhere."""
        if not len(self.rare):
            return self.table[state + column]
        far = np.flatnonzero(column >= self.width)
        out = self.table[state + np.where(column < self.width, column, 0).astype("int32")]
        if len(far):
            key = state[:, far].astype("int64") << 32 | column[far].astype("int64")
            place = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
            out[:, far] = np.where(self.rare[place] == key, self.rare_to[place], -1)
        return out

    def lut(self) -> np.ndarray:
        """Symbol of each code point."""
        if self._lut is None:
            lut = np.full(0x110000, BLANK, self.symbol)
            cps = range(0x110000)
            lut[[cp for cp in cps if chr(cp).isalpha()]] = OTHER
            for cp in cps:
                if lut[cp] == OTHER:
                    low = chr(cp).lower()
                    if len(low) == 1:
                        lut[cp] = self.alphabet.get(low, OTHER)
            self._lut = lut
        return self._lut

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' symbols, one after the other, and the number of each."""
        data = "\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass")
        sym = self.lut()[np.frombuffer(data, "<u4")]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), "int64", len(texts)))
        keep = np.ones(len(sym), bool)
        keep[1:] = (sym[1:] != BLANK) | (sym[:-1] != BLANK)
        keep[np.r_[0, ends[:-1]]] &= sym[np.r_[0, ends[:-1]]] != BLANK
        # The added line break, or the blank before it, is the blank that closes a text.
        run = np.cumsum(keep)
        at = run[ends - 1]
        return sym[keep], np.diff(at, prepend=0)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text by language (texts x languages), and the symbols of each text."""
        sym, n = self.symbols(texts)
        blocks = -(-n // BLOCK)
        first = np.cumsum(blocks) - blocks
        matrix = np.zeros((int(blocks.sum()), BLOCK), self.symbol)
        start = np.cumsum(n) - n
        within = np.arange(len(sym)) - np.repeat(start, n)
        matrix[np.repeat(first, n) + within // BLOCK, within % BLOCK] = sym
        columns = np.ascontiguousarray(matrix.T)
        state = np.repeat(self.root, matrix.shape[0], 1)
        count = np.zeros(state.shape, "int32")
        fresh = np.ones(state.shape, bool)  # a phrase begins here: at a start, and after a symbol that is unknown
        for column in columns:
            here = self._step(state, column)
            dead = here < 0
            count += dead | (fresh & (column != PAD))
            again = self._step(np.broadcast_to(self.root, state.shape) if len(self.rare) else self.root, column)
            fresh = dead & (again < 0)
            state = np.where(dead, np.where(fresh, self.root, again), here)
        out = np.zeros((len(texts), len(self.langs)), "int64")
        np.add.at(out, np.repeat(np.arange(len(texts)), blocks), count.T)
        return out, n

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        known = [t if t and any(map(str.isalpha, t)) else "" for t in texts]
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        count, n = self.phrases(known)
        cost = count * self.log_size / np.maximum(n, 1)[:, None]
        order = np.sort(cost, axis=1)
        second = order[:, min(1, len(self.langs) - 1)]
        score = 1 - order[:, 0] / np.maximum(second, 1e-12) if len(self.langs) > 1 else np.ones(len(texts))
        return [(self.langs[k], float(s)) if t else ("und", 0.0) for t, k, s in zip(known, cost.argmin(axis=1), np.clip(score, 0, 1), strict=True)]


def fit(docs: DataFrame, sample_docs: int = 100, sample_chars: int = 30_000, total_chars: int = 2_000_000) -> Model:
    """Learn from ``docs`` (doc_id, text, lang): per language the ``sample_docs`` documents of the
    smallest hashed id, up to ``sample_chars`` characters of them (less where there are so many
    languages that ``total_chars`` would be passed).  These bounds keep the model's size fixed;
    all letters of these samples are told apart.
    Rows without text, language or id are left out."""
    usable = docs.where("doc_id is not null and lang is not null and text is not null")
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("lang", "doc_id").withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= sample_docs)
    ids = {(r["lang"], r["doc_id"]) for r in chosen.select("lang", "doc_id").collect()}  # at most sample_docs a language
    rows = usable.where(F.col("doc_id").isin([i for _, i in ids])).select("lang", "doc_id", F.substring("text", 1, sample_chars).alias("text")) if ids else None
    samples: dict[str, list[str]] = {}
    for r in sorted(rows.distinct().collect() if rows else [], key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        if (r["lang"], r["doc_id"]) in ids:
            samples.setdefault(r["lang"], []).append(r["text"])
    return Model(samples, min(sample_chars, total_chars // max(1, len(samples))))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text).

    ``und`` with score 0 for a null text or one without a letter, or if nothing
    was learned.  score is 1 - least entropy / second least (1 for one language);
    equal entropies go to the language first in order.  A null id is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    model._lut = None

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            texts = [None if t is None else t for t in batch["text"]]
            found, at = [], 0
            while at < len(texts):  # so many texts at once that their blocks stay small
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < 8_000_000):
                    chars += len(texts[end] or "")
                    end += 1
                found += own.predict(texts[at:end])
                at = end
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "lang_pred": [x for x, _ in found], "score": [s for _, s in found]})

    return docs.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInPandas(predict, PREDICTED)


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
