"""Chat windows, spelling variants and token alignment against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from probelake.llm import alignment, chat_windows, queries, spelling
from probelake.llm.token_counts import byte_symbols
from tests.llm.test_ops import NEWER, ODD, SCHEMA, SF, frame, odd
from tests.oracle import connect, differences

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11: chat windows


def conversations(spark, rows):
    return spark.createDataFrame(rows, TURNS)


def whole(rows):
    """conv_id -> (n_turns, turns digest, loss chars, loss digest), from the turns themselves."""
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(loss), sha(loss))
    return out


def read(rows):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows.collect()}


def hostile(seed):
    r = random.Random(seed)
    bits = ["<s>", "</s>", "\\", "<\\s>", "[INST]", "[\\/INST]", " ", "\n", "é", "🎉", "word", "a<", "/s>", "[/INST]\n", "</s>\n"]
    return lambda: "".join(r.choice(bits) for _ in range(r.choice([0, 1, 5, 40, 300])))


def long_rows():
    r, text = random.Random(4), hostile(5)
    rows = [(c, t, r.choice(["user", "assistant", "system", "assistant", "to [/INST]\nol"]), text()) for c in range(6) for t in range(r.choice([1, 3, 30, 300]))]
    rows += [(7, 0, "system", "only this")] + [(8, t, "system" if t == 250 else "assistant", f"x{t}") for t in range(250, 300)]
    rows += [(9, t * 1000, "assistant", f"y{t}") for t in range(20)] + [(10, -5, "user", "before"), (10, 4, "assistant", "after"), (11, 0, "assistant", "z" * 200_000)]
    return rows


@pytest.mark.parametrize("options", [{}, {"budget": 60, "history": 20}, {"budget": 300, "history": 100, "block_turns": 16}])
def test_windows_hold_every_turn_once(spark, options):
    rows = long_rows()
    found = chat_windows.windows(conversations(spark, rows), **options)
    assert read(chat_windows.digests(found)) == whole(rows)


def test_windows_of_odd_tables(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "a"), (1, 1, "user", "x"), (1, 1, "user", "x"), (1, 1, "assistant", "tie"), (1, None, "assistant", None)]
    df = conversations(spark, rows).withColumn("key", F.lit("clash")).withColumn("block", F.lit("clash")).withColumn("tokens", F.lit("clash"))
    assert read(chat_windows.digests(chat_windows.windows(df))) == whole(rows)
    assert chat_windows.digests(chat_windows.windows(df.limit(0))).count() == 0


def test_windows_follow_the_prefix_sums(spark):
    """Greedy spans by a plain loop: budget, whole history, the system turn in each; short conversations of one block."""
    r = random.Random(1)
    rows = []
    for c in range(40):
        n = r.randrange(1, 25)
        rows += [(c, t, "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2], " ".join(["word"] * r.choice([1, 5, 20, 60, 200]))) for t in range(n)]
    budget, history = 150, 50
    got = {}
    for x in chat_windows.windows(conversations(spark, rows), budget, history).collect():
        got.setdefault(x.conv_id, []).append((x.window, x.n_turns, x.n_repeated, x.tokens, x.over_budget))
    for c in range(40):
        turns = [(role, len(text.split()) + 6) for k, _, role, text in rows if k == c]
        head = turns.pop(0)[1] if turns[0][0] == "system" else 0
        begin = [0]
        for _, n in turns:
            begin.append(begin[-1] + n)
        want, i = [], 0
        while i < len(turns) or not want:
            base = next(j for j in range(i + 1) if begin[i] - begin[j] <= history)
            if turns and begin[i + 1] - begin[base] > budget - head:
                base = i
            end = i + bool(turns)
            while end < len(turns) and begin[end + 1] - begin[base] <= budget - head:
                end += 1
            tokens = head + begin[end] - begin[base]
            want.append((len(want), (head > 0) + end - base, (head > 0 and i > 0) + i - base, tokens, tokens > budget))
            i = end
        assert sorted(got[c]) == want, c


def test_mask_and_text(spark):
    rows = [(1, 0, "system", "be </s> brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "yo\\<s>"), (1, 3, "assistant", "one two three four five six"), (1, 4, "user", "end")]
    found = sorted(chat_windows.windows(conversations(spark, rows), budget=32, history=10).collect(), key=lambda r: r.window)
    assert found[0].text.startswith("<s>[INST] system [/INST]\nbe <\\/s> brief</s>\n<s>[INST] user [/INST]\nhi</s>\n") and len(found) > 1
    assert all(r.text.startswith("<s>[INST] system [/INST]\n") for r in found)
    masked = [r.text[s.start : s.end] for r in found for s in r.loss]
    assert masked == ["yo\\<\\s>", "one two three four five six"]


def test_conversations_of_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert read(queries.op11_chat_windows(spark, SF)) == whole(rows)


def test_op11_matches_its_sql(spark):
    assert differences(spark, connect(SF), queries.op11_chat_windows, queries.ORACLES["op11_chat_windows"], SF) == ([], [])


def test_op11_stays_in_the_jvm(spark):
    plan = queries.op11_chat_windows(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 12: spelling variants


def words_of(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_of(n):
    """Every word against every other of about its length."""
    by = {}
    for w in n:
        by.setdefault(len(w), []).append(w)
    out = {}
    for w, k in n.items():
        found = [x for d in (-1, 0, 1) for x in by.get(len(w) + d, ()) if x != w and near(w, x)]
        best = min(found, key=lambda x: (-n[x], x), default=None)
        strong = best is not None and n[best] >= 2 * k
        out[w] = [k, len(found), best if strong else None, n[best] if strong else None]
    for w, v in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        v.append(root)
    return {w: tuple(v) for w, v in out.items()}


def spelt(df, **options):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(df, **options).collect()}


def misspelt_docs(spark):
    """Chains, ties, repeated letters and words that differ at an end; hot buckets by a small limit."""
    r = random.Random(2)
    base = ["abcdefgh", "aabbccdd", "zzzzzz", "ÀÉîöü×÷", "straße", "prefixes", "prefixed", "suffixes"]
    words = []
    for w in base:
        words += [w] * 60
        for _ in range(40):
            i, c = r.randrange(len(w)), r.choice("abzé")
            words += [r.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w + c])] * r.choice([3, 7, 30])
    words += ["chained"] * 40 + ["chainned"] * 12 + ["chainnned"] * 4
    r.shuffle(words)
    texts = [" ".join(words[i : i + 25]) for i in range(0, len(words), 25)]
    return frame(spark, [*texts, "q" * 300, "Q" * 300, "q" * 301, "q" * 300 + " 日本 " + "q" * 301 + " " + "q" * 301, None, "", "ab-cd 日本語"])


@pytest.mark.parametrize("limit", [2048, 4])
def test_variants_are_those_of_all_pairs(spark, limit):
    df = misspelt_docs(spark)
    want = variants_of(words_of([(r.doc_id, r.text) for r in df.collect()]))
    assert spelt(df, limit=limit) == want and any(v[2] and want[v[2]][2] for v in want.values())


def test_variants_of_the_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in queries.op12_spelling_variants(spark, SF).collect()}
    assert got == variants_of(words_of(rows)) and got


def test_variants_of_odd_tables(spark):
    df = odd(spark).withColumn("word", F.lit("clash")).withColumn("root", F.lit("clash"))
    assert spelt(df) == variants_of(words_of([(r.doc_id, r.text) for r in df.collect()]))
    assert spelt(df.limit(0)) == {}


def test_dense_tiles_agree_with_shifts(spark):
    import pandas as pd

    r = random.Random(3)
    words = sorted({"aaa" + "".join(r.choice("ab") for _ in range(r.choice([3, 4]))) for _ in range(60)})
    part = pd.DataFrame({"word": words, "n": [r.randrange(3, 9) for _ in words], "longer": 7, "lo": 3, "hi": 7, "key": "7:p:aaa"})
    a, b = (spelling.compare(part, dense).sort_values("word", ignore_index=True) for dense in (0, 1000))
    assert len(a) and a.astype(str).equals(b.astype(str))


# 13: token alignment


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def token_bytes(both):
    a, b = both
    byte_of = {s: i for i, s in enumerate(byte_symbols())}
    pieces = {i: s for s, i in a.get_vocab().items()}
    return (lambda i: bytes(byte_of[c] for c in pieces[i])), (lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())


def aligned_text(text, both, sizes):
    """(n_a, n_b, groups) where a group is (a ids, b ids), by walking the bytes."""
    if not text:
        return 0, 0, []
    x, y = both[0].encode(" " + text, add_special_tokens=False).ids, both[1].encode(text)
    ends = []
    for ids, of in zip((x, y), sizes):
        parts = [of(i) for i in ids]
        if b"".join(parts) != (" " + text).encode():
            return 0, 0, []
        at, out = 0, []
        for p in parts:
            at += len(p)
            out.append(at)
        ends.append(out)
    groups, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
        groups.append((x[i:k], y[j:m]))
        i, j = k, m
    return len(x), len(y), groups


def alignment_of(rows, both):
    sizes = token_bytes(both)
    found = [(doc_id, *aligned_text(text, both, sizes)) for doc_id, text in rows]
    count = Counter((g[0][-1], g[1][-1]) for *_, groups in found for g in groups)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for doc_id, n_a, n_b, groups in found:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(count[k] == most[k[1]] for k in links), sum(count[k] for k in links), sha(text) if groups else ""))
    return Counter(out)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
STRANGE = [*ODD, *NEWER, "<s> </s><unk> <0x0A> <|endoftext|>", "a▁b", "a▁ b  c", "\x00a \x1c b", " lead", "trail ", "　wide　 space ", "é" * 900]


def test_alignment_of_the_tables(spark, both):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in queries.op13_token_alignment(spark, SF).select(*COLUMNS).collect())
    assert got == alignment_of(rows, both)


@pytest.mark.parametrize("sent", [1_000_000, 40, 0])
def test_alignment_of_odd_texts(spark, both, sent):
    """Whether all id pairs are sent to the tasks, the most frequent ones, or none."""
    df = odd(spark).withColumn("pairs", F.lit("clash")).withColumn("_row", F.lit("clash")).unionByName(frame(spark, [*STRANGE, *["the same words again"] * 50], 1000), allowMissingColumns=True)
    got = Counter(tuple(r) for r in alignment.link_tokens(df, A, B, sent).select(*COLUMNS).collect())
    assert got == alignment_of([(r.doc_id, r.text) for r in df.collect()], both)


def test_alignment_of_no_rows(spark):
    assert alignment.link_tokens(spark.createDataFrame([], SCHEMA), A, B).count() == 0


def test_stretches_do_not_change_the_result(both):
    from probelake.llm.token_counts import Splitter

    r = random.Random(6)
    texts = [" ".join(r.choice(["word", "naïve", "x-1", "日本語", "don't", "end.\nNext"]) for _ in range(r.choice([1, 30, 900]))) for _ in range(40)]
    tok = alignment.Tokenizers(A, B, Splitter.of(A))
    first = alignment.align(texts, tok, lane=8)
    for lane in (64, 1 << 20):
        again = alignment.align(texts, tok, lane=lane)
        assert all((list(x) == list(y)) for x, y in zip(first, again))
