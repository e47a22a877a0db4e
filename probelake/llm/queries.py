"""The registered corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelake.llm import alignment, chat_windows, decontamination, exact_dedup, jaccard_join, language_id, packing, quality, secret_scan, spelling, substring_dedup, token_counts, warc
from probelake.llm.common import fresh_path, table

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_classes(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_warc(warc.convert(warc.pages_to_arc(table(spark, sf_dir, "pages"))), path)
    return warc.read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs.where(~language_id.held_out("doc_id"))))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of two turns that consist of control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_windows.digests(chat_windows.windows(rows.unionByName(more)))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_jaccard_join, op2_token_counts, op3_packing, op4_warc, op5_exact_dedup, op6_secret_scan, op7_substring_dedup, op8_language_id, op9_decontamination, op10_quality, op11_chat_windows, op12_spelling_variants, op13_token_alignment)}

ORACLES: dict[str, str] = {
    "op4_warc": r"""
        with p as (select page_id, coalesce(html, '') as html from pages),
             d as (select page_id, strlen(html) as payload_bytes, sha1(html) as hex from p),
             bits as (select page_id, payload_bytes, hex,
                             list_transform(range(0, 160, 5), lambda i: (('0x' || hex[(i // 20) * 5 + 1:(i // 20) * 5 + 5])::bigint >> (15 - i % 20)) & 31) as fives
                      from d)
        select page_id, payload_bytes,
               list_aggregate(list_transform(fives, lambda v: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[v + 1]), 'string_agg', '') as payload_digest,
               case when page_id = max(page_id) over (partition by hex) then 'response' else 'revisit' end as record_type,
               case when page_id < max(page_id) over (partition by hex) then max(page_id) over (partition by hex) end as refers_to
        from bits""",
    "op5_exact_dedup": r"""
        with d as (select doc_id, length(coalesce(text, '')) as chars,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
                   from documents)
        select doc_id,
               first_value(doc_id) over (partition by text_sha256 order by chars desc, doc_id) as keep_id,
               count(*) over (partition by text_sha256) as group_size,
               doc_id = first_value(doc_id) over (partition by text_sha256 order by chars desc, doc_id) as kept,
               text_sha256
        from d""",
    # The windows of conversations of one block: turn numbers from 0 to 255.
    "op11_chat_windows": r"""
        with recursive turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        sized as (
            select *, row_number() over (partition by conv_id order by turn, role, text) as i,
                   6 + len(regexp_extract_all(text, '\p{L}{1,4}|\p{N}{1,3}|[^\s\p{L}\p{N}]|\n')) as tokens,
                   19 + length(regexp_replace(role, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) + length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) + 5 as chars
            from turns),
        heads as (select conv_id, tokens as head, chars as head_chars from sized where i = 1 and role = 'system'),
        body as (
            select s.*, coalesce(head, 0) as head, coalesce(head_chars, 0) as head_chars,
                   sum(tokens) over (partition by s.conv_id order by i) as until
            from sized s left join heads h on h.conv_id = s.conv_id where h.conv_id is null or i > 1),
        reached as (
            select *, until - tokens as start, min(until - tokens) over (partition by conv_id order by until - tokens range between 128 preceding and current row) as reach from body),
        placed as (select *, case when until - reach <= 1024 - head then reach else start end as base from reached),
        wins as (
            select conv_id, i, base from placed qualify row_number() over (partition by conv_id order by i) = 1
            union all
            select n.conv_id, n.i, p.base from (
                select w.conv_id, min(p.i) as i from wins w join placed p on p.conv_id = w.conv_id and p.i > w.i and p.until - w.base > 1024 - p.head group by w.conv_id) n
            join placed p on p.conv_id = n.conv_id and p.i = n.i),
        spans as (select *, lead(i) over (partition by conv_id order by i) as next from wins),
        written as (
            select w.conv_id, w.i, sum(p.chars) + any_value(p.head_chars) as chars
            from spans w join placed p on p.conv_id = w.conv_id and p.start >= w.base and (w.next is null or p.i < w.next) group by w.conv_id, w.i
            union all select conv_id, 1, head_chars from heads where conv_id not in (select conv_id from body)),
        told as (
            select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by i) as said,
                   coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '') as loss
            from sized group by conv_id)
        select conv_id, n_turns, sha256(said) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, cast(sum(chars) as bigint) as formatted_chars
        from told join written using (conv_id) group by all""",
}
