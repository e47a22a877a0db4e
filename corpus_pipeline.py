"""Corpus pipeline: from raw documents to packed training sequences.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result, written and
read again, is the next one's ``docs``.  All but the last return the columns of
``documents``.

Null texts count as empty.  The quality stage judges an empty text by its site and by having no
words; the exact stage keeps one of all empty ones; they have no near copy and no
benchmark item, and pack as the closing id alone.  Rows with a null doc_id are judged, compared
and packed like others; the near stage keeps them.  Of repeated rows the exact
stage keeps one; ties fall to the smallest doc_id, those at a threshold are kept.  Other columns are
carried along but for the last stage.  No documents give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from probelake.llm import decontamination, exact_dedup, jaccard_join, packing, quality
from probelake.llm.common import fresh_path, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return jaccard_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of at most 1024 tokens: one row per piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("jaccard_join", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Tokenisation and near-duplicate search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
