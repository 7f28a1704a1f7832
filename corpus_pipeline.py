"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. The first four return the
columns of docs, extra ones included; the last returns a row of digests for each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seriesgrove.llm import bpe, dedup, mixing, repetition, secrets
from seriesgrove.llm.lineage import cut
from seriesgrove.llm.textops import fresh, small_batches


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the repetition rules reject."""
    small_batches(spark)
    return repetition.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    small_batches(spark)
    return dedup.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows."""
    small_batches(spark)
    return secrets.redact_secrets(docs, length="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives each row as often as the mix takes it; a row that is cut keeps the taken words, and n_chars follows."""
    small_batches(spark)
    into = fresh(docs.columns, "mix")
    return mixing.write_out(mixing.mix_sources(docs, into=into), into, docs.columns, length="n_chars")


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    small_batches(spark)
    return bpe.digests(bpe.encode(docs, bpe.word_bpe()))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mix_sources", mix_sources), ("bpe_encode", bpe_encode)]

#: Near duplicates, seeded mixing and the vocabulary's merges are beyond SQL; tests hold the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what a stage returns is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
