"""A training-data pipeline over `documents`: language ID, near-duplicates, decontamination, secrets, BPE.

Every stage works on all that its predecessor kept and returns the columns of documents; the last returns token ids.
Between stages the documents are written to the shared folder, so a lost executor never costs an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, decontaminate, jaccard, langid, secrets
from quarry.llm.common import cut


# All stages: columns besides those of documents are handed on unread, an empty table stays empty, and repeated rows
# share their fate but for duplicates, of which a repeated doc_id is none. A null text has no letter and goes first.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: null, without a letter, or scored hardly better than chance. A null lang is not learned from."""
    return langid.identify(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word five-grams at a similarity of 0.8 or more, the one with the least id stays; texts without words and null ids stay."""
    return jaccard.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null and empty items are held by none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars follows; every document stays."""
    return secrets.redact(docs)


def bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (a null text: none), with digests of the ids and of the decoded text."""
    return bpe.encode(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("bpe_coding", bpe_coding),
]

#: A trained network, regular expressions and a tokenizer take part: SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
