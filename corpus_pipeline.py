"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Between stages the documents are written and read again.

NULLs in any column are allowed: a text that is NULL, empty or without letters goes at the first
stage; a NULL lang is not learned from; a NULL doc_id is a row that copies nothing; NULL is a
source of its own. Very long texts are processed whole. Of repeated rows one stays. An empty
table gives an empty result, and extra columns are carried along unread up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pseudosignal.llm import language, mixing, ngram_join, packing, secrets
from pseudosignal.llm.common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; those without letters go."""
    return language.with_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more)."""
    return ngram_join.one_of_each(docs, 5, 80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secrets.masked(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with checksums of their ids."""
    return packing.digest(packing.pack(docs, tokens=False))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("packing", pack),
]

# Trained models decide in two stages. The tests hold each stage against plain Python, or SQL for
# the mix, on the rows that the stage before kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
