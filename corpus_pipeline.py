"""Corpus pipeline: toxicity, exact duplicates, near duplicates, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of ``documents``. Stages work
row by row on what they are given: null texts count as empty, an empty table stays empty, and
columns that ``documents`` doesn't have are carried along.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reelcost.core.session import ensure_checkpoint_dir, ship_package
from reelcost.llm import blocknames, credentials, ordinal, packing, setjoin
from reelcost.llm.common import free_names, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays below the calibrated threshold."""
    ship_package(spark)
    model = ordinal.fit(docs, table(spark, sf_dir, "labels"))
    severity, grade = free_names(docs, "__severity", "__grade")
    scored = ordinal.scored(docs, model, severity=severity, grade=grade)
    return scored.filter(~ordinal.is_toxic(model, severity)).drop(severity, grade)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (white space aside)."""
    ship_package(spark)
    return blocknames.without_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle sets: the one with the smallest id."""
    ship_package(spark)
    return setjoin.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets and confirmed weak candidates masked in their texts."""
    ship_package(spark)
    return credentials.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [("toxicity", toxicity), ("exact_duplicates", exact_duplicates), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packed)]

# Trained weights and a tokenizer library decide the rows; tests/llm compares the stages in a row with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
