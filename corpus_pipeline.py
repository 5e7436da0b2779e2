"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage works on all that the one before kept, written as Parquet and read again. Null texts are kept as they are (empty for
the token ids), also rows of null ids; of repeated rows one stays, as of near duplicates; texts of any length are whole; a table
without rows gives none; columns beside id and text go through unchanged, whatever their names, up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from causeway.llm import bpe, decontaminate, near_dup, passages, toxicity
from causeway.llm import exchange as X
from causeway.llm import files


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents predicted toxic, by what all labels teach."""
    return toxicity.reject(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "true"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dup.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages that a document of smaller id has."""
    return passages.remove(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and whether they decode to its text."""
    return bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("substring_dedup", substrings), ("decontamination", leaks), ("byte_bpe", token_ids)]

#: The first stages aren't SQL: the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        at = files.fresh(X.shared_dir(spark), f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(at)
        docs = spark.read.parquet(at)
    return docs
