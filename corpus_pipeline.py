"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's documents.

All stages take null and empty texts, very long ones, null and repeated ids, repeated rows, empty tables and further columns of any
name; the first four give back the columns they got. What each does with such rows is said at the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import byte_bpe, decontaminate, ngram_join, quality_lm, secrets
from quillgraph.llm.runtime import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is within their language's limits, ends included.

    Null and empty texts are judged as an end alone; rows alike in language and text share a verdict, whatever their ids. Without
    good labels all stay.
    """
    return quality_lm.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of word-shingle sets join: five words, similarity 0.8, ties included.

    The smallest id stays, of repeated rows one. Different texts under one id are different documents. Rows without an id, and texts without words, stay.
    """
    return ngram_join.deduplicated(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts hold none and stay; null and repeated ids are judged by their own text."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked. Null texts stay null; a text without secrets stays as it is."""
    return secrets.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again. Null and empty texts have none; every row has a result, null ids included."""
    return byte_bpe.tokenized(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scan), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Models and fixpoints are beyond SQL; the stages are held against brute force in the tests.
ORACLE_SQL = None
