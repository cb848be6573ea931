"""Corpus pipeline over the documents table: quality rules, line dedup, n-gram Jaccard join, suffix-array dedup, packing.

Every stage takes (spark, docs, sf_dir) with the columns of documents and returns them again, the last one the packed pieces.
A stage that changes a text sets n_chars anew. A document whose words are all taken out by a dedup stage goes with them.
Null texts and texts without words fail the quality rules; an empty table stays empty through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sunledger.llm import jaccard_join, line_dedup, packing, quality, suffix_dedup
from sunledger.llm.queries import PACKED
from sunledger.session import work_dir


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """``docs`` with n_chars of their texts, in the columns of ``like``."""
    kind = dict(like.dtypes).get("n_chars")
    return (docs.withColumn("n_chars", F.length("text").cast(kind)) if kind else docs).select(like.columns)


def _with_words(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go from their texts; rejected documents go."""
    return _counted(quality.quality_filter(docs), docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document or line has, up to one word, go."""
    return _counted(_with_words(line_dedup.line_dedup(docs)), docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked texts stays: that of the least doc_id."""
    return jaccard_join.one_of_each(docs).select(docs.columns)


def dedup_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a document of smaller doc_id has go."""
    return _counted(_with_words(suffix_dedup.remove_repeats(docs)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in sequences of at most 4096."""
    return packing.pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json")).select(PACKED)


STAGES = [("quality_rules", quality_rules), ("line_dedup", dedup_lines), ("ngram_jaccard_join", dedup_documents),
          ("suffix_array_dedup", dedup_strings), ("best_fit_packing", pack)]

ORACLE_SQL = None   # packing depends on the plan of the bins; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents; every stage's result is written below spark.checkpoint.dir and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        at = work_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
