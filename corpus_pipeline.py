"""From raw documents to packed sequences: quality classifier, quality rules, near duplicates, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import jaccard, packing, quality_model, quality_rules
from foliospark.llm.common import materialize, shared_dir


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labels, fitted to these documents' statistics, scores 0.5 or more."""
    return quality_model.keep_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and don't lose too much text to the line rules, without the lines that fail."""
    return quality_rules.keep_documents(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked, directly or over others, the one with the least doc_id; of equal rows one."""
    return jaccard.keep_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; a row for each document's piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", classify), ("quality rules", apply_rules), ("n-gram Jaccard join", drop_similar), ("best-fit packing", pack)]

#: SQL can't express the classifier; tests compare run() with a plain version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table; what each keeps is written and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"{folder}/{i}")
    return docs
