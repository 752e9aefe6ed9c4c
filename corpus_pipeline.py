"""Corpus pipeline: toxic and poor documents go, repeated lines and near copies go, the rest is packed.

Every stage's result is written as Parquet and read again by the next one. Duplicate rows, nulls,
empty texts and empty tables follow the stages' operators (see their modules in foliant.llm).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import crf, line_dedup, minhash, packing, toxicity
from foliant.llm.io import shared_dir, table
from foliant.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call poor."""
    return crf.drop_poor(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; n_chars follows the text."""
    return line_dedup.drop_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of at most 2048 tokens."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer_file("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality_classifier", drop_poor), ("line_dedup", drop_repeated_lines), ("minhash_near_dedup", drop_near_copies), ("best_fit_packing", pack)]

#: Classifiers, minhashes and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
