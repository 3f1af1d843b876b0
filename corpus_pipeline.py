"""From raw documents to packed sequences: toxicity, exact copies, near copies, packing.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; its rows are written and read again as the next
stage's ``docs``. All stages but the last keep the columns of ``docs``. NULL and empty texts pass the first
stage if the model lets the empty text pass, are copies of each other in the second, and link with nothing
in the third. A stage without rows gives none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marketloom.llm import dedup, ngram_join, packing, toxicity
from marketloom.session import written


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a model fitted on the labelled documents."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the smallest id."""
    return dedup.without_duplicates(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents tied by links (0.8 of their shingles of five words), the one with the smallest id."""
    return ngram_join.one_of_each(docs, width=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of every document with its place in a sequence."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", clean), ("exact dedup", distinct), ("n-gram Jaccard join", unlike), ("best-fit packing", packed)]

#: A fitted model, components and tokens are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
