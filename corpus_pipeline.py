"""A training-data pipeline: five operators, each working on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of ``docs``.

In every stage a null text counts as an empty one, repeated rows and repeated or null ids are
rows like others, columns beside doc_id and text are carried along whatever their names, and
an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tramline.llm import base, blocknames, dartminhash, editmatch, packing, subwords


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on their labels, doesn't reject.

    Empty texts are judged by the model's bias; without labels, or with labels of one class only,
    all documents get the smoothed share of good ones as their score.
    """
    model = subwords.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return subwords.keep_good(docs, model, 0.3)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts equal but for white space: the longest, then the one
    with the least doc_id (null last), then the first row. Empty texts are one group."""
    return blocknames.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the first row. Texts without words are one class."""
    return dartminhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Null and blank items are held by none."""
    return editmatch.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their windows, with their token ids. An empty text is its end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("benchmark", benchmark), ("pack", pack)]

#: Training, signatures and tokenizing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with a written table after each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = base.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
