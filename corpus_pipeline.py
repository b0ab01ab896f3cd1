"""The corpus pipeline: classify, drop near-duplicates, drop repeated passages, mix, pack."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from vertexloom.llm import mixing, packing, quality_classifier, simhash, substring
from vertexloom.llm._shared import shared_dir, table
from vertexloom.llm.queries import tokenizer


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has."""
    return substring.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources say."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(docs, tokenizer())


STAGES = [("quality_classifier", classify), ("simhash", near_duplicates), ("substring", repeated_passages), ("mixing", mix), ("packing", pack)]

#: Learned scores and seeded hashes are not expressible in SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; a stage's rows are deleted once the next
    ones are written."""
    docs, top = table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    done = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if done is not None:
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(done)
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        done = path
    return docs
