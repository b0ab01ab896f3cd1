"""The stages, each against what its operator says of the stage's own input."""

import glob
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import groups
from vertexloom.llm import mixing, quality_classifier, substring
from vertexloom.llm.queries import oracle_sql, queries


@pytest.fixture(scope="module")
def folder(docs, labels, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{top}/documents.parquet")
    labels.write.parquet(f"{top}/labels.parquet")
    return str(top)


def test_stages(spark, folder, tmp_path):
    at = spark.read.parquet(f"{folder}/documents.parquet")
    columns = at.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{k}"
        stage(spark, at, folder).write.parquet(path)
        out = spark.read.parquet(path)
        if name == "quality_classifier":
            verdict = quality_classifier.classify(at, spark.read.parquet(f"{folder}/labels.parquet"))
            assert out.count() == verdict.where("predicted = 1").count() > 0
        elif name == "simhash":
            assert out.count() == groups(at)
        elif name == "substring":
            left = substring.digests(at).agg(F.sum(F.col("n_words") - F.col("n_removed"))).first()[0]
            assert out.count() == at.count() and out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == left
        elif name == "mixing":
            assert out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == mixing.mix(at).agg(F.sum("taken")).first()[0]
        else:
            whole = at.groupBy("doc_id").count()
            assert out.where("start = 0").groupBy("doc_id").count().exceptAll(whole).count() == 0
            assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
        if name != "packing":
            assert out.columns == columns
        at = out


def test_run_and_names(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert Counter(n.split("_")[0] for n in queries()) == Counter(f"op{k}" for k in range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    top, db = "/root/testdata/sf0.001", duckdb.connect()
    for p in glob.glob(f"{top}/*.parquet"):
        db.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = queries()[name](spark, top)
    want = db.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(want.fetchall())
