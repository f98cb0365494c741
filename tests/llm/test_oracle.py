"""The queries of this package that SQL can express, and the pipeline, on the smallest tables."""

import pytest

import corpus_pipeline
from strider.llm import queries
from tests.test_oracle import DATA, compare


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name])


def test_pipeline(spark):
    columns = spark.read.parquet(f"{DATA}/documents.parquet").columns
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns
    assert corpus_pipeline.run(spark, DATA).groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048
