"""The registered queries: twins, guards, and the pipeline."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check import TABLES, normal
from tagloom.llm.queries import QUERIES
from tagloom.llm.twins import TWINS

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert normal(got).equals(normal(con.execute(TWINS[name]).fetchdf()))


def test_one_query_for_each_operator():
    numbers = sorted(int(m[1]) for m in (re.match(r"op(\d+)_", n) for n in QUERIES) if m)
    assert numbers == list(range(1, 14))
    assert {"pipeline", *QUERIES} <= set(entry.queries())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stage_rows = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, FOLDER).cache()
        stage_rows[name] = (before.count(), docs.count())
        assert docs.columns == before.columns
        assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert stage_rows["line dedup"][0] == stage_rows["line dedup"][1]
    assert stage_rows["quality rules"][1] < stage_rows["quality rules"][0]
    result = corpus_pipeline.run(spark, FOLDER)
    assert result.count() == docs.count()
    assert result.filter(F.col("rate").isNull() | (F.col("rate") < 0)).count() == 0
