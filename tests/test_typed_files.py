"""Prop values and combinations are counted over files whose elements all keep their type."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import normal
from tagloom.catalog import bindings, queries, twins

NAMES = ["prop_value_freq", "combo_files", "combo_table"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two parts with a line item of each line number, whose quantity is a multiple of seven."""
    at = str(tmp_path_factory.mktemp("typed"))
    spark.createDataFrame([(1, "Brand#11", "TIN", 3), (2, "Brand#12", "TIN", 4)], "p_partkey bigint, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{at}/part.parquet")
    lines = [(p, s, 7.0 * n, n, "N", "O", datetime.date(2000, 1, 1)) for p in (1, 2) for n in range(1, 7) for s in (1, 2)]
    spark.createDataFrame(lines, "l_partkey bigint, l_suppkey bigint, l_quantity double, l_linenumber int, l_returnflag string, l_linestatus string, l_shipdate date").coalesce(1).write.parquet(f"{at}/lineitem.parquet")
    return at


@pytest.mark.parametrize("name", NAMES)
def test_twins_count_every_type(spark, folder, name):
    con = duckdb.connect()
    for table in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got, want = queries.QUERIES[name](spark, folder).toPandas(), con.execute(twins.TWINS[name]).fetchdf()
    assert normal(got).equals(normal(want))
    shown = "prop" if name == "prop_value_freq" else "props"
    assert got[got[shown].str.contains("type")]["n"].sum() == 24
    assert entry.oracle_sql()[name] == twins.TWINS[name]


def test_the_other_queries_keep_elements_without_type(spark, folder):
    counts = [bindings.code_files(spark, folder, typed).filter(F.contains("code", F.lit(" type="))).count() for typed in (False, True)]
    assert counts == [0, 2]
