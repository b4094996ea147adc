"""Queries against their SQL twins; all of them with ALL_TWINS=1, a few otherwise."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, normal
from tagloom.catalog.twins import TWINS

FOLDER = "/root/testdata/sf0.001"
FEW = [
    "element_usages", "usage_location", "prop_levels", "combo_table", "combo_cells", "match_anchor", "most_specific_match", "rule_applied",
    "changed_files", "skeleton_rewrites", "event_prop_levels", "nested_elements", "unread_tags", "tree_scan", "spec_packages",
    "nested_tree", "template_rendered", "migration_units", "imports_rewired",
]
NAMES = sorted(TWINS) if os.environ.get("ALL_TWINS") else FEW

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, duck, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).fetchdf()
    assert normal(got).equals(normal(want))


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_have_no_cross_or_nested_loop_join(spark):
    for name in ["attributed_usages", "first_match", "match_anchor", "prop_levels", "changed_files", "imports_rewired"]:
        plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_a_page_is_read_without_a_shuffle(spark):
    plan = entry.queries()["element_usages"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("name", ["imports_rewired", "imports_pruned", "imports_added", "scope_counts", "selected_elements", "unattributed_files"])
def test_files_are_read_once(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and plan.count("ArrowEvalPython [") == 1


def test_matching_has_no_window(spark):
    assert "Window" not in entry.queries()["match_anchor"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
