import json
import random

import pytest
from pyspark.sql import functions as F

from tagloom.functions.props import key_text
from tagloom.operators import aggregates as agg
from tagloom.operators import attribute, extract
from tagloom.sources import reports
from tagloom.sources.store import file_ranges, write_store

UI = 'import { Text } from "p";\nimport Other, { Box } from "q";\n'


@pytest.fixture(scope="module")
def files(files_of):
    return files_of({f"src/{i:04}.tsx": (UI if i % 3 else "") + "<Text a='1'/>\n" * (i % 4) + f"<Box n={{{i}}}/>" for i in range(400)})


@pytest.fixture(scope="module")
def store(files):
    return write_store(files, buckets=4, row_group=1024)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_store_holds_what_extraction_gives(files, store):
    want = extract.element_rows(files).select("file_path", "pos", "component", "props")
    assert sorted(map(str, store.elements.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, store.imports.collect())) == sorted(map(str, extract.import_rows(files).collect()))


def test_attribution_and_declarations_from_the_store_do_not_shuffle(spark, files, store):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        used = attribute.attribute(store.elements, store.imports.filter("local_name = 'Text'"), ["p"])
        declared = attribute.with_declaration(used.select("file_path", "package", "pos"), store.imports)
        assert "Exchange" not in plan(used) and "SortMergeJoin" in plan(used) and "Exchange" not in plan(declared)
        assert used.count() == declared.count() == extract.usages(files, ["p"]).filter("local_name = 'Text'").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def scanned_rows(df):
    """Rows that the scans of a plan hand on after row groups are skipped."""
    df.collect()
    leaves, total = df._jdf.queryExecution().executedPlan().collectLeaves(), 0
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numOutputRows")
        total += metric.get().value() if metric.isDefined() else 0
    return total


def test_row_groups_without_selected_files_are_skipped(spark, store):
    selected = store.elements.filter("file_path IN ('src/0007.tsx', 'src/0008.tsx')").select("file_path")
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        chosen = spark.createDataFrame([("src/0007.tsx",), ("src/0008.tsx",)], "file_path string")
        found = store.elements_of(chosen)
        everything = scanned_rows(store.elements)
        assert scanned_rows(found) < everything / 2
        assert "PushedFilters: [Or(And(IsNotNull" in plan(found).replace("\n", "") or "GreaterThanOrEqual(file_path" in plan(found)
        assert sorted(r.file_path for r in found.collect()) == sorted(r.file_path for r in selected.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)


def test_ranges_are_few_and_hold_all(spark):
    names = [f"f{i * 37 % 1000:04}" for i in range(1000)]
    ranges = file_ranges(spark.createDataFrame([(n,) for n in names], "file_path string"), 5)
    assert len(ranges) <= 5 and all(any(low <= n <= high for low, high in ranges) for n in names)
    assert file_ranges(spark.createDataFrame([], "file_path string")) == []


def usage_rows(spark, rows):
    return spark.createDataFrame(rows, "rel_path string, package string, component string, props map<string,string>").withColumn("file_path", F.col("rel_path"))


def test_wide_table_has_every_prop_in_order(spark):
    rnd = random.Random(5)
    sets = [{f"p{k}": str(rnd.randint(0, 2)) for k in range(11) if rnd.random() < 0.1 + k / 20} for _ in range(80)] + [{}]
    combos = agg.combinations(usage_rows(spark, [("f", "p", "C", s) for s in sets])).persist()
    columns = agg.wide_columns_in_order(combos, 4)
    totals = {f"p{k}": sum(f"p{k}" in s for s in sets) for k in range(11)}
    order = sorted((p for p in totals if totals[p]), key=lambda p: (-totals[p], p))
    assert [(r.prop, r.total) for r in columns.orderBy("block", "slot").collect()] == [(p, totals[p]) for p in order]
    rows = agg.wide_blocks(combos, columns, 4).withColumn("key", key_text(F.col("props_key"))).collect()
    shown = {}
    for r in rows:
        own = shown.setdefault(r.key, {})
        own.update({order[4 * r.block + i]: r[f"c{i + 1}"] for i in range(4) if r[f"c{i + 1}"] != "-"})
    assert shown == {",".join(f"{k}={v}" for k, v in sorted(s.items())): s for s in sets}
    assert {r.key for r in rows if r.block == 0} == set(shown)


def test_roll_up_of_unequal_trees(spark):
    rnd = random.Random(6)
    paths = ["/".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    want = {}
    for path in paths:
        parts = path.split("/")
        for i in range(1, len(parts) + 1):
            want.setdefault("/".join(parts[:i]), []).append(path)
    got = {r.prefix: (r.n_usages, r.n_files) for r in agg.directory_rollup(usage_rows(spark, [(p, "p", "C", {}) for p in paths])).collect()}
    assert got == {k: (len(v), len(set(v))) for k, v in want.items()}
    assert agg.directory_rollup(usage_rows(spark, [])).count() == 0


def test_merged_sketches_are_near_the_exact_counts(spark):
    rows = [("f", f"p{i % 2}", "C", {"a": str(i % 30000)}) for i in range(60000)]
    used = usage_rows(spark, rows)
    runs = agg.combination_sketches(used).unionByName(agg.combination_sketches(used.limit(5000)))
    got = {(r.level, r.package): r.n_estimated for r in agg.merged_sketches(runs).collect()}
    assert set(got) == {("all", None), ("package", "p0"), ("package", "p1"), ("component", "p0"), ("component", "p1")}
    assert abs(got["all", None] - 30000) < 0.05 * 30000 and abs(got["component", "p1"] - 15000) < 0.05 * 15000


def test_nested_documents_of_any_depth(spark):
    def tree(depth):
        return {"f.tsx": [{"name": "T", "filePath": "x", "props": {"a": "1"}}] * depth} if not depth % 7 else {f"d{depth}": tree(depth - 1), "note": "text", "none": None}

    documents = [json.dumps({"p": {"_imports": {"q": [1]}, **tree(d)}}) for d in (1, 13, 20)] + ["not json", "[]", None, '{"p": 3}', '{"p": {"e.tsx": []}}']
    rows = reports.files_of_usages(reports.nested_usages(spark.createDataFrame([(d,) for d in documents], "value string"))).collect()
    path = lambda top, end: "/".join([*(f"d{d}" for d in range(top, end, -1)), "f.tsx"])
    assert sorted(map(tuple, rows)) == [("p", path(13, 7), 7), ("p", path(20, 14), 14)]
