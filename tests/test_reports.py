import json

import pytest
from pyspark.sql import functions as F

from tagloom.functions.paths import outside_directories
from tagloom.operators import aggregates as agg
from tagloom.operators.attribute import rank_packages
from tagloom.operators.extract import distinct_elements
from tagloom.operators.numbering import number_rows
from tagloom.plans.analyze import analyze_tree, store_reports
from tagloom.plans.report import prop_report, rule_table, usage_table
from tagloom.sources import reports
from tagloom.sources.files import read_tree, scan_tree, split_list
from tagloom.sources.spec import read_spec, spec_packages

ROWS = [
    ("s/a.tsx", "p", "Text", {"b": "1", "a": "2", "id": "x"}),
    ("s/a.tsx", "p", "Text", {"a": "2", "b": "1"}),
    ("s/b.tsx", "p", "Box", {"a": "3"}),
    ("t/c.tsx", "q", "Text", {}),
]


def used(spark):
    return spark.createDataFrame(ROWS, "rel_path string, package string, component string, props map<string,string>").withColumn(
        "file_path", F.col("rel_path"))


def test_combinations(spark):
    rows = agg.combinations(used(spark)).collect()
    got = {tuple((e.key, e.value) for e in r.props_key): (r.n, r.n_files, r.n_props) for r in rows}
    assert got == {(("a", "2"), ("b", "1")): (2, 1, 2), (("a", "3"),): (1, 1, 1), (): (1, 1, 0)}


def test_one_scope_for_all_tables(spark):
    report = prop_report(used(spark), "p", "Text")
    assert [tuple(r) for r in report.totals.collect()] == [("a", 2), ("b", 2)]
    assert report.combinations.count() == 1
    assert [(r.file_path, r.n) for r in report.files.collect()] == [("s/a.tsx", 2)]
    wide = usage_table(used(spark), ["a", "b"])
    assert wide.columns == ["props_key", "n", "prop a", "prop b"]
    assert sorted(tuple(r)[1:] for r in wide.collect()) == [(1, "-", "-"), (1, "3", "-"), (2, "2", "1")]


def test_skeletons(spark):
    rules = rule_table(used(spark), {"new_component": "N", "import_to": "new"}, ["p", "q"], "Text", "p").orderBy("rule_order")
    got = [(r.package, r.rule_order, [t.key for t in r.any_of[0]], r.import_from, r.new_component) for r in rules.collect()]
    assert got == [("p", 1, ["a", "b"], "p", "N")]


def test_directories(spark):
    got = {r.prefix: (r.n_usages, r.n_files) for r in agg.directory_rollup(used(spark)).collect()}
    assert got == {"s": (3, 2), "s/a.tsx": (2, 1), "s/b.tsx": (1, 1), "t": (1, 1), "t/c.tsx": (1, 1)}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbering_over_many_partitions(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        check_numbering(spark)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def check_numbering(spark):
    rows = spark.range(20000).select((F.col("id") * 7919 % 20000).alias("v")).repartition(13)
    numbered = number_rows(rows, [F.col("v").desc()], "no")
    assert numbered.filter("v + no <> 20000").count() == 0
    assert numbered.select("no").distinct().count() == 20000


def test_component_index_with_one_hot_package(spark):
    rows = [("hot", f"c{i:04}") for i in range(900)] + [("a", "x"), ("z", "y"), ("z", "x")]
    index = agg.component_index(spark.createDataFrame(rows, "package string, component string"))
    got = {(r.package, r.component): (r.pkg_no, r.comp_no) for r in index.collect()}
    assert got[("a", "x")] == (1, 1) and got[("hot", "c0899")] == (2, 900) and got[("z", "y")] == (3, 2)


def test_package_rank(spark):
    listed = spark.createDataFrame([("bb",), ("a",), ("ccc",), ("aa",)], "package string")
    assert [r.package for r in rank_packages(listed).orderBy("pkg_rank").collect()] == ["ccc", "bb", "aa", "a"]


def test_migration_units_take_the_last(spark):
    rows = [("f", "p", "A"), ("f", "q", "B"), ("f", "q", "A"), ("g", "p", "Z")]
    units = agg.migration_units(spark.createDataFrame(rows, "file_path string, package string, component string"), ["p", "q"])
    assert sorted(map(tuple, units.collect())) == [("f", "q", "B", 3), ("g", "p", "Z", 1)]


def test_tree_to_stored_reports(spark, tmp_path):
    root = tmp_path / "tree"
    for path in ["a/x.tsx", "a/node_modules/y.tsx", "b/z.js", "b/readme.md"]:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text('import { Text } from "p";\n\n<Text a="1">\n  <Text b/>\n</Text>\n')
    scanned = scan_tree(spark, str(root), ["node_modules"])
    assert sorted(r.file_path for r in scanned.collect()) == [f"{root}/a/x.tsx", f"{root}/b/z.js"]
    assert scan_tree(spark, str(root)).count() == 3
    stored = store_reports(analyze_tree(spark, str(root), ["p"], "Text", ["node_modules"]), str(tmp_path / "out"))
    assert sorted(r.usage_id for r in stored.collect()) == ["a/x.tsx:3:0", "a/x.tsx:4:2", "b/z.js:3:0", "b/z.js:4:2"]
    assert distinct_elements(stored.unionByName(stored)).count() == 4
    summary = reports.read_summary(spark, str(tmp_path / "out" / "summary"))
    assert sorted(str(r.props) for r in summary.collect()) == ["{'a': '1'}"] * 2 + ["{'b': 'true'}"] * 2
    assert summary.first()["import"].local_name == "Text"


def test_a_tree_is_listed_and_read_by_tasks(spark, tmp_path):
    root = tmp_path / "a tree+%41"
    names = ["x.tsx", "a b/c+d/e%20f/ü.ts", "PROMO/y.js", "deep/PROMO.tsx", "one/two/three/four/z.jsx", "x.tsx.bak", "tsx", "one/x.TSX", ".git/x.ts",
             "_hidden/x.ts", "_k=v/x.ts", "_x.js", "_x=y.js", ".x.js", "_metadata.js", "_metadata/x.js", "dir.js/in.js", "gone._COPYING_/x.js", "empty.js"]
    for i, name in enumerate(names):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"" if name == "empty.js" else f"{i} \ufeffé\r\n".encode() * (i + 1))
    (root / "latin.js").write_bytes(b"\xef\xbb\xbf\xe9\xff\n")
    (root / "linked").symlink_to(root / "one")
    (root / "nothing.js").symlink_to(root / "not here")

    def rows(df):
        return sorted(tuple(r) for r in df.select("file_path", F.hex("code"), F.md5("code")).collect())

    listed = read_tree(spark, str(root))  # by Spark's own reader
    assert rows(scan_tree(spark, str(root))) == rows(scan_tree(spark, f"file://{root}/")) == rows(listed)
    assert rows(scan_tree(spark, str(root), ["PROMO"], ["js", "ts"])) == rows(
        read_tree(spark, str(root), ["js", "ts"]).filter(~F.contains("file_path", F.lit("/PROMO/"))))
    assert rows(scan_tree(spark, f"{root}/x.tsx")) == rows(read_tree(spark, f"{root}/x.tsx"))  # no folder
    assert not {f.rsplit("/", 1)[1] for f in scan_tree(spark, str(root)).inputFiles()} & {n.rsplit("/", 1)[-1] for n in names}  # not in the driver's list


def test_nested_documents(spark, tmp_path):
    imp = {"filePath": "/r/s/a.tsx", "type": "ImportSpecifier", "importType": "named", "importStm": "i", "localName": "T", "importedName": "Text"}
    use = {"name": "T", "filePath": "/r/s/a.tsx", "props": {"a": "1"}, "impObj": imp}
    (tmp_path / "u.json").write_text(json.dumps({"p": {"_imports": [imp], "s": {"d": {"a.tsx": [use, use]}, "b.tsx": [use]}}}))
    rows = reports.read_nested_usages(spark, str(tmp_path / "u.json"))
    assert sorted((r.package, r.rel_path, r.component, r["import"].imported_name) for r in rows.collect()) == [
        ("p", "s/b.tsx", "T", "Text"), ("p", "s/d/a.tsx", "T", "Text"), ("p", "s/d/a.tsx", "T", "Text")]
    assert sorted(map(tuple, reports.files_of_usages(rows).collect())) == [("p", "s/b.tsx", 1), ("p", "s/d/a.tsx", 2)]
    (tmp_path / "s.json").write_text(json.dumps({"p": {"T": [{"props": {"a": "1"}, "impObj": imp}]}}))
    row = reports.read_nested_summary(spark, str(tmp_path / "s.json")).collect()[0]
    assert (row.package, row.component, row.props, row.file_path) == ("p", "T", {"a": "1"}, "/r/s/a.tsx")


def test_spec(spark, tmp_path):
    document = {"old": {"oldImportPath": "p,longer,q", "compName": "Text"}, "new": {"newImportPath": "n", "importType": "named", "compName": "Label"}}
    (tmp_path / "spec.json").write_text(json.dumps(document, indent=1))
    spec = read_spec(spark, str(tmp_path / "spec.json"))
    assert spec.first().old_packages == ["longer", "p", "q"] and spec.first().new_component == "Label"
    assert [tuple(r) for r in spec_packages(spec).collect()] == [(0, "longer"), (1, "p"), (2, "q")]


def test_blacklist(spark):
    df = spark.createDataFrame([("dist/a.ts",), ("a/dist/b.ts",), ("a/dist.ts",), ("distance/a.ts",)], "p string")
    kept = df.filter(outside_directories(F.col("p"), split_list(" dist ,")))
    assert sorted(r.p for r in kept.collect()) == ["a/dist.ts", "distance/a.ts"]
    assert df.filter(outside_directories(F.col("p"), split_list(""))).count() == 4
