"""A store is written in one pass: texts are shuffled, and not the rows of their tags."""

import glob
import os

from pyspark.sql import functions as F

from tagloom.operators import extract
from tagloom.operators.numbering import ensure_checkpoint_dir
from tagloom.sources.store import write_store

UI = 'import React from "react";\nimport { Text, Box } from "p";\n'


def same(got, want):
    return sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_nothing_is_stored_beside_the_two_tables(spark, files_of):
    files = files_of({f"src/{i:03}.tsx": UI + f"<Text n={{{i}}} a='1' b='2'/>\n" * 5 for i in range(50)})
    ensure_checkpoint_dir(spark)
    work = spark.sparkContext._jsc.sc().getCheckpointDir().get().replace("file:", "")
    before = set(os.listdir(work))
    store = write_store(files, buckets=4)
    made = set(os.listdir(work)) - before
    assert len(made) == 1  # no table of scans is kept beside the store
    written = glob.glob(f"{work}/{made.pop()}/part=*/*.parquet")
    assert len(written) == 8 and all(t in str(written) for t in ("part=imports", "part=elements"))
    held = [t.name for t in spark.catalog.listTables() if t.name.startswith(store.imports_table[: -len("imports")])]
    assert sorted(held) == [store.elements_table, store.imports_table]
    elements = store.elements.select("file_path", "pos", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("row")).collect()
    for p in range(4):
        rows = [(r.file_path, r.pos) for r in sorted(elements, key=lambda r: r.row) if r.p == p]
        assert rows == sorted(rows)
    assert len(elements) == 250


def test_odd_files_are_stored_whole(spark, tmp_path):
    rows = [(None, UI + "<Text a='1'/>"), ("null", None), ("empty", ""), ("twice", UI + "<Text/>"), ("twice", UI + "<Text/><Box n={1} n={2} id='' {...r}/>"), ("none", "<Text/>")]
    files = spark.createDataFrame(rows, "file_path string, code string")
    store = write_store(files, folder=str(tmp_path / "it's here"), buckets=3)
    assert same(store.imports, extract.import_rows(files)) and store.imports.count() == 9
    assert same(store.elements, extract.element_rows(files).select("file_path", "pos", "component", "attrs", "props"))
    assert store.imports.columns == extract.import_rows(files).columns


def test_a_store_without_imports_or_elements_is_empty(spark, files_of):
    store = write_store(files_of({"a": "let x;"}), buckets=2)
    assert store.imports.count() == store.elements.count() == 0
    store = write_store(files_of({"a": "<Text/>"}), "Text", buckets=2)
    assert (store.imports.count(), store.elements.count()) == (0, 1)
