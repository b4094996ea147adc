"""Hunks of many files come in one batch."""

import pandas as pd
import pyarrow as pa

from tagloom.functions.hunks import COLUMNS, diff_rows
from tagloom.operators import changes

ROWS = [(f"f{i}" if i else None, "a\nb\nc\nd\n" * (i % 7), "a\nb\nx\nd\n" * (i % 7) + "y" * (i % 2)) for i in range(500)]


class Rows:
    """Takes the place of a frame and gives the function that is run on its batches."""

    def select(self, *names):
        assert names == ("file_path", "code_before", "code_after")
        return self

    def mapInArrow(self, function, kind):  # noqa: N802
        assert kind == changes.HUNKS
        return function


def test_a_batch_of_small_files_gives_one_batch(spark):
    columns = [pa.array(list(c), pa.string()) for c in zip(*ROWS)]
    part = pa.RecordBatch.from_arrays(columns, names=["file_path", "code_before", "code_after"])
    given = list(changes.hunks(Rows())(iter([part, part.slice(0, 0), part.slice(0, 1)])))
    assert [bool(g.num_rows) for g in given] == [True, False]
    want = pd.concat([diff_rows(*row, 2) for row in ROWS])
    assert [tuple(r.values()) for r in given[0].to_pylist()] == list(want[COLUMNS].itertuples(index=False, name=None))


def test_rows_are_those_of_each_file(spark):
    changed = spark.createDataFrame(ROWS, "file_path string, code_before string, code_after string")
    want = pd.concat([diff_rows(*row, 2) for row in ROWS])
    got = changes.hunks(changed).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want[COLUMNS].itertuples(index=False, name=None)))
