"""Change sets between the text before and after."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tagloom.functions import batches, hunks as hunk_lines


def changed_files(rewritten: DataFrame) -> DataFrame:
    """Files whose rewrite counts as a change, before and after."""
    return rewritten.filter("mutated").select("file_path", "code_before", "code_after")


def line_changes(changed: DataFrame) -> DataFrame:
    """Lines added to and removed from each file, as a multiset difference.

    (file_path, line, n): ``n`` lines more (+) or fewer (-) after the change.
    One aggregation of signed lines; lines that stay cancel out.  A line that
    fills a whole file adds up to one row per map task before the shuffle.
    """
    sides = changed.select(
        "file_path",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("sign"), F.col("code_after").alias("code")),
                F.struct(F.lit(-1).alias("sign"), F.col("code_before").alias("code")),
            )
        ).alias("s"),
    )
    lines = sides.select("file_path", "s.sign", F.explode(F.split("s.code", "\n")).alias("line"))
    return lines.groupBy("file_path", "line").agg(F.sum("sign").alias("n")).filter("n <> 0")


def drop_blank_moves(lines: DataFrame) -> DataFrame:
    """Line changes without the ones that only move blank lines."""
    return lines.filter(F.col("line").rlike(r"\S"))


HUNKS = "file_path string, hunk int, header string, line_no int, op string, line string"


def hunks(changed: DataFrame, context: int = 2) -> DataFrame:
    """Unified-diff hunks per file, one row per line, with ``context`` lines around a change.

    Each file is compared inside its own row, in Arrow batches; files do not
    meet, so nothing is grouped or shuffled.  The lines of about a megabyte of
    texts make one batch: a batch a file costs more than the comparing.
    """
    # the helpers travel with the job, so executors need no copy of the package
    cloudpickle.register_pickle_by_value(hunk_lines)
    cloudpickle.register_pickle_by_value(batches)
    schema, stretches, lines_of = to_arrow_schema(StructType.fromDDL(HUNKS)), batches.stretches, hunk_lines.hunk_lines

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start, n in stretches(part.column("code_before")):
                texts = zip(*(column.to_pylist() for column in part.slice(start, n).columns), strict=True)
                rows = [row for path, old, new in texts for row in lines_of(path, old, new, context)]
                columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), field.type) for c, field in zip(columns, schema, strict=True)], schema=schema)

    return changed.select("file_path", "code_before", "code_after").mapInArrow(compare, HUNKS)


def strip_blank_hunk_lines(hunk_rows: DataFrame) -> DataFrame:
    """Hunk lines without added or removed blank lines; context lines stay."""
    return hunk_rows.filter((F.col("op") == " ") | F.col("line").rlike(r"\S"))


def run_summary(edited: DataFrame, apply: bool = False) -> DataFrame:
    """Files and elements changed, or that would change; from ``rewrite.file_edits``, so no text is written to count."""
    return (
        edited.filter("mutated")
        .groupBy("package", "component")
        .agg(F.count("*").alias("n_files"), F.sum("n_elements").alias("n_elements"))
        .withColumn("mode", F.lit("migrated" if apply else "would migrate"))
    )
