"""A co-located store of what files hold: imports and elements, bucketed and sorted by file.

Both tables have the same number of buckets on ``file_path``, so everything that
happens inside a file (attribution, declarations, counts per file) runs on
them without a shuffle.  Each text is read once, when the store is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import markup
from tagloom.operators.extract import scanned_files
from tagloom.operators.rows import each
from tagloom.operators.tables import bucket_count, open_files, work_folder

#: Ranges of file names that a list of files is summed up by for the reader of the store.
RANGES = 32


@dataclass(frozen=True)
class UsageStore:
    """Names of the two tables in the session's catalog."""

    spark: SparkSession
    imports_table: str
    elements_table: str

    @property
    def imports(self) -> DataFrame:
        return self.spark.read.table(self.imports_table)

    @property
    def elements(self) -> DataFrame:
        return self.spark.read.table(self.elements_table)

    def elements_of(self, selected: DataFrame) -> DataFrame:
        """Elements of the selected files (column ``file_path``), reading only row groups that can hold them."""
        near = self.elements.filter(in_ranges(F.col("file_path"), file_ranges(selected)))
        return near.join(selected.select("file_path").distinct(), "file_path", "left_semi")


def write_store(
    files: DataFrame, target: str | None = None, folder: str | None = None, name: str | None = None, buckets: int | None = None, row_group: int | None = None
) -> UsageStore:
    """Scan the files once and write their imports and elements (of the target, or all).

    ``buckets`` should grow with the data; it is the session's number of
    shuffle partitions unless given.  The columns are those of
    ``extract.import_rows`` and ``extract.element_rows``.

    Texts are dealt over the buckets and sorted by file before they are read, as
    the rows of their tags take many times their size.  Both tables come from
    one write, in that order: nothing is shuffled, sorted or stored in between.
    """
    spark = files.sparkSession
    folder, name = folder or work_folder(spark), name or f"store_{uuid.uuid4().hex}"
    buckets = buckets or bucket_count(spark)
    dealt = files.select("file_path", "code").repartition(buckets, "file_path").sortWithinPartitions("file_path")
    rows = _entries(scanned_files(dealt, target))
    writer = rows.write.format("parquet").partitionBy("part").bucketBy(buckets, "file_path").option("compression", "zstd")
    writer = writer.option("parquet.bloom.filter.enabled#file_path", "true").option("path", folder)
    if row_group is not None:
        writer = writer.option("parquet.block.size", row_group)
    with open_files(spark, len(_TABLES)):
        writer.saveAsTable(f"{name}_rows")
    for part, names in _TABLES.items():
        columns = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
        place = f"{folder}/part={part}".replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name}_{part} ({columns}) USING parquet CLUSTERED BY (file_path) SORTED BY (file_path) INTO {buckets} BUCKETS LOCATION '{place}'"
        )
    spark.sql(f"DROP TABLE {name}_rows")  # the files stay, under their two names
    return UsageStore(spark, f"{name}_imports", f"{name}_elements")


#: The tables of a store and their columns.
_TABLES = {
    "imports": ["file_path", "package", "pos", "specifier_type", "import_type", "import_stm", "local_name", "imported_name"],
    "elements": ["file_path", "pos", "component", "attrs", "props"],
}


def _entries(scans: DataFrame) -> DataFrame:
    """Imports and elements of scanned files as rows of one table; ``part`` tells them apart."""
    held = scans.schema["scan"].dataType
    import_type, tag_type = (held[c].dataType.elementType for c in ("imports", "tags"))
    no_import, no_tag = F.lit(None).cast(import_type), F.lit(None).cast(tag_type)

    def entry(part: str, s: Column, t: Column) -> Column:
        tag = F.struct(t["pos"].alias("pos"), t["name"].alias("name"), t["attrs"].alias("attrs"))
        return F.struct(F.lit(part).alias("part"), s.alias("s"), tag.alias("t"))

    both = F.concat(
        F.transform("scan.imports", lambda s: entry("imports", s, no_tag)), F.transform("scan.tags", lambda t: entry("elements", no_import, t))
    )
    rows = each(scans.select("file_path", both.alias("_both")), F.col("_both"), "e")
    read = rows.select(
        "file_path", F.coalesce("e.s.pos", "e.t.pos").alias("pos"), *[F.col(f"e.s.{c}").alias(c) for c in _TABLES["imports"] if c not in ("file_path", "pos")],
        F.col("e.t.name").alias("component"), F.col("e.t.attrs").alias("attrs"), F.col("e.part").alias("part"),
    )
    return read.withColumn("props", F.when(F.col("part") == "elements", markup.props_of(F.col("attrs"))))


def file_ranges(selected: DataFrame, most: int = RANGES) -> list[tuple[str, str]]:
    """At most ``most`` ranges of names that hold all selected files: first and last of each part of a range sort."""
    parted = selected.select("file_path").repartitionByRange(most, "file_path")
    ends = parted.groupBy(F.spark_partition_id().alias("part")).agg(F.min("file_path").alias("low"), F.max("file_path").alias("high"))
    return sorted((r["low"], r["high"]) for r in ends.collect() if r["low"] is not None)


def in_ranges(path: Column, ranges: Sequence[tuple[str, str]]) -> Column:
    """Whether a path is in one of the ranges: simple comparisons, which reach the row groups' statistics."""
    return reduce(lambda a, b: a | b, [(path >= low) & (path <= high) for low, high in ranges], F.lit(False))
