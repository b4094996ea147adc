"""Source trees as a table of files."""

from __future__ import annotations

import math
import os
import posixpath
import re
from collections.abc import Iterator, Sequence
from contextlib import suppress
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.paths import outside_directories, relative_path
from tagloom.operators.tables import written_once

EXTENSIONS = ["js", "jsx", "ts", "tsx"]
#: Bytes of text that a reading task is given, a file counting 16 kB at least, and the text it hands on at a time.
TASK_BYTES, FILE_BYTES, BATCH_BYTES = 128 << 20, 16 << 10, 1 << 20
#: Names of files, and of directories, that Spark's readers pass over.
_HIDDEN = re.compile(r"\.|_[^=]*\Z|.*\._COPYING_\Z", re.S)
_HIDDEN_DIRECTORY = re.compile(r"(?!_metadata|_common_metadata)(?:\.|_[^=]*\Z|.*\._COPYING_\Z)", re.S)


def scan_tree(
    spark: SparkSession, root: str, blacklist: Sequence[str] = (), extensions: Sequence[str] = EXTENSIONS
) -> DataFrame:
    """(file_path, code) of every source file below a root, one row per file.

    Files with a blacklisted directory in their path below the root are left
    out; the path test reads file metadata only.  A folder of a local (or
    mounted) file system is listed and read by tasks, see :func:`tree_files`;
    any other root by Spark's own reader, which lists it on the driver.
    """
    folder = _local_folder(spark, root)
    plain = all(re.fullmatch(r"[\w.-]+", e) for e in extensions)
    found = tree_files(spark, folder, extensions) if folder and plain else read_tree(spark, root, extensions)
    kept = found.filter(outside_directories(relative_path(F.col("file_path"), local_path(root)), blacklist))
    return _texts(kept) if "size" in found.columns else kept


def read_tree(spark: SparkSession, root: str, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """(file_path, code) below any root that Spark can read."""
    pattern = "*.{" + ",".join(extensions) + "}"
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    plain = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))  # the metadata holds an encoded URI
    return files.select(F.regexp_replace(plain, r"^file:/+", "/").alias("file_path"), F.col("value").alias("code"))


def _local_folder(spark: SparkSession, root: str) -> str | None:
    """The plain path of a folder of the local file system, which executors share; None for any other root."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", root)
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    if (scheme[1] if scheme else default.partition(":")[0]) != "file" or not local_path(root).startswith("/"):
        return None
    folder = posixpath.normpath(re.sub(r"^/+", "/", local_path(root)))
    return folder if os.path.isdir(folder) else None


def tree_files(spark: SparkSession, folder: str, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """(file_path, size) of the source files below a local folder; hidden and empty ones are passed over, as Spark's reader does.

    One level of directories at a time, dealt over tasks; every level is written
    once, so no list of files passes through the driver.
    """
    endings = tuple(f".{e}" for e in extensions)
    kinds = {"path": pa.string(), "size": pa.int64(), "inner": pa.bool_()}

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch["path"].to_pylist():
                rows = []
                with os.scandir(folder) as found:
                    for entry in found:
                        inner = entry.is_dir()
                        if (_HIDDEN_DIRECTORY if inner else _HIDDEN).match(entry.name) or not (inner or entry.name.endswith(endings)):
                            continue
                        with suppress(FileNotFoundError):  # a link to nothing
                            size = entry.stat().st_size
                            if inner or size:
                                rows.append({"path": entry.path, "size": size, "inner": inner})
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    levels, below = [], spark.createDataFrame([(folder,)], "path string")
    while not below.isEmpty():
        level = written_once(below.mapInArrow(entries, "path string, size bigint, inner boolean"))
        levels.append(level.filter("NOT inner").select(F.col("path").alias("file_path"), "size"))
        below = level.filter("inner").select("path").repartition(_tasks(spark), "path")
    return reduce(lambda a, b: a.unionByName(b), levels)


def _tasks(spark: SparkSession) -> int:
    """Tasks to deal names over, which are too small for Spark to see the work behind them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _texts(files: DataFrame) -> DataFrame:
    """(file_path, code) of listed local files, dealt over tasks by their number and size."""
    total = files.agg(F.sum(F.greatest("size", F.lit(FILE_BYTES)))).first()[0] or 0
    schema = pa.schema({"file_path": pa.string(), "code": pa.binary()})

    def handed(rows: list[dict]) -> pa.RecordBatch:
        paths, codes = pa.RecordBatch.from_pylist(rows, schema).columns
        return pa.RecordBatch.from_arrays([paths, codes.view(pa.string())], schema.names)  # bytes as they are, also where they are no UTF-8

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path in batch["file_path"].to_pylist():
                with open(path, "rb") as source:
                    rows.append({"file_path": path, "code": source.read()})
                held += len(rows[-1]["code"])
                if held >= BATCH_BYTES:
                    yield handed(rows)
                    rows, held = [], 0
            if rows:
                yield handed(rows)

    tasks = max(_tasks(files.sparkSession), math.ceil(total / TASK_BYTES))
    return files.select("file_path").repartition(tasks, "file_path").mapInArrow(read, "file_path string, code string")


def split_list(text: str) -> list[str]:
    """A comma-separated option; blank entries do not count."""
    return [part for part in (p.strip() for p in text.split(",")) if part]


def local_path(uri: str) -> str:
    """A path without the scheme of a local file system."""
    return re.sub(r"^file:/+", "/", uri)


def write_tree(files: DataFrame, root: str) -> int:
    """Write every file (file_path, code) below a root that all executors share; the number of files."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(re.sub(r"^(?:file:)?/+", "file:///", root))
        for batch in batches:
            for path, code in zip(batch["file_path"], batch["code"], strict=True):
                place = f"{base}/{path}"
                store.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(place, compression=None) as out:
                    out.write((code or "").encode())
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("file_path", "code").mapInPandas(write, "n bigint").agg(F.sum("n")).first()[0] or 0
