"""Tables, the shared folder, and files in it.

Anything that one task writes and another reads goes below the session's
``spark.checkpoint.dir``; the driver's and the executors' own folders are never
used.  Files are reached through ``pyarrow.fs``, so the folder may be a local
mount, HDFS or an object store.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tagloom.operators.numbering import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new, empty place below the folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: what follows starts from files, not from a lineage."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark then deletes the shuffle files of jobs that are over."""
    spark._jvm.System.gc()


class Scratch:
    """A folder for tables between the steps of one operator, gone at the end of the ``with`` block.

    What the operator returns must not read from it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.tables = spark, shared_folder(spark, name), 0

    def __enter__(self) -> Scratch:
        return self

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written here once and read back."""
        self.tables += 1
        path = f"{self.folder}/{name}-{self.tables}"
        df.write.option("compression", "zstd").parquet(path)
        drop_shuffles(self.spark)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_) -> None:
        remove(self.spark, self.folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this module's own making."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def file_system(uri: str):
    """The pyarrow file system of a folder's URI and the path inside it."""
    from pyarrow import fs

    if uri.startswith("/"):
        uri = f"file://{uri}"
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write_file(uri: str, content: bytes) -> None:
    """Write under another name, then move: a repeated task never leaves half a file behind."""
    files, path = file_system(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(draft, compression=None) as out:
        out.write(content)
    files.move(draft, path)


def read_file(uri: str) -> bytes | None:
    files, path = file_system(uri)
    try:
        with files.open_input_stream(path, compression=None) as stream:
            return stream.read()
    except FileNotFoundError:
        return None


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about ``most`` bytes of text, so that long texts do not add up in memory."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total + size > most and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)
