"""Tables written once between the steps of an operator."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tagloom.operators.numbering import ensure_checkpoint_dir


def work_folder(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"


def written_once(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back: several readers share one evaluation, and lineage ends at the files."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_count(spark: SparkSession) -> int:
    """Buckets of a table unless told otherwise: the session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def open_files(spark: SparkSession, most: int) -> Iterator[None]:
    """Writes in here keep up to ``most`` files of a task open, so that rows dealt by bucket are written as they come and not sorted by it first."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    kept = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, kept)


def bucketed_once(df: DataFrame, key: str) -> DataFrame:
    """:func:`written_once` in buckets of ``key``: what happens inside a key runs on the result without a shuffle.

    ``df`` should be dealt by ``key`` already, over :func:`bucket_count` partitions.
    """
    spark = df.sparkSession
    name = f"once_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(bucket_count(spark), key).option("compression", "zstd").option("path", work_folder(spark))
    with open_files(spark, 1):
        writer.saveAsTable(name)
    stored = spark.read.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table is read by this frame only
    return stored
