"""Rewritten files on disk: a new table, never the files themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_rewritten(rewritten: DataFrame, path: str, mode: str = "error") -> None:
    """Changed files with their text before and after."""
    rewritten.filter("mutated").select("file_path", "code_before", "code_after").write.mode(mode).parquet(path)


def read_rewritten(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
