"""Scan a source tree and store who uses what."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tagloom.operators.extract import usages
from tagloom.sources.files import scan_tree
from tagloom.sources.reports import read_usages, write_summary, write_usages


def analyze_tree(
    spark: SparkSession, root: str, packages: Sequence[str], target: str | None = None, blacklist: Sequence[str] = ()
) -> DataFrame:
    """Located usages of a source tree, lazily."""
    return usages(scan_tree(spark, root, blacklist), packages, target, root, locate=True)


def store_reports(used: DataFrame, folder: str, mode: str = "error") -> DataFrame:
    """Write the usage table and the props summary; gives the stored usage table.

    The summary is written from the stored table, so the files are read once.
    """
    folder = folder.rstrip("/")
    write_usages(used, f"{folder}/usages", mode)
    stored = read_usages(used.sparkSession, f"{folder}/usages")
    write_summary(stored, f"{folder}/summary", mode)
    return stored
