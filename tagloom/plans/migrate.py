"""Rewrite files: look at the changes, or write them to a new table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tagloom.operators import changes
from tagloom.sources.rewritten import read_rewritten, write_rewritten


def dry_run(rewritten: DataFrame, context: int = 2) -> DataFrame:
    """Unified-diff hunks of what would change."""
    return changes.hunks(changes.changed_files(rewritten), context)


def apply(rewritten: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Write the changed files to a new table and give that table back."""
    write_rewritten(rewritten, path, mode)
    return read_rewritten(rewritten.sparkSession, path)
