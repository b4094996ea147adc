"""Turning computed arrays into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, array: Column, name: str) -> DataFrame:
    """One row per array entry, added as column ``name``.

    An inner ``explode`` makes the optimizer test ``size(array) > 0`` below the
    generator, which computes an expensive array twice.  The outer form plus a
    filter on the entry computes it once.
    """
    return df.select("*", F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
