"""Binding and reusing column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    A lambda body is evaluated per array entry, and so is any expression it
    captures; binding the captured value first keeps that linear.
    """
    return F.get(F.transform(F.array(value), body), 0)


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the expression a function builds from names and constants.

    Large expressions take thousands of calls into the JVM to build, so the
    same one is not built twice in an application.  Arguments must be hashable.
    """
    kept: dict[tuple, Column] = {}

    @wraps(build)
    def reuse(*args: object) -> Column:
        context = SparkContext._active_spark_context
        key = (context.applicationId if context else None, *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return reuse
