"""Attribution over stored import and element tables (the join form)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_packages(packages: DataFrame) -> DataFrame:
    """Packages with their rank: longest name first, ties in the order of the table, repeats once.

    The package list is configuration: it is one comma-separated text in the
    migration spec, so it is ranked inside one row.
    """
    placed = packages.select("package", F.monotonically_increasing_id().alias("pos"))
    listed = placed.agg(F.sort_array(F.collect_list(F.struct((-F.length("package")).alias("len"), "pos", "package"))).alias("all"))
    return listed.select(F.posexplode(F.array_distinct("all.package")).alias("pkg_rank", "package"))


def first_imports(imports: DataFrame, packages: Sequence[str]) -> DataFrame:
    """One import per file: best-ranked package, then text order.

    ``min_by`` aggregates partially, so a file or package with many imports
    costs one row per map task.
    """
    listed = F.array(*[F.lit(p) for p in packages])
    order = F.struct(F.array_position(listed, F.col("package")).alias("rank"), F.col("pos"))
    spec = F.struct(*[F.col(c) for c in imports.columns if c != "file_path"])
    return (
        imports.filter(F.col("package").isin(list(packages)))
        .groupBy("file_path")
        .agg(F.min_by(spec, order).alias("import"))
    )


def attribute(elements: DataFrame, imports: DataFrame, packages: Sequence[str]) -> DataFrame:
    """Element rows joined with the import their file is attributed to (inner)."""
    return elements.join(first_imports(imports, packages), "file_path").select(
        *elements.columns,
        F.col("import.package").alias("package"),
        F.col("import.local_name").alias("local_name"),
        F.col("import"),
    )


def with_declaration(used: DataFrame, imports: DataFrame) -> DataFrame:
    """Usages joined with the import statement of the same file and package.

    Several specifiers of one statement, or several statements, give one row:
    the last statement in the text is kept.  The packages of a file meet in its
    row, so tables bucketed by file need no shuffle.
    """
    last = imports.groupBy("file_path", "package").agg(F.max_by("import_stm", "pos").alias("import_stm"))
    per_file = last.groupBy("file_path").agg(F.map_from_entries(F.collect_list(F.struct("package", "import_stm"))).alias("_statements"))
    found = used.join(per_file, "file_path").withColumn("import_stm", F.try_element_at("_statements", F.col("package")))
    return found.filter(F.col("import_stm").isNotNull()).drop("_statements")


def in_packages(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """Import rows of the listed packages.

    Whether the list is broadcast is left to Spark, which knows its size.
    """
    return imports.join(packages.select("package").distinct(), "package", "left_semi")


def scope(package: str | None = None, component: str | None = None) -> Column:
    """Whether a usage is in scope: all packages, one package, or one component of it."""
    inside = F.lit(True)
    if package is not None:
        inside = inside & (F.col("package") == package)
    return inside & (F.col("component") == component) if component is not None else inside


def in_scope(used: DataFrame, package: str | None = None, component: str | None = None) -> DataFrame:
    """The usages in scope."""
    return used.filter(scope(package, component))
