"""Migration specs: what component moves from which packages to where."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.schemas import SPEC


def read_spec(spark: SparkSession, path: str) -> DataFrame:
    """(old_packages, old_component, new_package, import_type, new_component), longest package first.

    Packages of the same length keep the order of the document.
    """
    raw = spark.read.schema(SPEC).json(path, multiLine=True)
    indexed = F.transform(
        F.split("old.oldImportPath", ","), lambda p, i: F.struct((-F.length(p)).alias("len"), i.alias("i"), p.alias("p"))
    )
    return raw.select(
        F.transform(F.sort_array(indexed), lambda x: x["p"]).alias("old_packages"),
        F.col("old.compName").alias("old_component"),
        F.col("new.newImportPath").alias("new_package"),
        F.col("new.importType").alias("import_type"),
        F.col("new.compName").alias("new_component"),
    )


def spec_packages(spec: DataFrame) -> DataFrame:
    """The old packages with their rank."""
    return spec.select(F.posexplode("old_packages").alias("pkg_rank", "package"))
