"""Usage reports and props summaries on disk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.tables import written_once
from tagloom.schemas import SPECIFIER, USAGES


def write_usages(used: DataFrame, path: str, mode: str = "error") -> None:
    """Usage table as parquet, one folder per package, so that a package is read alone."""
    used.write.mode(mode).partitionBy("package").parquet(path)


def read_usages(spark: SparkSession, path: str) -> DataFrame:
    """Usage table written by :func:`write_usages`."""
    return spark.read.parquet(path)


def write_summary(used: DataFrame, path: str, mode: str = "error") -> None:
    """Props summary as JSON lines: one usage's props and import per line."""
    used.select("package", "component", "props", "import").write.mode(mode).json(path)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Props summary written by :func:`write_summary`."""
    schema = f"package string, component string, props map<string,string>, import {SPECIFIER}"
    return spark.read.schema(schema).json(path)


_NESTED_IMPORT = (
    "struct<filePath:string,type:string,importType:string,importStm:string,localName:string,importedName:string>"
)


def _import_struct(nested: str):
    fields = {
        "package": F.col("package"), "pos": F.lit(None).cast("int"), "specifier_type": F.col(f"{nested}.type"),
        "import_type": F.col(f"{nested}.importType"), "import_stm": F.col(f"{nested}.importStm"),
        "local_name": F.col(f"{nested}.localName"), "imported_name": F.col(f"{nested}.importedName"),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def read_nested_summary(spark: SparkSession, path: str) -> DataFrame:
    """Props summary from nested documents: package -> component -> [{props, impObj}]."""
    shape = f"map<string,map<string,array<struct<props:map<string,string>,impObj:{_NESTED_IMPORT}>>>>"
    documents = spark.read.text(path, wholetext=True)
    packages = documents.select(F.explode(F.from_json("value", shape)).alias("package", "components"))
    components = packages.select("package", F.explode("components").alias("component", "list"))
    rows = components.select("package", "component", F.explode("list").alias("u"))
    return rows.select(
        F.col("u.impObj.filePath").alias("file_path"), "package", "component", "u.props",
        _import_struct("u.impObj").alias("import"),
    )


def read_nested_usages(spark: SparkSession, path: str) -> DataFrame:
    """Usage table from files with nested documents (see :func:`nested_usages`)."""
    return nested_usages(spark.read.text(path, wholetext=True))


def nested_usages(documents: DataFrame, value: str = "value") -> DataFrame:
    """Usage table from nested documents: package -> directory tree -> file -> [usage].

    Documents are read as VARIANT and opened one level of directories at a time:
    entries that are lists are files and give their usages, entries that are
    objects are the next level.  Every level is written once, so a document of
    any depth or size never has to fit a task.  The ``_imports`` branch of a
    package is not a directory and is skipped; text that is not JSON, and entries
    that are neither list nor object, are left out.
    """
    found, level = [], _entries(documents.select(F.lit(None).cast("string").alias("package"), F.lit("").alias("rel_path"), F.try_parse_json(value).alias("node")))
    level = level.select(F.col("key").alias("package"), F.lit("").alias("rel_path"), "node")
    while True:
        level = written_once(level)
        usages = F.try_variant_get("node", "$", "array<variant>")
        found.append(level.select("package", "rel_path", F.explode(usages).alias("usage")))
        below = _entries(level).filter("key <> '_imports'")
        path = F.when(F.col("rel_path") == "", F.col("key")).otherwise(F.concat("rel_path", F.lit("/"), "key"))
        below = below.select("package", path.alias("rel_path"), "node")
        if below.isEmpty():
            break
        level = below
    shape = f"struct<name:string,filePath:string,local:string,props:map<string,string>,impObj:{_NESTED_IMPORT}>"
    rows = reduce(lambda a, b: a.unionByName(b), found).select("package", "rel_path", F.try_variant_get("usage", "$", shape).alias("u"))
    return rows.select(
        F.col("u.filePath").alias("file_path"), "rel_path", "package", F.col("u.name").alias("component"),
        F.col("u.impObj.localName").alias("local_name"), "u.props", _import_struct("u.impObj").alias("import"),
    )


def _entries(nodes: DataFrame) -> DataFrame:
    """The entries of the nodes that are objects: package, rel_path, key, node."""
    opened = nodes.select("package", "rel_path", F.explode(F.try_variant_get("node", "$", "map<string,variant>")).alias("key", "node"))
    return opened.filter(F.col("node").isNotNull())


def files_of_usages(used: DataFrame) -> DataFrame:
    """Usages counted per file: the flattened directory tree."""
    return used.groupBy("package", "rel_path").agg(F.count("*").alias("n_usages"))
