"""Building rule tables: from a mapping table, and skeletons from usages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.operators.numbering import number_rows
from tagloom.operators.aggregates import combination_order
from tagloom.functions.props import key_text

# The two old props and their value order.
TYPES = ["body", "heading", "label", "link", "metric", "mono"]
SIZES = ["huge", "large", "medium", "small", "tiny"]
DEFAULT_TYPE = "body"
DEFAULT_SIZE = "medium"

# Fixed values: (type, size) -> variant.
VARIANTS = [
    ("heading", "huge", "headingLarge"),
    ("heading", "large", "headingLarge"),
    ("heading", "medium", "headingMedium"),
    ("heading", "small", "headingSmall"),
    ("label", "medium", "labelMedium"),
    ("label", "small", "labelMedium"),
    ("label", "tiny", "labelSmall"),
    ("body", "large", "headingSmall"),
    ("body", "medium", "headingTiny"),
    ("body", "small", "bodyRegular"),
    ("body", "tiny", "bodyMedium"),
    ("link", "medium", "linkStandalone"),
    ("link", "tiny", "linkStandalone"),
    ("metric", "large", "metricHuge"),
    ("metric", "medium", "metricLarge"),
    ("metric", "small", "metricMedium"),
    ("metric", "tiny", "metricSmall"),
    ("mono", "medium", "snippetRegular"),
    ("mono", "small", "snippetRegular"),
    ("mono", "tiny", "snippetMedium"),
]


def variant_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VARIANTS, "type string, size string, variant string")


def scenarios(spark: SparkSession) -> DataFrame:
    """Every size alone, every type alone, every type with every size; in that order."""
    sizes = F.posexplode(F.array(*[F.lit(s) for s in SIZES])).alias("size_no", "size")
    types = F.posexplode(F.array(*[F.lit(t) for t in TYPES])).alias("type_no", "type")
    one = spark.range(1)
    size_rows, type_rows = one.select(sizes), one.select(types)
    n_sizes, n_types = len(SIZES), len(TYPES)
    alone = size_rows.select("size", F.col("size_no").alias("scenario_no")).unionByName(
        type_rows.select("type", (F.col("type_no") + n_sizes).alias("scenario_no")), allowMissingColumns=True
    )
    both = type_rows.select("*", sizes).select(
        "type", "size", (F.col("type_no") * n_sizes + F.col("size_no") + n_sizes + n_types).alias("scenario_no")
    )
    return alone.unionByName(both)


def variant_clauses(scenario_rows: DataFrame, variants: DataFrame) -> DataFrame:
    """Scenarios that have a variant: the missing prop is looked up by its default."""
    looked_up = scenario_rows.select(
        "scenario_no", "type", "size",
        F.coalesce("type", F.lit(DEFAULT_TYPE)).alias("_type"),
        F.coalesce("size", F.lit(DEFAULT_SIZE)).alias("_size"),
    )
    table = variants.select(F.col("type").alias("_type"), F.col("size").alias("_size"), "variant")
    return looked_up.join(table, ["_type", "_size"]).drop("_type", "_size")


def _terms(type_: Column, size: Column) -> Column:
    """A clause of the terms that are given, size before type."""
    pair = F.array(
        F.struct(F.lit("size").alias("key"), size.alias("value")),
        F.struct(F.lit("type").alias("key"), type_.alias("value")),
    )
    return F.filter(pair, lambda t: t["value"].isNotNull())


def clauses_by_variant(clauses: DataFrame) -> DataFrame:
    """Variant with its list of clauses, in scenario order, numbered by first appearance.

    The input is the mapping table, a few dozen rows.
    """
    listed = clauses.groupBy("variant").agg(
        F.sort_array(F.collect_list(F.struct("scenario_no", _terms(F.col("type"), F.col("size")).alias("clause")))).alias("c")
    )
    return listed.select(
        "variant", F.get("c.scenario_no", 0).alias("first_no"), F.col("c.clause").alias("any_of")
    )


def _as_rules(df: DataFrame, component: str) -> DataFrame:
    """Fill in the rule columns a generated rule does not use."""
    empty = {
        "none_of": "array<struct<key:string,value:string>>",
        "remove": "array<string>",
        "rename": "array<struct<source:string,target:string>>",
        "set": "array<struct<key:string,value:string,literal:string>>",
        "files": "array<string>",
    }
    missing = {
        "new_component": "string", "import_from": "string", "import_to": "string",
        "template": "string", "inner_props": "array<string>",
    }
    columns = {c: F.col(c) for c in df.columns}
    for name, type_ in empty.items():
        columns.setdefault(name, F.array().cast(type_))
    for name, type_ in missing.items():
        columns.setdefault(name, F.lit(None).cast(type_))
    columns["component"] = F.lit(component)
    columns["specificity"] = F.coalesce(F.size(F.get("any_of", 0)), F.lit(0))
    names = (
        "package component rule_pos rule_order specificity any_of none_of remove rename set files "
        "new_component import_from import_to template inner_props"
    ).split()
    for name in ("rule_pos", "rule_order"):
        columns[name] = columns[name].cast("bigint")
    return df.select(*[columns[n].alias(n) for n in names])


def _set_variant() -> Column:
    return F.array(
        F.struct(F.lit("variant").alias("key"), F.col("variant").alias("value"), F.lit("text").alias("literal"))
    )


def for_each_package(df: DataFrame, packages: Sequence[str]) -> DataFrame:
    """Every row once per package, with the package's place in the list."""
    listed = F.array(*[F.lit(p) for p in packages])
    return df.select("*", F.posexplode(listed).alias("pkg_no", "package"))


def variant_rules(
    clauses: DataFrame, packages: Sequence[str], component: str, remove: Sequence[str], first_order: int, import_to: str | None = None
) -> DataFrame:
    """One rule per variant and package, numbered from ``first_order`` over both (variant first, then package).

    All inputs are configuration tables, so the numbering window is small.
    """
    numbered = clauses_by_variant(clauses).withColumn("rule_pos", F.row_number().over(Window.orderBy("first_no")) - 1)
    rows = for_each_package(numbered, packages)
    return _as_rules(
        rows.select(
            "package", "rule_pos",
            (F.col("rule_pos") * len(packages) + F.col("pkg_no") + first_order).alias("rule_order"),
            "any_of", F.array(*[F.lit(p) for p in remove]).alias("remove"), _set_variant().alias("set"),
            F.col("package").alias("import_from"), F.lit(import_to).cast("string").alias("import_to"),
        ),
        component,
    )


def mapping_rules(clauses: DataFrame, packages: Sequence[str], component: str) -> DataFrame:
    """One rule per mapped scenario and package, most terms first, scenario order among equals."""
    terms = _terms(F.col("type"), F.col("size"))
    order = Window.orderBy(F.desc("_n"), "scenario_no")
    rows = clauses.withColumn("_clause", terms).withColumn("_n", F.size("_clause"))
    rows = for_each_package(rows.withColumn("rule_pos", F.row_number().over(order) - 1), packages)
    return _as_rules(
        rows.select(
            "package", "rule_pos", F.lit(999).alias("rule_order"), F.array("_clause").alias("any_of"),
            F.transform("_clause", lambda t: t["key"]).alias("remove"), _set_variant().alias("set"),
        ),
        component,
    )


def bind_to_packages(rules: DataFrame, packages: Sequence[str]) -> DataFrame:
    """Every rule for every package; a rule with an import source gets the package as source."""
    others = [c for c in rules.columns if c not in ("package", "import_from")]
    return for_each_package(rules.drop("package"), packages).select(
        "package", *others, F.when(F.col("import_from").isNotNull(), F.col("package")).alias("import_from")
    ).select(*rules.columns)


def append_rules(first: DataFrame, then: DataFrame) -> DataFrame:
    """Two rule tables one after the other: the second keeps its order behind the first."""
    ends = first.groupBy("package", "component").agg((F.max("rule_pos") + 1).alias("_end"))
    moved = then.join(ends, ["package", "component"], "left").withColumn(
        "rule_pos", F.col("rule_pos") + F.coalesce("_end", F.lit(0))
    )
    return first.unionByName(moved.drop("_end"))


def by_specificity(rules: DataFrame) -> DataFrame:
    """Rules renumbered so that more terms in the first clause come first, order kept among equals.

    Per package and component; rule tables are configuration.
    """
    order = Window.partitionBy("package", "component").orderBy(F.desc("specificity"), "rule_pos")
    return rules.withColumn("rule_pos", (F.row_number().over(order) - 1).cast("bigint")).select(*rules.columns)


def skeletons(
    combos: DataFrame, spec: Mapping[str, str], packages: Sequence[str], component: str
) -> DataFrame:
    """A rule to fill in for every prop combination and package, numbered in report order.

    ``spec`` names ``new_component`` and ``import_to``.  Combinations come from
    the data, so they are numbered by range-sorted row numbers; the files of a
    combination stay in :func:`aggregates.combination_files`.
    """
    numbered = number_rows(
        combos.withColumn("_text", key_text(F.col("props_key"))), combination_order(F.col("_text")), "_no"
    )
    rows = for_each_package(numbered, packages)
    return _as_rules(
        rows.select(
            "package", (F.col("_no") - 1).alias("rule_pos"),
            ((F.col("_no") - 1) * len(packages) + F.col("pkg_no") + 1).alias("rule_order"),
            F.array("props_key").alias("any_of"),
            F.lit(spec["new_component"]).alias("new_component"), F.col("package").alias("import_from"),
            F.lit(spec["import_to"]).alias("import_to"),
        ),
        component,
    )
