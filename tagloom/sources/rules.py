"""Rule documents: JSON text to a rule table and back."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.schemas import RULE_DOCUMENT, RULE_FIELDS


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule table from JSON documents, one document per file; documents follow each other in the order of their names."""
    return parse_rules(spark.read.text(path, wholetext=True).withColumn("document", F.input_file_name()))


def rules_from_document(spark: SparkSession, document: Mapping | str) -> DataFrame:
    """Rule table from a document held in code: package -> component -> list of rules."""
    text = document if isinstance(document, str) else json.dumps(document)
    return parse_rules(spark.createDataFrame([(text,)], "value string"))


def rules_from_rows(
    spark: SparkSession, packages: Sequence[str], component: str, rules: Sequence[Mapping]
) -> DataFrame:
    """Rules written in code, bound to every package: the import source becomes the package."""
    document = {
        p: {component: [{**r, "importFrom": p} if r.get("importFrom") else dict(r) for r in rules]} for p in packages
    }
    return rules_from_document(spark, document)


def parse_rules(documents: DataFrame, value: str = "value") -> DataFrame:
    """Explode rule documents to one row per rule (``schemas.RULE_FIELDS``).

    ``rule_pos`` counts the rules of a package and component over all
    documents, in the order of column ``document`` (or of their texts) and of
    the rules in them, so no two rules share a position.
    """
    name = F.col("document") if "document" in documents.columns else F.col(value)
    per_package = documents.select(
        name.alias("document"), F.explode(F.from_json(value, RULE_DOCUMENT, {"mode": "FAILFAST"})).alias("package", "components")
    )
    per_component = per_package.select("document", "package", F.explode("components").alias("component", "rules"))

    def by_name(a: Column, b: Column) -> Column:
        return F.when(a["document"] < b["document"], -1).when(a["document"] > b["document"], 1).otherwise(0)

    # documents are configuration: what is sorted here are the lists of a component, not their rules
    lists = per_component.groupBy("package", "component").agg(F.array_sort(F.collect_list(F.struct("document", "rules")), by_name).alias("lists"))
    ordered = lists.select("package", "component", F.posexplode(F.flatten("lists.rules")).alias("rule_pos", "r"))
    return ordered.select(
        "package",
        "component",
        F.col("rule_pos").cast("bigint").alias("rule_pos"),
        F.coalesce("r.order", F.lit(0)).cast("bigint").alias("rule_order"),
        F.coalesce(F.size(F.map_keys(F.get("r.match", 0))), F.lit(0)).alias("specificity"),
        _any_of(F.coalesce("r.match", _no_clauses())).alias("any_of"),
        _none_of(F.coalesce("r.match", _no_clauses())).alias("none_of"),
        F.coalesce("r.remove", F.array().cast("array<string>")).alias("remove"),
        F.coalesce(
            F.transform(
                F.map_entries("r.rename"), lambda e: F.struct(e["key"].alias("source"), e["value"].alias("target"))
            ),
            F.array().cast("array<struct<source:string,target:string>>"),
        ).alias("rename"),
        F.coalesce(
            F.transform(F.map_entries("r.set"), _set_entry),
            F.array().cast("array<struct<key:string,value:string,literal:string>>"),
        ).alias("set"),
        F.coalesce("r.files", F.array().cast("array<string>")).alias("files"),
        F.col("r.newCompName").alias("new_component"),
        F.col("r.importFrom").alias("import_from"),
        F.col("r.importTo").alias("import_to"),
        F.col("r.replaceWith.code").alias("template"),
        F.col("r.replaceWith.INNER_PROPS").alias("inner_props"),
    )


def _no_clauses() -> Column:
    return F.array().cast("array<map<string,variant>>")


def _negated(key: Column) -> Column:
    return F.startswith(key, F.lit("!"))


def _term(entry: Column) -> Column:
    """Boolean true, or no value at all, asks for presence; any other value for equality as text."""
    kind = F.schema_of_variant(entry["value"])
    text = F.variant_get(entry["value"], "$", "string")
    value = F.when(kind == "VOID", "null").when((kind == "BOOLEAN") & (text == "true"), None).otherwise(text)
    return F.struct(
        F.when(_negated(entry["key"]), F.substring(entry["key"], 2, 1 << 30)).otherwise(entry["key"]).alias("key"),
        F.when(entry["value"].isNotNull(), value).alias("value"),
    )


def _checked(clause: Column) -> Column:
    """The entries of a clause; plain and negated terms must not mix."""
    keys = F.map_keys(clause)
    mixed = F.exists(keys, _negated) & ~F.forall(keys, _negated)
    message = F.concat(F.lit("a match clause mixes plain and negated terms: "), F.array_join(keys, ", "))
    return F.when(mixed, F.raise_error(message).cast("array<struct<key:string,value:variant>>")).otherwise(
        F.map_entries(clause)
    )


def _any_of(match: Column) -> Column:
    entries = F.transform(match, _checked)
    positive = F.filter(entries, lambda c: ~F.exists(c, lambda e: _negated(e["key"])))
    return F.transform(positive, lambda c: F.transform(c, _term))


def _none_of(match: Column) -> Column:
    entries = F.flatten(F.transform(match, _checked))
    return F.transform(F.filter(entries, lambda e: _negated(e["key"])), _term)


def _set_entry(entry: Column) -> Column:
    kind = F.schema_of_variant(entry["value"])
    return F.struct(
        entry["key"].alias("key"),
        F.when(kind == "VOID", "null").otherwise(F.variant_get(entry["value"], "$", "string")).alias("value"),
        F.when(kind == "STRING", "text").when(kind == "BOOLEAN", "boolean").otherwise("other").alias("literal"),
    )


@dataclass(frozen=True)
class CompiledRules:
    """A rule table carried by the plan itself: JSON texts, in matching order."""

    texts: tuple[str, ...]

    @property
    def rows(self) -> list[dict]:
        return [json.loads(t) for t in self.texts]

    def array(self) -> Column:
        """The rules as a constant ARRAY<STRUCT>."""
        return F.from_json(F.lit("[" + ",".join(self.texts) + "]"), f"array<struct<{RULE_FIELDS}>>")


def compiled_rules(rules: DataFrame, mode: str = "first_match") -> CompiledRules:
    """A hand-written rule table for use without a join; it is brought to the driver whole.

    ``first_match`` keeps the order of the document; ``most_specific`` puts
    rules with more terms in their first clause first.
    """
    order = ["rule_pos"] if mode == "first_match" else [F.desc("specificity"), "rule_pos"]
    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    listed = rules.select("package", "component", "rule_pos", "specificity", text.alias("rule"))
    return CompiledRules(tuple(r["rule"] for r in listed.orderBy("package", "component", *order).collect()))


def write_rules(rules: DataFrame, folder: str, old_component: str, new_component: str, mode: str = "error") -> str:
    """Write rules as JSON lines below ``folder/<old>-to-<new>``, one line per rule.

    Each line is a complete document of one rule, so the rule table may be
    larger than one task; :func:`read_rule_lines` reads it back.
    """
    path = f"{folder.rstrip('/')}/{old_component}-to-{new_component}"
    rules.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)
    return path


def read_rule_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rule table from the lines :func:`write_rules` wrote."""
    lines = spark.read.text(path)
    return lines.select(F.from_json("value", f"struct<{RULE_FIELDS}>").alias("r")).select("r.*")


def rule_documents(rules: DataFrame) -> DataFrame:
    """Rules back in document form: one JSON text per package and component.

    Rule documents are configuration, so the rules of a component fit a row.
    """
    none = F.lit(None)

    def clause(terms: Column, prefix: str) -> Column:
        entries = F.transform(
            terms,
            lambda t: F.concat(
                F.to_json(F.array(F.concat(F.lit(prefix), t["key"]))), F.lit(":"),
                F.when(t["value"].isNull(), "true").otherwise(_json_text(t["value"])),
            ),
        )
        body = F.transform(entries, lambda e: F.regexp_replace(e, r'^\[("(?:[^"\\]|\\.)*")\]:', "$1:"))
        return F.concat(F.lit("{"), F.array_join(body, ","), F.lit("}"))

    match = F.concat(
        F.transform("any_of", lambda c: clause(c, "")),
        F.when(F.size("none_of") > 0, F.array(clause(F.col("none_of"), "!"))).otherwise(
            F.array().cast("array<string>")
        ),
    )
    sets = F.transform(
        "set",
        lambda e: F.concat(
            _json_text(e["key"]), F.lit(":"), F.when(e["literal"] == "text", _json_text(e["value"])).otherwise(e["value"])
        ),
    )
    renames = F.transform("rename", lambda e: F.concat(_json_text(e["source"]), F.lit(":"), _json_text(e["target"])))
    fields = [
        ("order", F.col("rule_order").cast("string")),
        ("match", F.concat(F.lit("["), F.array_join(match, ","), F.lit("]"))),
        ("set", F.concat(F.lit("{"), F.array_join(sets, ","), F.lit("}"))),
        ("remove", F.to_json("remove")),
        ("rename", F.when(F.size("rename") > 0, F.concat(F.lit("{"), F.array_join(renames, ","), F.lit("}")))),
        ("files", F.when(F.size("files") > 0, F.to_json("files"))),
        ("newCompName", _json_text(F.col("new_component"))),
        ("importFrom", _json_text(F.col("import_from"))),
        ("importTo", _json_text(F.col("import_to"))),
        (
            "replaceWith",
            F.when(
                F.col("template").isNotNull(),
                F.to_json(F.struct(F.col("template").alias("code"), F.col("inner_props").alias("INNER_PROPS"))),
            ),
        ),
    ]
    text = F.concat_ws(
        ",", *[F.when(v.isNotNull(), F.concat(F.lit(f'"{k}":'), v)).otherwise(none) for k, v in fields]
    )
    rows = rules.select("package", "component", "rule_pos", F.concat(F.lit("{"), text, F.lit("}")).alias("rule"))
    grouped = rows.groupBy("package", "component").agg(
        F.sort_array(F.collect_list(F.struct("rule_pos", "rule"))).alias("rules")
    )
    return grouped.select(
        "package",
        "component",
        F.concat(
            F.lit("{"), _json_text(F.col("package")), F.lit(":{"), _json_text(F.col("component")), F.lit(":["),
            F.array_join(F.col("rules.rule"), ","), F.lit("]}}"),
        ).alias("value"),
    )


def _json_text(text: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[([\s\S]*)\]$", "$1")
