"""Named queries over the standard tables: one or more per operator.

Every query reads whole tables.  Results end in scalar columns; prop maps are
shown as sorted ``name=value`` text.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.catalog import bindings as b
from tagloom.catalog.demo_rules import MAPPED_FROM, demo_rules
from tagloom.functions import markup, paths
from tagloom.functions import props as p
from tagloom.operators import aggregates as agg
from tagloom.operators import attribute, changes, extract, imports, match, rewrite
from tagloom.operators import rules as rule_ops
from tagloom.operators.tables import work_folder, written_once
from tagloom.plans import migrate
from tagloom.sources import files, reports, spec
from tagloom.sources import rules as rules_io
from tagloom.sources.store import UsageStore, write_store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register a query; whole numbers come out as BIGINT, as they do in its twin."""

    @wraps(function)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        result = function(spark, sf)
        small = [f.name for f in result.schema.fields if f.dataType.typeName() == "integer"]
        return result.withColumns({name: F.col(name).cast("bigint") for name in small})

    QUERIES[function.__name__] = run
    return function


def _usages(spark: SparkSession, sf: str, locate: bool = False, typed: bool = False) -> DataFrame:
    return extract.usages(b.code_files(spark, sf, typed), b.PACKAGES, b.TARGET, b.ROOT, locate)


def _matched(spark: SparkSession, sf: str, mode: str = "first_match") -> DataFrame:
    return match.match_rules(_usages(spark, sf), demo_rules(spark), mode, compiled=True)


def _rewritten(spark: SparkSession, sf: str) -> DataFrame:
    return rewrite.rewrite_files(b.code_files(spark, sf), b.PACKAGES, demo_rules(spark), b.TARGET, compiled=True)


def _moves(spark: SparkSession, sf: str) -> DataFrame:
    return imports.file_moves(b.code_files(spark, sf), b.PACKAGES, demo_rules(spark), b.TARGET, compiled=True)


def _text(column: str):
    return p.props_text(F.col(column))


# ---- extraction ----


@query
def element_usages(spark: SparkSession, sf: str) -> DataFrame:
    """Elements of web pages with their attributes."""
    rows = extract.page_element_rows(b.pages(spark, sf))
    return rows.select("file_path", "package", "component", "pos", _text("props").alias("props"))


@query
def prop_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Every attribute of every element, with its normalised value and kind."""
    rows = extract.element_rows(b.code_files(spark, sf))
    return rows.select("file_path", "pos", "component", F.posexplode("attrs").alias("attr_no", "a")).select(
        "file_path", "pos", "component", "attr_no", F.nullif("a.name", F.lit("")).alias("prop"),
        F.when(F.col("a.kind") != "spread", F.col("a.value")).alias("value"), "a.kind",
    )


@query
def prop_values(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded values of all elements, imported or not."""
    rows = extract.prop_rows(extract.element_rows(b.code_files(spark, sf)), ignored=True)
    return rows.groupBy("component", "prop", "value").agg(F.count("*").alias("n"))


@query
def rel_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths relative to the scan root, without two directories."""
    files = b.code_files(spark, sf).select("file_path")
    rel = paths.relative_path(F.col("file_path"), b.ROOT)
    kept = files.filter(paths.outside_directories(rel, ["PROMO", "Brand#13"]))
    return kept.select(
        "file_path", rel.alias("rel_path"), F.substring_index(rel, "/", -1).alias("file_name"),
        F.size(F.split(rel, "/")).alias("depth"),
    )


@query
def import_specifiers(spark: SparkSession, sf: str) -> DataFrame:
    return extract.import_rows(b.code_files(spark, sf)).select(
        "file_path", "package", "pos", "specifier_type", "import_type", "import_stm", "local_name", "imported_name"
    )


@query
def target_imports(spark: SparkSession, sf: str) -> DataFrame:
    """Imports of the listed packages under the target name."""
    rows = extract.import_rows(b.code_files(spark, sf), b.PACKAGES, b.TARGET)
    name = markup.component_name(F.struct("import_type", "local_name", "imported_name"))
    return rows.select("file_path", "package", "import_type", "imported_name", name.alias("component"))


@query
def package_members(spark: SparkSession, sf: str) -> DataFrame:
    """Import rows per listed package, the packages being a table."""
    listed = spark.createDataFrame([(x,) for x in b.PACKAGES], "package string")
    rows = attribute.in_packages(extract.import_rows(b.code_files(spark, sf)), listed)
    ranked = attribute.rank_packages(listed)
    counted = rows.groupBy("package").agg(F.count("*").alias("n"), F.count_distinct("local_name").alias("n_names"))
    return counted.join(ranked, "package").select("package", "pkg_rank", "n", "n_names")


@query
def usage_location(spark: SparkSession, sf: str) -> DataFrame:
    return _usages(spark, sf, locate=True).select("usage_id", "line", "column", "package", "component")


@query
def elements_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Elements seen twice (stored, and read again) are kept once."""
    once = _usages(spark, sf, locate=True).select("usage_id", "file_path", "package", _text("props").alias("props"))
    again = once.unionByName(once)
    return extract.distinct_elements(again).groupBy("package").agg(
        F.count("*").alias("n"), F.count_distinct("file_path").alias("n_files")
    )


@query
def selected_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Elements of the files that have at least one rule match with a template."""
    rows = match.match_rules(_usages(spark, sf), demo_rules(spark), keep_unmatched=True, compiled=True)
    per_file = rows.groupBy("file_path").agg(
        F.count("*").alias("n_elements"), F.max("pos").alias("last_pos"), F.bool_or(F.col("rule.template").isNotNull()).alias("chosen")
    )
    return per_file.filter("chosen").drop("chosen")


# ---- attribution ----


@query
def attributed_usages(spark: SparkSession, sf: str) -> DataFrame:
    return _usages(spark, sf).select(
        "file_path", "rel_path", "pos", "package", "component", "local_name", "resolved",
        F.col("import.import_type").alias("import_type"), F.col("import.import_stm").alias("import_stm"),
        _text("props").alias("props"),
    )


@query
def attributed_join(spark: SparkSession, sf: str) -> DataFrame:
    """The same attribution from the stored imports and elements, without a shuffle."""
    store = write_store(b.code_files(spark, sf), b.TARGET)
    rows = attribute.attribute(store.elements, _target_imports(store), b.PACKAGES)
    return rows.select("file_path", "pos", "package", "component", F.col("import.import_type").alias("import_type"))


def _target_imports(store: UsageStore) -> DataFrame:
    return store.imports.filter(F.col("package").isin(b.PACKAGES) & (F.col("local_name") == b.TARGET))


@query
def unattributed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files with elements of the target but no import for them, read once."""
    return extract.unattributed(b.code_files(spark, sf), b.PACKAGES, b.TARGET)


@query
def usage_import_decl(spark: SparkSession, sf: str) -> DataFrame:
    """Usages with the import declaration of their file and package, from the store."""
    store = write_store(b.code_files(spark, sf), b.TARGET)
    used = attribute.attribute(store.elements, _target_imports(store), b.PACKAGES).select("file_path", "package", "pos")
    rows = attribute.with_declaration(used, store.imports.filter(F.col("package").isin(b.PACKAGES)))
    return rows.groupBy("package", "import_stm").agg(F.count("*").alias("n"))


@query
def reread_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Stored elements of the files of one brand that import the target from the first package, read again by range."""
    store = write_store(b.code_files(spark, sf), b.TARGET)
    chosen = _target_imports(store).filter((F.col("package") == b.PACKAGES[0]) & F.col("file_path").startswith("src/Brand#1"))
    rows = store.elements_of(chosen)
    return rows.groupBy("file_path").agg(F.count("*").alias("n_elements"), F.max("pos").alias("last_pos"))


@query
def scope_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Usages in three scopes: everything, one package, one component of it."""
    used = _usages(spark, sf).select("package", "component")
    scopes = {"all": F.lit(True), "package": attribute.scope(b.PACKAGES[1]), "component": attribute.scope(b.PACKAGES[0], b.TARGET)}
    counts = used.agg(*[F.count_if(where).alias(name) for name, where in scopes.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("scope"), F.col(name).alias("n")) for name in scopes])).alias("s")).select("s.*")


# ---- reports ----


@query
def usage_summary(spark: SparkSession, sf: str) -> DataFrame:
    return agg.usage_summary(_usages(spark, sf))


@query
def summary_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = agg.summary_rows(_usages(spark, sf))
    return rows.groupBy("package", "component", F.col("import.local_name").alias("local_name"),
                        _text("props").alias("props")).agg(F.count("*").alias("n"))


@query
def prop_levels(spark: SparkSession, sf: str) -> DataFrame:
    return agg.prop_levels(_usages(spark, sf))


@query
def page_prop_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes of web pages: overall, per host, per host and tag."""
    return agg.prop_levels(extract.page_element_rows(b.pages(spark, sf)))


@query
def event_prop_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of event records: overall and per event type."""
    events = extract.event_usages(b.table(spark, sf, "events"), "user_id", "event_type", "props", "events")
    return agg.prop_levels(events)


@query
def prop_value_freq(spark: SparkSession, sf: str) -> DataFrame:
    return agg.prop_value_frequency(_usages(spark, sf, typed=True))


@query
def prop_file_freq(spark: SparkSession, sf: str) -> DataFrame:
    return agg.prop_file_frequency(_usages(spark, sf))


@query
def prop_totals(spark: SparkSession, sf: str) -> DataFrame:
    return agg.prop_totals(_usages(spark, sf)).orderBy(F.desc("n"), "prop")


@query
def column_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Usages that carry each prop of the report table, as its totals row shows them."""
    totals = agg.prop_totals(_usages(spark, sf))
    return totals.select("prop", F.concat(F.col("n"), F.lit("x")).alias("total"), p.table_cell(F.col("prop")).alias("cell"))


@query
def distinct_props(spark: SparkSession, sf: str) -> DataFrame:
    return agg.distinct_props(_usages(spark, sf))


@query
def prop_combos(spark: SparkSession, sf: str) -> DataFrame:
    combos = agg.combinations(_usages(spark, sf))
    return combos.select(p.key_text(F.col("props_key")).alias("props"), "n", "n_files", "n_props")


@query
def combo_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files of each combination."""
    rows = agg.combination_files(_usages(spark, sf, typed=True))
    return rows.select(p.key_text(F.col("props_key")).alias("props"), "file_path", "n")


@query
def combo_table(spark: SparkSession, sf: str) -> DataFrame:
    """Combinations with their row number in report order."""
    text = p.key_text(F.col("props_key"))
    numbered = agg.numbered_combinations(agg.combinations(_usages(spark, sf, typed=True)), text)
    return numbered.select("row_no", text.alias("props"), "n", "n_props")


@query
def combo_count(spark: SparkSession, sf: str) -> DataFrame:
    return agg.count_combinations(_usages(spark, sf))


@query
def combo_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The report table in long form: a row for each prop of each combination, with the prop's total that orders the columns."""
    used = _usages(spark, sf)
    cells = agg.combination_cells(used)
    return cells.select(p.key_text(F.col("props_key")).alias("props"), "prop", "value", "n", "prop_total")


WIDTH = 3


def _wide(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    combos = written_once(agg.combinations(_usages(spark, sf)))
    return combos, agg.wide_columns_in_order(combos, WIDTH)


@query
def combo_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Combinations as a wide table in blocks of columns, most used props first."""
    combos, columns = _wide(spark, sf)
    return agg.wide_blocks(combos, columns, WIDTH).withColumn("props", p.key_text(F.col("props_key"))).drop("props_key")


@query
def pivot_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Which prop each column of the wide table shows."""
    return _wide(spark, sf)[1]


@query
def combo_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct combinations per component, package and over all, from sketches stored by two runs, beside the exact counts."""
    used = written_once(_usages(spark, sf).select("file_path", "package", "component", "props"))
    path = work_folder(spark)
    for run in (0, 1):
        agg.combination_sketches(used.filter(F.pmod(F.xxhash64("file_path"), F.lit(2)) == run)).write.parquet(f"{path}/run={run}")
    found = agg.merged_sketches(spark.read.parquet(path))
    keys = used.select("package", "component", p.props_text(p.reportable(F.col("props"))).alias("props")).distinct()
    exact = keys.groupingSets([[], [F.col("package")], [F.col("package"), F.col("component")]], F.col("package"), F.col("component")).agg(
        F.count_distinct("props").alias("n_exact"),
        F.when(F.grouping("package") == 1, "all").when(F.grouping("component") == 1, "package").otherwise("component").alias("level"),
    )
    same = [exact[c].eqNullSafe(found[c]) for c in ("level", "package", "component")]
    near = F.abs(found["n_estimated"] - exact["n_exact"]) <= F.ceil(0.06 * exact["n_exact"])
    return exact.join(found, same).select(exact["level"], exact["package"], exact["component"], "n_exact", near.alias("near"))


@query
def usages_per_file(spark: SparkSession, sf: str) -> DataFrame:
    return agg.usages_per_file(_usages(spark, sf))


@query
def props_per_usage(spark: SparkSession, sf: str) -> DataFrame:
    return agg.with_prop_count(_usages(spark, sf)).select("file_path", "pos", "n_props").orderBy(
        F.desc("n_props"), "file_path", "pos"
    )


@query
def directory_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return agg.directory_rollup(_usages(spark, sf))


@query
def component_index(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered choice list of hosts and tags."""
    return agg.component_index(extract.page_element_rows(b.pages(spark, sf)))


@query
def prop_names_locale(spark: SparkSession, sf: str) -> DataFrame:
    """Prop sets with their names in locale order."""
    key = p.prop_key(p.reportable(F.col("props")), locale_order=True)
    rows = _usages(spark, sf).select(F.array_join(F.transform(key, lambda e: e["key"]), ",").alias("names"))
    return rows.groupBy("names").agg(F.count("*").alias("n"))


# ---- rules ----


@query
def rule_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """How many usages each scenario of the mapping table describes exactly."""
    rows = _usages(spark, sf).select(F.col("props")["type"].alias("type"), F.col("props")["size"].alias("size"))
    counted = rows.groupBy("type", "size").agg(F.count("*").alias("n"))
    cases = rule_ops.scenarios(spark)
    same = cases["type"].eqNullSafe(counted["type"]) & cases["size"].eqNullSafe(counted["size"])
    return cases.join(counted, same, "left").select(
        "scenario_no", cases["type"], cases["size"], F.coalesce("n", F.lit(0)).alias("n")
    )


@query
def variant_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Usages per variant, looked up with the defaults for missing props."""
    rows = _usages(spark, sf).select(
        F.monotonically_increasing_id().alias("scenario_no"),
        F.col("props")["type"].alias("type"), F.col("props")["size"].alias("size"), "package",
    )
    found = rule_ops.variant_clauses(rows.drop("package"), rule_ops.variant_table(spark))
    return found.groupBy("variant").agg(F.count("*").alias("n"), F.count("type").alias("n_type"), F.count("size").alias("n_size"))


@query
def variant_clauses(spark: SparkSession, sf: str) -> DataFrame:
    """Variants with their clauses, and the usages that satisfy one of them."""
    clauses = rule_ops.variant_clauses(rule_ops.scenarios(spark), rule_ops.variant_table(spark))
    rules = rule_ops.variant_rules(clauses, b.PACKAGES, b.TARGET, ["type", "size"], MAPPED_FROM, b.NEW_PACKAGE)
    best = match.best_rules(match.distinct_prop_sets(_usages(spark, sf)), rules)
    counted = best.groupBy("package", "rule_pos").agg(F.sum("n").alias("n"))
    shown = rules.select(
        "package", "rule_pos", "rule_order", F.get("set.value", 0).alias("variant"), F.size("any_of").alias("n_clauses")
    )
    return shown.join(counted, ["package", "rule_pos"], "left").select(
        "package", "rule_pos", "rule_order", "variant", "n_clauses", F.coalesce("n", F.lit(0)).alias("n")
    )


@query
def package_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules from the mapping table, most terms first, with the usages they win."""
    clauses = rule_ops.variant_clauses(rule_ops.scenarios(spark), rule_ops.variant_table(spark))
    rules = rule_ops.mapping_rules(clauses, b.PACKAGES, b.TARGET)
    best = match.match_by_anchor(_usages(spark, sf).select("package", "component", "resolved", "props"), rules)
    return best.groupBy(
        "package", F.col("rule.rule_pos").alias("rule_pos"), F.get("rule.set.value", 0).alias("variant"),
        F.col("rule.specificity").alias("n_terms"),
    ).agg(F.count("*").alias("n"))


@query
def rebound_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The rules of one package bound to all packages, and the usages they win there."""
    own = demo_rules(spark).filter(F.col("package") == b.PACKAGES[0])
    rows = match.match_rules(_usages(spark, sf), rule_ops.bind_to_packages(own, b.PACKAGES), compiled=True)
    return rows.groupBy("package", F.col("rule.rule_pos").alias("rule_pos"), F.col("rule.import_from").alias("import_from")).agg(F.count("*").alias("n"))


@query
def rule_skeletons(spark: SparkSession, sf: str) -> DataFrame:
    """A rule to fill in for every combination and package."""
    rules = rule_ops.skeletons(
        agg.combinations(_usages(spark, sf)), {"new_component": "Label", "import_to": b.NEW_PACKAGE}, b.PACKAGES, b.TARGET
    )
    return rules.select(
        "package", "component", "rule_order", p.key_text(F.get("any_of", 0)).alias("match"), "new_component",
        "import_from", "import_to",
    )


# ---- matching ----


@query
def first_match(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf).select("file_path", "pos", "package", F.col("rule.rule_pos").alias("rule_pos"))


@query
def most_specific_match(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf, "most_specific").select("file_path", "pos", "package", F.col("rule.rule_pos").alias("rule_pos"))


@query
def negated_match(spark: SparkSession, sf: str) -> DataFrame:
    """Usages won by rules that only exclude props."""
    won = _matched(spark, sf).filter((F.size("rule.none_of") > 0))
    return won.select("file_path", "pos", _text("props").alias("props"))


@query
def unmatched_usages(spark: SparkSession, sf: str) -> DataFrame:
    """Usages without a matching rule."""
    rows = match.match_rules(_usages(spark, sf), demo_rules(spark), keep_unmatched=True, compiled=True)
    return rows.filter(F.col("rule").isNull()).groupBy("package", "resolved").agg(F.count("*").alias("n"))


@query
def match_anchor(spark: SparkSession, sf: str) -> DataFrame:
    """First match through the plan for large rule tables."""
    rows = match.match_by_anchor(_usages(spark, sf), demo_rules(spark))
    return rows.select("file_path", "pos", "package", F.col("rule.rule_pos").alias("rule_pos"))


@query
def files_without_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = match.without_rules(_usages(spark, sf), demo_rules(spark))
    return rows.groupBy("file_path", "package", "resolved").agg(F.count("*").alias("n_elements"))


# ---- rewriting ----


@query
def props_removed(spark: SparkSession, sf: str) -> DataFrame:
    rows = rewrite.removed(_matched(spark, sf))
    return rows.select("file_path", "pos", _text("new_props").alias("props"))


@query
def props_renamed(spark: SparkSession, sf: str) -> DataFrame:
    rows = rewrite.renamed(_matched(spark, sf).filter(F.size("rule.rename") > 0))
    return rows.select("file_path", "pos", _text("new_props").alias("props"))


@query
def props_set(spark: SparkSession, sf: str) -> DataFrame:
    rows = rewrite.value_set(_matched(spark, sf))
    return rows.select("file_path", "pos", _text("new_props").alias("props"))


@query
def rule_applied(spark: SparkSession, sf: str) -> DataFrame:
    rows = rewrite.applied(_matched(spark, sf))
    return rows.select(
        "file_path", "pos", F.col("rule.rule_pos").alias("rule_pos"), _text("new_props").alias("props"),
        p.render_attributes(F.col("new_attrs")).alias("rendered"),
    )


@query
def variant_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Usages per package and new variant."""
    rows = rewrite.applied(_matched(spark, sf))
    return rows.groupBy("package", F.coalesce(F.col("new_props")["variant"], F.lit("-")).alias("variant")).agg(
        F.count("*").alias("n")
    )


@query
def template_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = rewrite.template_split(_matched(spark, sf))
    return rows.select(
        "file_path", "pos", p.render_attributes(F.col("outer")).alias("outer_attrs"),
        p.render_attributes(F.col("inner")).alias("inner_attrs"),
    )


@query
def template_rendered(spark: SparkSession, sf: str) -> DataFrame:
    """Elements rendered through their template around their own children."""
    used = extract.usages(b.code_files(spark, sf), b.PACKAGES, b.TARGET, b.ROOT, children=True)
    matched = match.match_rules(used, demo_rules(spark), compiled=True)
    return rewrite.template_rendered(matched, F.col("children")).select("file_path", "pos", "rendered")


@query
def mutated_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = rewrite.with_mutation(_matched(spark, sf))
    return rows.groupBy("package", F.col("rule.rule_pos").alias("rule_pos"), "mutated", "changed").agg(F.count("*").alias("n"))


# ---- imports ----


@query
def imports_pruned(spark: SparkSession, sf: str) -> DataFrame:
    return imports.prune_imports(_moves(spark, sf)).select("file_path", "package", "specifier_type", "local_name")


@query
def imports_added(spark: SparkSession, sf: str) -> DataFrame:
    return imports.added_imports(_moves(spark, sf)).select("file_path", "package", "import_stm", "local_name")


@query
def imports_rewired(spark: SparkSession, sf: str) -> DataFrame:
    rows = imports.rewired_imports(_moves(spark, sf))
    return rows.groupBy("package", "specifier_type", "local_name").agg(F.count("*").alias("n"))


@query
def migration_units(spark: SparkSession, sf: str) -> DataFrame:
    """One unit per file over all it imports, also where that comes from several packages."""
    found = extract.import_rows(b.code_files(spark, sf), b.PACKAGES)
    name = markup.component_name(F.struct("import_type", "local_name", "imported_name"))
    return agg.migration_units(found.select("file_path", "package", name.alias("component")), b.PACKAGES)


# ---- change sets ----


@query
def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    return changes.changed_files(_rewritten(spark, sf))


@query
def line_changes(spark: SparkSession, sf: str) -> DataFrame:
    return changes.line_changes(changes.changed_files(_rewritten(spark, sf)))


def _edited_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents before and after an edit that changes words and adds blank lines."""
    docs = b.table(spark, sf, "documents")
    edited = F.replace(F.replace(F.col("text"), F.lit(" de "), F.lit(" of ")), F.lit("\n"), F.lit("\n\n"))
    return docs.select(
        F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("code_before"), edited.alias("code_after")
    )


@query
def document_line_changes(spark: SparkSession, sf: str) -> DataFrame:
    lines = changes.line_changes(_edited_documents(spark, sf))
    return lines.groupBy("file_path").agg(
        F.sum(F.greatest("n", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed")
    )


@query
def blank_moves_dropped(spark: SparkSession, sf: str) -> DataFrame:
    lines = changes.drop_blank_moves(changes.line_changes(_edited_documents(spark, sf)))
    return lines.select("file_path", F.md5("line").alias("line_hash"), "n")


@query
def change_hunks(spark: SparkSession, sf: str) -> DataFrame:
    """Unified-diff hunks of the changed files, blank moves left out."""
    return changes.strip_blank_hunk_lines(changes.hunks(changes.changed_files(_rewritten(spark, sf))))


@query
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    edited = rewrite.file_edits(b.code_files(spark, sf), b.PACKAGES, demo_rules(spark), b.TARGET, compiled=True)
    return changes.run_summary(edited)


# ---- stored tables ----


@query
def stored_usages(spark: SparkSession, sf: str) -> DataFrame:
    """Usages written by package and read back for one of them."""
    path = f"{work_folder(spark)}/usages"
    reports.write_usages(_usages(spark, sf), path)
    stored = reports.read_usages(spark, path).filter(F.col("package") == b.PACKAGES[1])
    return stored.groupBy("package", "component", F.col("import.import_type").alias("import_type"),
                          _text("props").alias("props")).agg(F.count("*").alias("n"))


@query
def stored_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Props summary written as JSON lines and read back."""
    path = f"{work_folder(spark)}/summary"
    reports.write_summary(_usages(spark, sf), path)
    return agg.prop_value_frequency(reports.read_summary(spark, path))


@query
def stored_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Stored usages flattened to usages per package and file."""
    path = f"{work_folder(spark)}/usages"
    reports.write_usages(_usages(spark, sf).select("package", "rel_path", "props"), path)
    return reports.files_of_usages(reports.read_usages(spark, path))


@query
def stored_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Generated rules written, read back and matched with the usages they came from."""
    used = _usages(spark, sf).select("package", "component", p.reportable(F.col("props")).alias("props"))
    keyed = used.withColumn("props_key", p.prop_key(F.col("props"))).groupBy("props_key").agg(F.count("*").alias("n"))
    combos = keyed.withColumn("n_props", F.size("props_key"))
    rules = rule_ops.skeletons(combos, {"new_component": "Label", "import_to": b.NEW_PACKAGE}, b.PACKAGES, b.TARGET)
    path = rules_io.write_rules(rules, work_folder(spark), b.TARGET, "Label")
    best = match.best_rules(match.distinct_prop_sets(used), rules_io.read_rule_lines(spark, path), "most_specific")
    return best.groupBy("package").agg(F.sum("n").alias("n"), F.count_distinct("rule_pos").alias("n_rules"))


@query
def stored_rewrites(spark: SparkSession, sf: str) -> DataFrame:
    """Rewritten files stored as a new table, with their line counts before and after."""
    stored = migrate.apply(_rewritten(spark, sf), f"{work_folder(spark)}/rewritten")
    lines = [F.size(F.split(c, "\n")).alias(f"lines_{c[5:]}") for c in ("code_before", "code_after")]
    return stored.select("file_path", *lines)


# ---- sources ----


@query
def tree_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The source files written as a tree and scanned without a blacklisted directory."""
    root = f"{work_folder(spark)}/tree"
    files.write_tree(b.code_files(spark, sf), root)
    found = files.scan_tree(spark, root, ["PROMO"])
    rel = paths.relative_path(F.col("file_path"), files.local_path(root))
    return found.select(rel.alias("file_path"), F.length("code").alias("n_chars"), F.md5("code").alias("code_hash"))


@query
def spec_packages(spark: SparkSession, sf: str) -> DataFrame:
    """The packages of a migration spec with their rank, and their usages."""
    old = {"oldImportPath": "@acme/ui,@acme/ui/Text,@acme/xy", "compName": "Text"}
    new = {"newImportPath": b.NEW_PACKAGE, "importType": "named", "compName": "Label"}
    path = f"{work_folder(spark)}/spec"
    spark.createDataFrame([(json.dumps({"old": old, "new": new}),)], "value string").write.text(path)
    ranked = spec.spec_packages(spec.read_spec(spark, path))
    counted = _usages(spark, sf).groupBy("package").agg(F.count("*").alias("n_usages"))
    return ranked.join(counted, "package").select("pkg_rank", "package", "n_usages")


@query
def nested_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Nested usage reports of trees of unequal depth, flattened to usages per package and file."""
    return reports.files_of_usages(reports.nested_usages(b.nested_reports(_usages(spark, sf))))


@query
def skeleton_rewrites(spark: SparkSession, sf: str) -> DataFrame:
    """All rules of ``rule_skeletons``, each with a value to set, applied to all files."""
    code = extract.scanned_once(b.code_files(spark, sf), b.PACKAGES, b.TARGET)
    combos = agg.combinations(extract.usages(code, b.PACKAGES, b.TARGET, b.ROOT))
    rules = rule_ops.skeletons(combos, {"new_component": "Label", "import_to": b.NEW_PACKAGE}, b.PACKAGES, b.TARGET)
    seen = F.array(F.struct(F.lit("seen").alias("key"), F.lit("true").alias("value"), F.lit("boolean").alias("literal")))
    done = rewrite.rewrite_files(code, b.PACKAGES, rules.withColumn("set", seen), b.TARGET, "most_specific")
    return done.filter("mutated").select("file_path", "package", "code_after")


# ---- source text beyond the generated files ----


@query
def nested_elements(spark: SparkSession, sf: str) -> DataFrame:
    """Elements in attribute values, template literals, deep braces and odd imports; none from strings and comments."""
    used = extract.usages(b.kit_files(spark, sf), b.PACKAGES, None)
    return used.filter(F.col("props")["n"].isNotNull()).groupBy("file_path", "component", F.col("props")["n"].alias("n")).agg(F.count("*").alias("found"))


@query
def unread_tags(spark: SparkSession, sf: str) -> DataFrame:
    return extract.unread_tags(b.kit_files(spark, sf), b.TARGET)
