"""Rewriting usages and files with matched rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import markup, rewriting
from tagloom.functions.lets import let
from tagloom.functions.matching import compiled_rule
from tagloom.operators.extract import mentioning, scanned, scanned_once, usages
from tagloom.operators.match import match_rules
from tagloom.operators.rows import each
from tagloom.sources.rules import compiled_rules


def removed(matched: DataFrame) -> DataFrame:
    """Matched usages after the rule's removals only."""
    return _with_attrs(matched, rewriting.remove_props(F.col("attrs"), F.col("rule")))


def renamed(matched: DataFrame) -> DataFrame:
    """Matched usages after removals and renames."""
    attrs = rewriting.remove_props(F.col("attrs"), F.col("rule"))
    return _with_attrs(matched, rewriting.rename_props(attrs, F.col("props"), F.col("rule")))


def value_set(matched: DataFrame) -> DataFrame:
    """Matched usages after the rule's set values only."""
    return _with_attrs(matched, rewriting.set_props(F.col("attrs"), F.col("rule")))


def applied(matched: DataFrame) -> DataFrame:
    """Matched usages after remove, rename and set."""
    return _with_attrs(matched, rewriting.apply_rule(F.col("attrs"), F.col("props"), F.col("rule")))


def _with_attrs(matched: DataFrame, attrs) -> DataFrame:
    """Add ``new_attrs`` and ``new_props``, each computed once."""
    others = matched.select("*", F.explode_outer(F.array(attrs)).alias("new_attrs"))
    return others.withColumn("new_props", markup.props_of(F.col("new_attrs")))


def template_split(matched: DataFrame) -> DataFrame:
    """Usages whose rule has a template, with their ``outer`` and ``inner`` attributes."""
    with_template = matched.filter(F.col("rule.template").isNotNull())
    split = rewriting.split_for_template(F.col("attrs"), F.col("props"), F.col("rule"))
    return each(with_template, F.array(split), "s").select(*matched.columns, "s.outer", "s.inner")


def template_rendered(matched: DataFrame, children) -> DataFrame:
    """Usages whose rule has a template, rendered around the given children."""
    with_template = matched.filter(F.col("rule.template").isNotNull())
    return with_template.withColumn(
        "rendered", rewriting.render_template(F.col("rule"), F.col("attrs"), F.col("props"), children)
    )


def with_mutation(matched: DataFrame) -> DataFrame:
    """Matched usages with ``mutated`` (the rule does something) and ``changed`` (some prop differs)."""
    new_attrs = rewriting.apply_rule(F.col("attrs"), F.col("props"), F.col("rule"))
    return matched.withColumn("mutated", rewriting.rule_mutates(F.col("rule"))).withColumn(
        "changed", F.col("rule.template").isNotNull() | (new_attrs["raw"] != F.col("attrs")["raw"])
    )


def rewrite_files(
    files: DataFrame,
    packages: Sequence[str],
    rules: DataFrame,
    target: str | None = None,
    mode: str = "first_match",
    rename_components: bool = False,
    compiled: bool = False,
) -> DataFrame:
    """Files with their text before and after the migration.

    (file_path, package, component, code_before, code_after, mutated,
    n_elements, n_matched, n_unsupported).  Files without usages of the target,
    or without rules for it, are not listed.  A file with unread tags of the target
    keeps its import.  Compiled rules are applied inside the file's own row
    (:func:`edits_in_rows`); otherwise the files are scanned and written once
    (``extract.scanned_once``, unless they are its result), usages are matched with the rules (any
    number of them, see ``match_rules``), the edits of a file are gathered and
    joined to its text.  Either way the text is put together once.
    """
    if not compiled:
        files = scanned_once(files, packages, target)
    edited = file_edits(files, packages, rules, target, mode, rename_components, compiled)
    if compiled:  # a generator again, so that what waits for the text to be put together is the edits and not the scan they come from
        others = [c for c in edited.columns if c != "code"]
        edited = each(edited, F.array(F.struct(*others)), "_row").select("code", "_row.*")
    else:
        found = F.when(F.size("scan.statements") > 0, F.col("scan.statements"))
        edited = files.select("file_path", "code", found.alias("statements")).hint("merge").join(edited, "file_path")  # small as files, not as texts
    code_after = rewriting.rewritten_text(F.col("code"), F.col("edits"), F.col("import"), F.col("component"), F.col("targets"), F.col("statements"))
    return edited.select(
        "file_path", "package", "component", F.col("code").alias("code_before"), code_after.alias("code_after"),
        "mutated", "n_elements", "n_matched", "n_unsupported",
    )


def file_edits(
    files: DataFrame,
    packages: Sequence[str],
    rules: DataFrame,
    target: str | None = None,
    mode: str = "first_match",
    rename_components: bool = False,
    compiled: bool = False,
) -> DataFrame:
    """What the rules do to each file, before any text is touched: enough to count a run.

    (file_path, package, component, import, edits, targets, mutated,
    n_elements, n_matched, n_unsupported); with compiled rules also the file's
    ``code`` and import ``statements``.
    """
    if compiled:
        return edits_in_rows(files, packages, rules, target, mode, rename_components)
    used = usages(scanned_once(files, packages, target), packages, target, spans=True)
    known = rules.select("package", F.col("component").alias("resolved")).distinct()
    ruled = used.join(F.broadcast(known), ["package", "resolved"], "left_semi").select(*used.columns)
    matched = match_rules(ruled, rules, mode, keep_unmatched=True, stored=True)
    tag = {c: F.col(f"tag_{c}") for c in _TAG}
    edit = rewriting.tag_edit(tag, F.col("component"), F.col("attrs"), F.col("props"), F.col("rule"), rename_components)
    edits = matched.select("file_path", "package", "resolved", "import", "n_unread", F.when(F.col("rule").isNotNull(), edit).alias("e"))
    kept = F.when(F.col("e.text").isNotNull() | F.col("e.closing").isNotNull(), F.struct(*[f"e.{c}" for c in _PLACES]))
    per_file = edits.groupBy("file_path").agg(
        F.first("package").alias("package"), F.first("resolved").alias("component"), F.first("import").alias("import"),
        F.max("n_unread").alias("n_unread"), F.collect_list(kept).alias("edits"),
        F.sort_array(F.collect_set("e.import_to")).alias("targets"), F.coalesce(F.bool_or("e.mutates"), F.lit(False)).alias("mutated"),
        F.count("*").cast("int").alias("n_elements"), F.count("e").cast("int").alias("n_matched"),
        F.count_if("e.unsupported").cast("int").alias("n_unsupported"),
    )
    return per_file.withColumn("targets", _moves(F.col("n_unread"), F.col("targets"))).drop("n_unread")


_TAG = ("kind", "start", "stop", "close_start", "close_stop")
_PLACES = ("start", "stop", "text", "close_start", "close_stop", "closing")


def _moves(n_unread: Column, targets: Column) -> Column:
    return F.when(n_unread == 0, targets).otherwise(F.array().cast("array<string>"))


def edits_in_rows(
    files: DataFrame, packages: Sequence[str], rules: DataFrame, target: str | None, mode: str, rename_components: bool
) -> DataFrame:
    """:func:`file_edits` with rules that travel in the plan: one pass over the files, no join, no shuffle."""
    constant = compiled_rules(rules, mode)
    owners = list(dict.fromkeys((r["package"], r["component"]) for r in constant.rows))
    read = mentioning(files, packages).select("file_path", "code", scanned("code", target, statements=True).alias("scan"))
    found = read.select("file_path", "code", "scan", markup.first_import(F.col("scan.imports"), packages, target).alias("import"))
    owned = found.select("*", F.col("import.package").alias("package"), markup.component_name(F.col("import")).alias("component"))

    def edit(tag: Column) -> Column:
        parts = {c: tag[c] for c in _TAG}
        return let(markup.props_of(tag["attrs"]), lambda props: let(
            F.get(constant.array(), compiled_rule(constant.rows, F.col("package"), F.col("component"), props)),
            lambda rule: F.when(rule.isNotNull(), rewriting.tag_edit(parts, tag["name"], tag["attrs"], props, rule, rename_components)),
        ))

    ruled = reduce(lambda a, b: a | b, [(F.col("package") == p) & (F.col("component") == c) for p, c in owners], F.lit(False))
    tags = F.when(ruled & (F.size("scan.tags") > 0), F.array(F.transform("scan.tags", edit)))
    rows = each(owned, tags, "e")  # a generator, so that what follows does not compute the edits again
    matched = F.filter("e", lambda x: x.isNotNull())
    places = F.transform(
        F.filter("e", lambda x: x["text"].isNotNull() | x["closing"].isNotNull()), lambda x: F.struct(*[x[c].alias(c) for c in _PLACES])
    )
    to = F.array_sort(F.array_distinct(F.filter(F.transform("e", lambda x: x["import_to"]), lambda x: x.isNotNull())))
    return rows.select(
        "file_path", "package", "component", "import", places.alias("edits"), _moves(F.size("scan.unread"), to).alias("targets"),
        F.exists(matched, lambda x: x["mutates"]).alias("mutated"), F.size("e").alias("n_elements"), F.size(matched).alias("n_matched"),
        F.size(F.filter(matched, lambda x: x["unsupported"])).alias("n_unsupported"), "code", F.col("scan.statements").alias("statements"),
    )
