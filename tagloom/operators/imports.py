"""Import rewiring on import rows (the table form of what ``rewriting.rewritten_text`` does to the text)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import markup
from tagloom.functions.lets import let
from tagloom.functions.matching import compiled_rule
from tagloom.operators.extract import scanned_files
from tagloom.operators.match import match_rules
from tagloom.operators.rows import each
from tagloom.sources.rules import compiled_rules


def file_moves(
    files: DataFrame, packages: Sequence[str], rules: DataFrame, target: str, mode: str = "first_match", compiled: bool = False
) -> DataFrame:
    """Per file its import specifiers, the one its elements are attributed to, and the packages it moves to.

    (file_path, imports, import, targets); every file is read once.  A file with
    unread tags of the target moves nothing.
    """
    read = scanned_files(files, target)
    found = read.select("file_path", "scan", markup.first_import(F.col("scan.imports"), packages, target).alias("import"))
    if compiled:
        moves, of_file = _moves_in_rows(found, rules, mode), F.array_distinct(F.flatten(F.collect_list("targets")))
    else:
        moves, of_file = _moves_of_tags(found, rules, mode), F.collect_set("target")
    return moves.groupBy("file_path").agg(
        F.first("imports").alias("imports"), F.first("import").alias("import"), F.sort_array(of_file).alias("targets")
    )


def _moves_in_rows(found: DataFrame, rules: DataFrame, mode: str) -> DataFrame:
    """The packages a file moves to, with rules that travel in the plan: its tags stay in its row, so one row a file is grouped."""
    constant = compiled_rules(rules, mode)
    owned = found.select("*", F.col("import.package").alias("package"), markup.component_name(F.col("import")).alias("component"))

    def target_of(tag: Column) -> Column:
        return let(markup.props_of(tag["attrs"]), lambda props: let(
            F.get(constant.array(), compiled_rule(constant.rows, F.col("package"), F.col("component"), props)),
            lambda rule: F.when(rule["import_from"].isNotNull(), rule["import_to"]),
        ))

    moving = F.col("import").isNotNull() & (F.size("scan.unread") == 0)
    to = F.array_distinct(F.filter(F.transform("scan.tags", target_of), lambda x: x.isNotNull()))
    targets = F.when(moving, to).otherwise(F.array().cast("array<string>"))
    return owned.select("file_path", F.col("scan.imports").alias("imports"), "import", targets.alias("targets"))


def _moves_of_tags(found: DataFrame, rules: DataFrame, mode: str) -> DataFrame:
    """One row per tag with the package its rule moves it to, and one for a file without tags."""
    tags = F.when(F.col("import").isNotNull(), F.col("scan.tags"))
    used = found.select("file_path", F.col("scan.imports").alias("imports"), F.size("scan.unread").alias("n_unread"), "import", F.explode_outer(tags).alias("t"))
    used = used.select(
        "file_path", "imports", "n_unread", "import", F.col("import.package").alias("package"),
        markup.component_name(F.col("import")).alias("resolved"), markup.props_of(F.col("t.attrs")).alias("props"),
    )
    matched = match_rules(used, rules, mode, keep_unmatched=True)
    to = F.when(F.col("rule.import_from").isNotNull() & F.col("props").isNotNull() & (F.col("n_unread") == 0), F.col("rule.import_to"))
    return matched.select("file_path", "imports", "import", to.alias("target"))


def _moved(s: Column) -> Column:
    """Whether a specifier is the one that moves: a default import by its local name, a named one by its imported name."""
    spec = F.col("import")
    name = F.when(s["import_type"] == "default", s["local_name"]).otherwise(s["imported_name"])
    same = (s["package"] == spec["package"]) & (s["import_type"] == spec["import_type"]) & (name == spec["local_name"])
    return (F.size("targets") > 0) & F.coalesce(same, F.lit(False))


def _kept(moves: DataFrame) -> Column:
    return F.filter("imports", lambda s: ~_moved(s))


def _added(moves: DataFrame) -> Column:
    """One named specifier for each target that has none yet."""
    component = markup.component_name(F.col("import"))
    missing = F.filter("targets", lambda to: ~F.exists("imports", lambda s: (s["package"] == to) & F.coalesce(s["import_type"] == "named", F.lit(False))))
    return F.transform(
        missing,
        lambda to: F.struct(
            to.alias("package"), F.lit(-1).alias("pos"), F.lit("ImportSpecifier").alias("specifier_type"), F.lit("named").alias("import_type"),
            F.concat(F.lit("import { "), component, F.lit(' } from "'), to, F.lit('";')).alias("import_stm"),
            component.alias("local_name"), component.alias("imported_name"),
        ),
    )


def prune_imports(moves: DataFrame) -> DataFrame:
    """Import rows without the moved specifiers; a statement whose last specifier goes is gone with it."""
    return each(moves, _kept(moves), "s").select("file_path", "s.*")


def added_imports(moves: DataFrame) -> DataFrame:
    """The imports to add."""
    return each(moves, _added(moves), "s").select("file_path", "s.*").drop("pos")


def rewired_imports(moves: DataFrame) -> DataFrame:
    """Import rows after the migration."""
    return each(moves, F.concat(_kept(moves), _added(moves)), "s").select("file_path", "s.*").drop("pos")
