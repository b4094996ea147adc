"""Matching usages with rules: first rule in document order, or most specific first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions.matching import clause_holds, compiled_rule, term_holds
from tagloom.functions.props import prop_key
from tagloom.operators.rows import each
from tagloom.operators.tables import written_once
from tagloom.sources.rules import compiled_rules


def match_rules(
    used: DataFrame,
    rules: DataFrame,
    mode: str = "first_match",
    keep_unmatched: bool = False,
    compiled: bool = False,
    stored: bool = False,
) -> DataFrame:
    """Usages with the rule that applies to them, as struct column ``rule``.

    Any number of rules: matching is :func:`match_by_anchor`.  With ``compiled``
    the rules travel in the plan as one conditional and matching is a
    projection; the rows are the same.  Ask for it where rules are written by
    hand, never for a table that grows with the data.
    """
    if not compiled:
        return match_by_anchor(used, rules, mode, keep_unmatched, stored)
    constant = compiled_rules(rules, mode)
    index = compiled_rule(constant.rows, F.col("package"), ruled_component(used), F.col("props"))
    rule = F.array(F.get(constant.array(), index))
    if keep_unmatched:
        return used.select("*", F.explode_outer(rule).alias("rule"))
    return each(used, rule, "rule")


def ruled_component(used: DataFrame) -> Column:
    """The component whose rules apply: the exported one where the table knows it."""
    return F.col("resolved") if "resolved" in used.columns else F.col("component")


def rule_rank(mode: str) -> Column:
    """Struct column that orders the rules of a component."""
    if mode == "most_specific":
        return F.struct((-F.col("specificity")).alias("a"), F.col("rule_pos").alias("b"))
    return F.struct(F.lit(0).alias("a"), F.col("rule_pos").alias("b"))


def distinct_prop_sets(used: DataFrame) -> DataFrame:
    """Distinct (package, component, props) with the number of usages: what matching depends on."""
    keyed = used.select("package", ruled_component(used).alias("component"), prop_key(F.col("props")).alias("full_key"))
    return keyed.groupBy("package", "component", "full_key").agg(F.count("*").alias("n"))


#: What matching alone needs of a rule; with ``stored`` usages it does not travel on.
_TESTED = ("any_of", "none_of", "files")

#: So many prop sets with their rules may go to every task instead of the usages to them: some 50 MB.
FEW_SETS = 50_000


def match_by_anchor(
    used: DataFrame, rules: DataFrame, mode: str = "first_match", keep_unmatched: bool = False, stored: bool = False
) -> DataFrame:
    """Matching for rule tables of any size: one equi-join on one term per clause.

    Usages are read once: they are written with their keys, and everything else
    starts from there.  Distinct prop sets are matched, not usages
    (:func:`best_rules`), and the usages join the rule of their set back.  A
    set that holds more than its share of the usages is dealt over salts
    (:func:`dealt`), so no task gets a hot set whole.

    ``stored``: the usages come from files read already (``extract.scanned_once``)
    and are not written again.  As long as the sets are few their rules are
    broadcast, so that the usages stay where their file is.
    """
    keyed = used.withColumn("full_key", prop_key(F.col("props"))).withColumn("_ruled", ruled_component(used))
    keyed = keyed.withColumn("_row", F.monotonically_increasing_id())
    keyed = keyed if stored else written_once(keyed)
    sets = keyed.groupBy("package", F.col("_ruled").alias("component"), "full_key").agg(F.count("*").alias("n"))
    sets = numbered_sets(sets)
    best = best_rules(sets, rules, mode)
    bodies = rules.select("package", "component", "rule_pos", F.struct(*[c for c in rules.columns if not stored or c not in _TESTED]).alias("rule"))
    chosen = best.join(bodies, ["package", "component", "rule_pos"]).select(
        "package", F.col("component").alias("_ruled"), "full_key", "rule"
    )
    how = "left" if keep_unmatched else "inner"
    if stored and sets.count() <= FEW_SETS:
        return keyed.join(F.broadcast(chosen), ["package", "_ruled", "full_key"], how).select(*used.columns, "rule")
    left, right = dealt(keyed, chosen, sets.withColumnRenamed("component", "_ruled"), ["package", "_ruled", "full_key"])
    return left.join(right, ["package", "_ruled", "full_key", "_salt"], how).select(*used.columns, "rule")


def dealt(rows: DataFrame, one_each: DataFrame, sizes: DataFrame, keys: list[str], per_partition: int = 8) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``keys`` with a ``_salt``: rows of a heavy key are dealt, the one row it meets is repeated.

    ``sizes`` has the number of rows ``n`` of every key.  A share is an eighth of a shuffle
    partition's part of all rows; a key above it gets a salt for every share.
    There are at most eight such keys for a shuffle partition, so their list
    is broadcast; light keys have salt 0 and are not touched.
    """
    spark = rows.sparkSession
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = max(1, total // (per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    name = F.xxhash64(*keys)
    heavy = sizes.filter(F.col("n") > share).groupBy(name.alias("_key")).agg(F.ceil(F.max("n") / share).cast("int").alias("_salts"))
    heavy = F.broadcast(heavy)
    left = rows.withColumn("_key", name).join(heavy, "_key", "left").withColumn("_salt", F.coalesce(F.pmod("_row", "_salts"), F.lit(0)))
    salts = F.sequence(F.lit(0).cast("bigint"), F.coalesce("_salts", F.lit(1)).cast("bigint") - 1)
    right = one_each.withColumn("_key", name).join(heavy, "_key", "left").withColumn("_salt", F.explode(salts))
    return left.drop("_key", "_salts"), right.drop("_key", "_salts")


def numbered_sets(sets: DataFrame) -> DataFrame:
    """Prop sets written once, each with a number ``set_id`` to join on."""
    return written_once(sets.withColumn("set_id", F.monotonically_increasing_id()))


_TERM_KEYS = ["package", "component", "anchor_kind", "anchor_key", "anchor_value"]


def _anchor(kind: str, key: Column, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"))


def _set_anchors(sets: DataFrame) -> DataFrame:
    """Prop sets spread over what a clause can be filed under: each prop by value, by name, and nothing."""
    none = F.lit("")
    anchors = F.concat(
        F.transform("full_key", lambda e: _anchor("value", e["key"], e["value"])),
        F.transform("full_key", lambda e: _anchor("presence", e["key"], none)),
        F.array(_anchor("open", none, none)),
    )
    return sets.select("*", F.explode(anchors).alias("_a")).select(
        *sets.columns,
        F.col("_a.kind").alias("anchor_kind"), F.col("_a.key").alias("anchor_key"), F.col("_a.value").alias("anchor_value"),
    )


def _anchor_columns(term: Column) -> list[Column]:
    """Where a clause with the given term (null for none) is filed."""
    return [
        F.when(term.isNull(), "open").when(term["value"].isNull(), "presence").otherwise("value").alias("anchor_kind"),
        F.coalesce(term["key"], F.lit("")).alias("anchor_key"),
        F.coalesce(term["value"], F.lit("")).alias("anchor_value"),
    ]


def _clauses(rules: DataFrame, mode: str) -> DataFrame:
    """One row per clause; rules without clauses get an empty one.

    Of the clauses that always hold only those of the best rule per component
    are kept.
    """
    empty = F.array(F.array().cast("array<struct<key:string,value:string>>"))
    rows = rules.select(
        "package", "component", "rule_pos", rule_rank(mode).alias("rank"), "none_of",
        F.posexplode(F.when(F.size("any_of") == 0, empty).otherwise(F.col("any_of"))).alias("clause_pos", "clause"),
    )
    always = (F.size("clause") == 0) & (F.size("none_of") == 0)
    rows = rows.withColumn("_always", always)
    best = rows.filter("_always").groupBy("package", "component").agg(F.min("rank").alias("rank")).withColumn("_always", F.lit(True))
    won = rows.join(best, ["package", "component", "rank", "_always"], "left_semi")
    return rows.filter("NOT _always").unionByName(won).drop("_always")


_ONLY_EXCLUDES = "size(clause) = 0 AND size(none_of) > 0"


def best_rules(sets: DataFrame, rules: DataFrame, mode: str = "first_match") -> DataFrame:
    """(package, component, full_key, n, rule_pos) of the prop sets that match a rule.

    Every clause with terms is filed under its rarest term, so a prop set meets
    only the clauses whose rarest term it satisfies and each of those is then
    tested in full.  Of the rules that need no term only the best one per
    component can ever win, so that one is kept.  Rules with only excluded
    terms are found by the terms they exclude (:func:`least_not_violated`).
    """
    if "set_id" not in sets.columns:
        sets = numbered_sets(sets)
    anchored = _set_anchors(sets)
    clauses = _clauses(rules, mode)
    filed = _file_clauses(clauses.filter(f"NOT ({_ONLY_EXCLUDES})"), anchored)
    props = F.map_from_entries("full_key")
    wanted = (
        anchored.join(filed, _TERM_KEYS)
        .filter(clause_holds(F.col("clause"), props) & ~F.exists("none_of", lambda t: term_holds(t, props)))
        .select("set_id", "rank", "rule_pos")
    )
    excluded = least_not_violated(anchored, clauses.filter(_ONLY_EXCLUDES))
    best = wanted.unionByName(excluded).groupBy("set_id").agg(F.min_by("rule_pos", "rank").alias("rule_pos"))
    return sets.join(best, "set_id").select("package", "component", "full_key", "n", "rule_pos")


def excluded_terms(clauses: DataFrame) -> DataFrame:
    """The index of excluded terms: rules that only exclude, filed under each of their terms.

    ``order`` numbers the rules of a component from 0, best first; the window
    is over rules, which are configuration.
    """
    place = Window.partitionBy("package", "component").orderBy("rank")
    ordered = clauses.select("package", "component", "rule_pos", "rank", "none_of").distinct().withColumn("order", F.row_number().over(place) - 1)
    return ordered.select("package", "component", "rule_pos", "rank", "order", F.explode("none_of").alias("_t")).select(
        "package", "component", "rule_pos", "rank", "order", *_anchor_columns(F.col("_t"))
    )


def least_not_violated(anchored: DataFrame, clauses: DataFrame) -> DataFrame:
    """(set_id, rank, rule_pos): of the rules that only exclude, the best one each prop set does not violate.

    The sets meet the index on the terms they hold, which gives the rules each
    of them *violates*, and no others.  The best rule left is the least number
    missing from those: it is 0 or follows a violated one, so the numbers
    after violated ones, without the violated ones, hold it as their least.
    """
    index = written_once(excluded_terms(clauses))
    violated = anchored.join(index, _TERM_KEYS).select("set_id", "package", "component", "order").distinct()
    ruled = index.select("package", "component").distinct()
    first = anchored.filter("anchor_kind = 'open'").join(ruled, ["package", "component"], "left_semi")
    following = first.select("set_id", "package", "component", F.lit(0).alias("order")).unionByName(
        violated.select("set_id", "package", "component", (F.col("order") + 1).alias("order"))
    )
    missing = following.join(violated, ["set_id", "package", "component", "order"], "left_anti")
    least = missing.groupBy("set_id", "package", "component").agg(F.min("order").alias("order"))
    rules = index.select("package", "component", "order", "rank", "rule_pos").distinct()
    return least.join(rules, ["package", "component", "order"]).select("set_id", "rank", "rule_pos")


def _file_clauses(clauses: DataFrame, anchored: DataFrame) -> DataFrame:
    """File every clause under the one of its terms that the fewest prop sets satisfy.

    A term most sets share would bring most sets together with most rules.  A
    clause with a term no set satisfies cannot match and is left out.
    """
    weights = anchored.groupBy(*_TERM_KEYS).agg(F.count("*").alias("_sets"), F.sum("n").alias("_usages"))
    terms = clauses.select("*", F.posexplode_outer("clause").alias("_term_pos", "_term"))
    placed = terms.select(
        "package", "component", "rule_pos", "clause_pos", "_term_pos", *_anchor_columns(F.col("_term"))
    ).join(weights, _TERM_KEYS, "left")
    rarest = F.struct(F.coalesce("_sets", F.lit(0)).alias("sets"), F.coalesce("_usages", F.lit(0)).alias("usages"),
                      F.coalesce("_term_pos", F.lit(0)).alias("pos"))
    best = placed.groupBy("package", "component", "rule_pos", "clause_pos").agg(
        F.min_by(F.struct("anchor_kind", "anchor_key", "anchor_value"), rarest).alias("_at"), F.min(rarest).alias("_w")
    )
    kept = best.filter(F.col("_w.sets") > 0).select("package", "component", "rule_pos", "clause_pos", "_at.*")
    return clauses.join(kept, ["package", "component", "rule_pos", "clause_pos"])


def match_by_division(used: DataFrame, rules: DataFrame, mode: str = "first_match") -> DataFrame:
    """The same result by relational division: the cross-check of the other plans.

    Props and clause terms meet term by term; a clause holds when as many of
    its terms hold as it has.  Gives (package, component, props, n, rule_pos)
    per distinct prop set with a match.
    """
    terms = _clauses(rules, mode).withColumn("n_terms", F.greatest(F.size("clause"), F.lit(1))).select(
        "*", F.explode_outer("clause").alias("_t")
    )
    filed = terms.select("package", "component", "rule_pos", "rank", "none_of", "clause_pos", "n_terms",
                         *_anchor_columns(F.col("_t")))
    props = F.map_from_entries("full_key")
    return (
        _set_anchors(distinct_prop_sets(used))
        .join(filed, _TERM_KEYS)
        .groupBy("package", "component", "full_key", "n", "rule_pos", "clause_pos", "n_terms", "rank", "none_of")
        .agg(F.count("*").alias("n_hit"))
        .filter((F.col("n_hit") == F.col("n_terms")) & ~F.exists("none_of", lambda t: term_holds(t, props)))
        .groupBy("package", "component", "full_key", "n")
        .agg(F.min_by("rule_pos", "rank").alias("rule_pos"))
        .select("package", "component", props.alias("props"), "n", "rule_pos")
    )


def without_rules(used: DataFrame, rules: DataFrame) -> DataFrame:
    """Usages whose package and component have no rules at all."""
    known = rules.select("package", F.col("component").alias("_ruled")).distinct()
    ruled = used.withColumn("_ruled", ruled_component(used))
    return ruled.join(known, ["package", "_ruled"], "left_anti").select(*used.columns)
