"""Usage reports: counts at several levels, prop combinations, directories.

A report never gathers the usages of a group into one row: what the groups
contain stays as rows, keyed by the group, so a package or prop that holds most
of the data costs no more memory than any other.  Counts aggregate partially
before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.props import key_text, prop_key, reportable, wide_columns
from tagloom.operators.extract import prop_rows
from tagloom.operators.numbering import number_rows
from tagloom.operators.tables import written_once


def usage_summary(used: DataFrame) -> DataFrame:
    """Usages and files per package and component (files counted in two steps)."""
    per_file = used.groupBy("package", "component", "file_path").agg(F.count("*").alias("n"))
    return per_file.groupBy("package", "component").agg(
        F.sum("n").alias("n_usages"), F.count("*").alias("n_files")
    )


def summary_rows(used: DataFrame) -> DataFrame:
    """The summary's members: props and import of every usage, keyed by package and component."""
    return used.select("package", "component", "props", "import")


def prop_levels(used: DataFrame) -> DataFrame:
    """Prop values over everything, per package, and per package and component.

    Values are counted on the finest level first, so the three grouping sets
    expand the counted table instead of the usages.
    """
    counted = prop_rows(used).groupBy("package", "component", "prop", "value").agg(F.count("*").alias("n"))
    per_value = counted.groupingSets(
        [
            [F.col("prop"), F.col("value")],
            [F.col("package"), F.col("prop"), F.col("value")],
            [F.col("package"), F.col("component"), F.col("prop"), F.col("value")],
        ],
        F.col("package"), F.col("component"), F.col("prop"), F.col("value"),
    ).agg(
        F.sum("n").alias("n"),
        F.when(F.grouping("package") == 1, "all")
        .when(F.grouping("component") == 1, "package")
        .otherwise("component")
        .alias("level"),
    )
    return per_value.groupBy("level", "package", "component", "prop").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_values")
    )


def prop_value_frequency(used: DataFrame) -> DataFrame:
    """How often each value of each prop is used."""
    return prop_rows(used).groupBy("prop", "value").agg(F.count("*").alias("n"))


def prop_file_frequency(used: DataFrame) -> DataFrame:
    """How often each prop is used in each file."""
    return prop_rows(used).groupBy("prop", "file_path").agg(F.count("*").alias("n"))


def prop_totals(used: DataFrame, ignored: bool = False) -> DataFrame:
    """How many usages carry each prop; order by ``n`` descending, then prop, to list it.

    With ``ignored`` the ignored props count too: these are the column totals
    of the usage table.
    """
    return prop_rows(used, ignored).groupBy("prop").agg(F.count("*").alias("n"))


def distinct_props(used: DataFrame) -> DataFrame:
    """The prop names in use."""
    return prop_rows(used).select("prop").distinct()


def combinations(used: DataFrame) -> DataFrame:
    """Distinct prop combinations: key, number of usages, files and props.

    Counted per combination and file first; the files themselves are
    :func:`combination_files`.
    """
    return (
        combination_files(used)
        .groupBy("props_key")
        .agg(F.sum("n").alias("n"), F.count("*").alias("n_files"))
        .withColumn("n_props", F.size("props_key"))
    )


def combination_files(used: DataFrame) -> DataFrame:
    """Files of each combination with their number of usages."""
    keyed = used.select(prop_key(reportable(F.col("props"))).alias("props_key"), "file_path")
    return keyed.groupBy("props_key", "file_path").agg(F.count("*").alias("n"))


def combination_order(key_text: Column) -> list[Column]:
    """Report order: most props first, then most usages, then the key."""
    return [F.desc("n_props"), F.desc("n"), key_text.asc()]


def count_combinations(used: DataFrame) -> DataFrame:
    """How many distinct combinations there are."""
    keys = used.select(prop_key(reportable(F.col("props"))).alias("props_key")).distinct()
    return keys.agg(F.count("*").alias("n_combos"))


def combination_cells(used: DataFrame) -> DataFrame:
    """Combinations in long form: props_key, n, prop, value, prop_total.

    Ordered by ``prop_total`` descending and ``prop``, the props are the columns
    of the report table, however many there are.
    """
    combos = combinations(used)
    totals = combos.select(F.explode("props_key.key").alias("prop"), "n").groupBy("prop").agg(F.sum("n").alias("prop_total"))
    cells = combos.select("props_key", "n", F.explode("props_key").alias("e"))
    return cells.select("props_key", "n", F.col("e.key").alias("prop"), F.col("e.value").alias("value")).join(totals, "prop")


def wide_columns_in_order(combos: DataFrame, width: int) -> DataFrame:
    """prop, total, block, slot: the columns of the report table, most used first, ``width`` to a block.

    The order is that of the totals, then of the names; columns come from the
    data and are numbered by a range sort, however many there are.
    """
    totals = combos.select(F.explode("props_key.key").alias("prop"), "n").groupBy("prop").agg(F.sum("n").alias("total"))
    numbered = number_rows(totals, [F.desc("total"), F.col("prop").asc()], "column_no")
    place = F.col("column_no") - 1
    return numbered.select("prop", "total", F.floor(place / width).alias("block"), (place % width).alias("slot"))


def wide_blocks(combos: DataFrame, columns: DataFrame, width: int, absent: str = "-") -> DataFrame:
    """The report table in blocks of ``width`` columns: props_key, n, block, c1 to c<width>.

    Every combination has a row in block 0, and in each further block that has
    one of its props; other cells would be empty.  All blocks have one schema;
    ``columns`` tells which prop a column shows.
    """
    cells = combos.select("props_key", "n", F.explode("props_key").alias("e"))
    placed = cells.join(columns, F.col("e.key") == F.col("prop")).select("props_key", "n", "block", "slot", F.col("e.value").alias("value"))
    first = combos.select("props_key", "n", F.lit(0).cast("bigint").alias("block"), F.lit(None).cast("bigint").alias("slot"), F.lit(None).cast("string").alias("value"))
    shown = [F.coalesce(F.max(F.when(F.col("slot") == i, F.col("value"))), F.lit(absent)).alias(f"c{i + 1}") for i in range(width)]
    return placed.unionByName(first).groupBy("props_key", "n", "block").agg(*shown)


def combination_sketches(used: DataFrame, precision: int = 12) -> DataFrame:
    """package, component, sketch: a mergeable sketch of the distinct prop combinations of each component.

    A HyperLogLog sketch of 2 ** ``precision`` registers; the relative standard error is about
    1.04 / sqrt(2 ** precision), 1.6 % at 12.  Store it with the report of a run.
    """
    key = key_text(prop_key(reportable(F.col("props"))))
    return used.groupBy("package", "component").agg(F.hll_sketch_agg(key, F.lit(precision)).alias("sketch"))


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """level, package, component, n_estimated: sketches of any number of runs merged per component, per package and over all."""
    union = F.hll_union_agg("sketch")
    merged = sketches.groupingSets([[], [F.col("package")], [F.col("package"), F.col("component")]], F.col("package"), F.col("component")).agg(
        F.hll_sketch_estimate(union).alias("n_estimated"),
        F.when(F.grouping("package") == 1, "all").when(F.grouping("component") == 1, "package").otherwise("component").alias("level"),
    )
    return merged.select("level", "package", "component", "n_estimated")


def wide_table(combos: DataFrame, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """Combinations with one column per prop, ``-`` where it is absent.

    The key holds the props already, so this is a projection and not a pivot.
    ``prefix`` keeps the names of the props apart from the other columns.
    """
    props = F.map_from_entries("props_key")
    return combos.select("props_key", "n", *wide_columns(props, keys, prefix))


def numbered_combinations(combos: DataFrame, key_text: Column) -> DataFrame:
    """Combinations with their row number in report order."""
    return number_rows(combos.withColumn("_text", key_text), combination_order(F.col("_text")), "row_no").drop("_text")


def usages_per_file(used: DataFrame) -> DataFrame:
    """Number of elements per file."""
    return used.groupBy("file_path").agg(F.count("*").alias("n_elements"))


def with_prop_count(used: DataFrame) -> DataFrame:
    """Usages with the number of their reportable props; order by it descending to list them."""
    return used.withColumn("n_props", F.size(reportable(F.col("props"))))


def directory_rollup(used: DataFrame) -> DataFrame:
    """Usages and files below every directory (and in every file).

    One level at a time, deepest first: a level's rows are its files and what
    the level below adds up to, so a step has as many rows as the level has
    names.  Each level is written, as it is both result and input of the next.
    """
    per_file = used.groupBy("rel_path").agg(F.count("*").alias("n_usages"))
    per_file = written_once(per_file.select(F.col("rel_path").alias("prefix"), "n_usages", F.lit(1).cast("bigint").alias("n_files"), F.size(F.split("rel_path", "/")).alias("depth")))
    deepest = per_file.agg(F.max("depth")).first()[0] or 0
    levels = []
    for depth in range(deepest, 0, -1):
        rows = per_file.filter(F.col("depth") == depth).drop("depth")
        if levels:
            parent = F.regexp_extract("prefix", r"^([\s\S]*)/[^/]*$", 1)
            rows = rows.unionByName(levels[-1].select(parent.alias("prefix"), "n_usages", "n_files"))
        levels.append(written_once(rows.groupBy("prefix").agg(F.sum("n_usages").alias("n_usages"), F.sum("n_files").alias("n_files"))))
    empty = per_file.drop("depth").limit(0)
    return reduce(lambda a, b: a.unionByName(b), levels, empty)


def component_index(used: DataFrame) -> DataFrame:
    """Choice list: packages numbered, and components numbered within each.

    Both numbers come from range-sorted row numbers, not from a window over a
    package, which may hold most of the components.
    """
    pairs = number_rows(
        used.select("package", "component").distinct(), [F.col("package").asc(), F.col("component").asc()], "_pair"
    )
    firsts = pairs.groupBy("package").agg(F.min("_pair").alias("_first"))
    packages = number_rows(firsts, [F.col("package").asc()], "pkg_no")
    return pairs.join(packages, "package").select(
        "package", "component", "pkg_no", (F.col("_pair") - F.col("_first") + 1).alias("comp_no")
    )


def migration_units(used: DataFrame, packages: Sequence[str]) -> DataFrame:
    """One migration unit per file: the last package in list order, then the last component, wins."""
    listed = F.array(*[F.lit(p) for p in packages])
    order = F.struct(F.array_position(listed, F.col("package")).alias("rank"), F.col("component"))
    return used.groupBy("file_path").agg(
        F.max_by(F.struct("package", "component"), order).alias("unit"), F.count("*").alias("n_elements")
    ).select("file_path", "unit.package", "unit.component", "n_elements")
