"""Prop reports over a usage table, for one scope."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators import aggregates
from tagloom.operators.attribute import in_scope
from tagloom.operators.rules import skeletons


@dataclass(frozen=True)
class PropReport:
    """The tables of a report; all lazy."""

    totals: DataFrame
    combinations: DataFrame
    files: DataFrame


def prop_report(used: DataFrame, package: str | None = None, component: str | None = None) -> PropReport:
    """Totals, combinations and their files; one scope for all three."""
    scoped = in_scope(used, package, component)
    return PropReport(
        aggregates.prop_totals(scoped).orderBy(F.desc("n"), "prop"),
        aggregates.combinations(scoped),
        aggregates.combination_files(scoped),
    )


def usage_table(used: DataFrame, columns: Sequence[str], package: str | None = None, component: str | None = None) -> DataFrame:
    """Combinations as a wide table with a column for each of the props named.

    ``aggregates.combination_cells`` has all props, in long form.
    """
    return aggregates.wide_table(aggregates.combinations(in_scope(used, package, component)), columns, "prop ")


def rule_table(
    used: DataFrame, spec: Mapping[str, str], packages: Sequence[str], component: str, package: str | None = None
) -> DataFrame:
    """Rules to fill in, for the combinations of a scope: for its package, or for all packages."""
    combos = aggregates.combinations(in_scope(used, package, component))
    return skeletons(combos, spec, [package] if package else packages, component)
