"""Rule predicates over a prop map (see ``schemas.RULE``)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def term_holds(term: Column, props: Column) -> Column:
    """Presence of the prop, or equality as text when the term has a value."""
    return F.when(term["value"].isNull(), F.map_contains_key(props, term["key"])).otherwise(
        props[term["key"]].eqNullSafe(term["value"])
    )


def clause_holds(clause: Column, props: Column) -> Column:
    """Every term holds; an empty clause always does."""
    return F.forall(clause, lambda t: term_holds(t, props))


def compiled_rule(rows: Sequence[Mapping], package: Column, component: Column, props: Column) -> Column:
    """Index of the first matching rule among ``rows`` (rule structs as dicts), or null.

    One CASE per package and component: it stops at the first rule that holds
    and runs inside generated code, unlike the array functions above.
    """

    def holds(term: Mapping) -> Column:
        key = F.lit(term["key"])
        return F.map_contains_key(props, key) if term.get("value") is None else props[key].eqNullSafe(term["value"])

    def matches(rule: Mapping) -> Column:
        clauses = [reduce(and_, map(holds, clause), F.lit(True)) for clause in rule["any_of"]]
        wanted = reduce(or_, clauses) if clauses else F.lit(True)
        return reduce(and_, [~holds(t) for t in rule["none_of"]], wanted)

    owners = list(dict.fromkeys((r["package"], r["component"]) for r in rows))
    chosen = F.when(F.lit(False), F.lit(0))
    for owner in owners:
        ladder = F.when(F.lit(False), F.lit(0))
        for index, rule in enumerate(rows):
            if (rule["package"], rule["component"]) == owner:
                ladder = ladder.when(matches(rule), index)
        chosen = chosen.when((package == owner[0]) & (component == owner[1]), ladder)
    return chosen
