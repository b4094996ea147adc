"""Column functions over imports and attributes, and the reading of web pages.

All of them are row-local.  Source text is read by ``scanner``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.lets import let
from tagloom.functions.patterns import (
    ARROW_BRACED,
    EMPTY_EXPRESSION,
    ENTITIES,
    EXPRESSION_KINDS,
    JAVA,
    NAME,
    NAMED_EXPRESSION_KINDS,
    OTHER_EXPRESSION,
    SIMPLE_BRACED,
)

_BLANKS = " \t\r\n"


def extract_all(text: Column, pattern: str) -> Column:
    """All matches of a pattern, in text order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _tag_body(tag: Column, name: Column) -> Column:
    end = F.when(F.endswith(tag, F.lit("/>")), 2).otherwise(1)
    return F.substring(tag, F.length(name) + 2, F.length(tag) - F.length(name) - 1 - end)


def attribute_names(tag: Column, name: Column) -> Column:
    """Attribute names of an opening tag in text order; a spread gives an empty name."""
    return F.regexp_extract_all(_tag_body(tag, name), F.lit(JAVA.attribute_parts), F.lit(1))


def attribute_values(tag: Column, name: Column) -> Column:
    """Attribute values of an opening tag, in step with :func:`attribute_names`."""
    sources = F.regexp_extract_all(_tag_body(tag, name), F.lit(JAVA.attribute_parts), F.lit(2))
    return F.transform(
        sources,
        lambda s: F.when(s == "", "true").when(F.startswith(s, F.lit("{")), braced_value(s)).otherwise(quoted_value(s)),
    )


def props_from(names: Column, values: Column) -> Column:
    """Names and values as MAP<STRING,STRING>: no spreads, no empty values, last one wins.

    Both columns are used several times and should be plain columns.
    """
    clean = ~F.array_contains(names, "") & ~F.array_contains(values, "")
    unique = F.size(F.array_distinct(names)) == F.size(names)

    def kept(pairs: Column) -> Column:
        full = F.filter(pairs, lambda p: (p["n"] != "") & (p["v"] != ""))
        return let(
            full,
            lambda k: F.map_from_entries(
                F.filter(k, lambda p, i: F.size(k) - F.array_position(F.reverse(k["n"]), p["n"]) == i)
            ),
        )

    return F.when(clean & unique, F.map_from_arrays(names, values)).otherwise(
        kept(F.arrays_zip(names.alias("n"), values.alias("v")))
    )


def attribute_sources(tag: Column, name: Column) -> Column:
    """The attributes of an opening tag as written, in step with :func:`attribute_names`."""
    return extract_all(_tag_body(tag, name), JAVA.attribute)


def attribute_list(sources: Column, names: Column, values: Column) -> Column:
    """Attributes in text order: ARRAY<STRUCT<name, value, kind, raw>>.

    ``kind`` is shorthand, text, expr or spread; a spread has an empty name.
    """
    kinds = F.transform(
        sources,
        lambda r: F.when(F.startswith(r, F.lit("{")), "spread")
        .when(~F.contains(r, F.lit("=")), "shorthand")
        .when(F.endswith(r, F.lit("}")), "expr")
        .otherwise("text"),
    )
    return F.arrays_zip(names.alias("name"), values.alias("value"), kinds.alias("kind"), sources.alias("raw"))


def quoted_value(source: Column) -> Column:
    """What the quotes of a value enclose; a bare word as it is."""
    quote = F.startswith(source, F.lit('"')) | F.startswith(source, F.lit("'"))
    return F.when(quote, decode_entities(F.substring(source, F.lit(2), F.length(source) - 2))).otherwise(source)


def braced_value(source: Column) -> Column:
    """The text form of a value in braces."""
    simple = F.when(~F.contains(source, F.lit("this")), F.nullif(F.regexp_extract(source, SIMPLE_BRACED, 1), F.lit("")))
    arrow = F.when(source.rlike(ARROW_BRACED), F.lit("ArrowFunctionExpression"))
    inside = F.btrim(F.substring(source, F.lit(2), F.length(source) - 2), F.lit(_BLANKS))
    return F.coalesce(simple, arrow, let(inside, expression_value))


def decode_entities(text: Column) -> Column:
    """Quoted attribute text with the common entities decoded."""
    decoded = text
    for entity, char in ENTITIES:
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def expression_value(expression: Column) -> Column:
    """Literals, names and members as text, any other expression as its kind."""
    pairs = [(c, number) for number, (starts, _) in enumerate(EXPRESSION_KINDS) for c in starts]
    by_start = F.create_map(*[F.lit(x) for pair in pairs for x in pair])

    def by_group(group: Column) -> Column:
        branches = F.when(group.isNull(), _by_pattern(expression, NAMED_EXPRESSION_KINDS))
        for number, (_, kinds) in enumerate(EXPRESSION_KINDS):
            branches = branches.when(group == number, _by_pattern(expression, kinds))
        return branches

    return F.when(expression == "", EMPTY_EXPRESSION).otherwise(let(by_start[F.substring(expression, 1, 1)], by_group))


def _by_pattern(expression: Column, kinds: list[tuple[str, str]]) -> Column:
    branches = F
    for pattern, result in kinds:
        if "\\1" in result:
            before, after = result.split("\\1")
            value = F.regexp_extract(expression, pattern, 1)
            value = F.concat(F.lit(before), value, F.lit(after)) if before or after else value
        else:
            value = F.lit(result)
        branches = branches.when(expression.rlike(pattern), value)
    return branches.otherwise(OTHER_EXPRESSION)


def props_of(attributes: Column) -> Column:
    """Attributes as a prop map (see :func:`props_from`)."""
    return let(attributes, lambda a: let(a["name"], lambda names: let(a["value"], lambda values: props_from(names, values))))


def tag_tokens(code: Column) -> Column:
    """Tag and comment tokens of a text: ARRAY<STRUCT<raw, kind, name, pos>>.

    ``kind`` is open, self (self-closing), close or comment; ``pos`` is the
    index among all tokens.
    """
    return F.transform(
        extract_all(code, JAVA.token),
        lambda t, i: F.struct(
            t.alias("raw"),
            F.when(t.rlike(r"^<[A-Za-z_$]"), F.when(F.endswith(t, F.lit("/>")), "self").otherwise("open"))
            .when(F.startswith(t, F.lit("</")), "close")
            .otherwise("comment")
            .alias("kind"),
            F.regexp_extract(t, "^</?(" + NAME + ")", 1).alias("name"),
            i.alias("pos"),
        ),
    )


def opening_tags(tokens: Column, target: str | None = None) -> Column:
    """The tokens that open an element, of one name when a target is given."""

    def opens(t: Column) -> Column:
        tag = t["kind"].isin("open", "self")
        return tag & (t["name"] == target) if target else tag

    return F.filter(tokens, opens)


def first_import(
    specifiers: Column, packages: Sequence[str], target: str | None
) -> Column:
    """The specifier a file's elements are attributed to.

    Among the imports of the given packages whose local name is the target:
    the best-ranked package (list order), then the first in the text.
    """
    listed = F.array(*[F.lit(p) for p in packages])

    def wanted(s: Column) -> Column:
        known = F.array_contains(listed, s.package)
        return known & (s.local_name == target) if target else known

    ranked = F.transform(
        F.filter(specifiers, wanted),
        lambda s: F.struct(F.array_position(listed, s.package).alias("rank"), s.pos.alias("pos"), s.alias("spec")),
    )
    return F.array_min(ranked)["spec"]


def component_name(spec: Column) -> Column:
    """Exported component behind a specifier: local name for defaults, else the imported one."""
    return F.when(spec["import_type"] == "default", spec["local_name"]).otherwise(
        F.coalesce(spec["imported_name"], spec["local_name"])
    )
