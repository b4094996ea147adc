"""Column functions over props (MAP<STRING,STRING>) and attribute lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.lets import let
from tagloom.functions.scanner import MARK

# Props that say nothing about how a component is used.
IGNORED_PROPS = ["className", "data-testid", "id", "style", "key"]


def reportable(props: Column) -> Column:
    """Props without the ignored ones."""
    ignored = F.array(*[F.lit(k) for k in IGNORED_PROPS])
    return F.map_filter(props, lambda k, _: ~F.array_contains(ignored, k))


def prop_key(props: Column, locale_order: bool = False) -> Column:
    """Canonical key of a prop set: its entries sorted by name.

    Maps cannot be join or distinct keys; this array can.  Names sort by bytes,
    or with ``locale_order`` by the Unicode collation.
    """
    entries = F.map_entries(props)
    if not locale_order:
        return F.sort_array(entries)
    return F.array_sort(
        entries,
        lambda a, b: F.when(F.collate(a["key"], "UNICODE") < F.collate(b["key"], "UNICODE"), -1)
        .when(F.collate(a["key"], "UNICODE") > F.collate(b["key"], "UNICODE"), 1)
        .otherwise(0),
    )


def key_text(key: Column) -> Column:
    """A canonical key as ``a=1,b=2`` text, for display."""
    return F.concat_ws(",", F.transform(key, lambda e: F.concat(e["key"], F.lit("="), e["value"])))


def props_text(props: Column) -> Column:
    """A prop map as sorted ``a=1,b=2`` text."""
    return key_text(prop_key(props))


def pick_attributes(attributes: Column, names: Column) -> Column:
    """Attributes with the given names, value and order kept; spreads are left out."""
    return let(names, lambda bound: F.filter(attributes, lambda a: F.array_contains(bound, a["name"])))


def drop_attributes(attributes: Column, names: Column) -> Column:
    """Attributes without the given names; spreads stay."""
    return let(names, lambda bound: F.filter(attributes, lambda a: ~F.array_contains(bound, a["name"])))


def new_attribute(name: Column, value: Column, literal: Column) -> Column:
    """A new attribute.

    ``literal`` is the JSON kind of the value: text becomes ``name="value"``,
    boolean true the shorthand ``name``, anything else ``name={value}``.
    """
    shorthand = (literal == "boolean") & (value == "true")
    quote = F.when(F.contains(value, F.lit('"')), "'").otherwise('"')
    raw = (
        F.when(shorthand, name)
        .when(literal == "text", F.concat(name, F.lit("="), quote, value, quote))
        .otherwise(F.concat(name, F.lit("={"), value, F.lit("}")))
    )
    return F.struct(
        name.alias("name"),
        value.alias("value"),
        F.when(shorthand, "shorthand").when(literal == "text", "text").otherwise("expr").alias("kind"),
        raw.alias("raw"),
        F.lit(None).cast("int").alias("start"),
        F.lit(None).cast("int").alias("stop"),
    )


def render_marked(attributes: Column) -> Column:
    """:func:`render_attributes` with attributes of the text shown by their place in it, so that edits inside them are kept (see ``scanner.spliced``)."""

    def shown(a: Column) -> Column:
        place = F.concat(F.lit(f" {MARK}"), a["start"].cast("string"), F.lit(":"), a["stop"].cast("string"), F.lit(MARK))
        return F.when(a["start"].isNull(), F.concat(F.lit(" "), a["raw"])).otherwise(place)

    return F.concat_ws("", F.transform(attributes, shown))


def render_attributes(attributes: Column) -> Column:
    """Attributes as tag text, with a leading blank unless there are none."""
    return F.concat_ws("", F.transform(attributes, lambda a: F.concat(F.lit(" "), a["raw"])))


def wide_columns(props: Column, keys: Sequence[str], prefix: str = "", absent: str = "-") -> list[Column]:
    """One column per key, absent ones filled: a pivot without a shuffle."""
    return [F.coalesce(props[k], F.lit(absent)).alias(prefix + k) for k in keys]


def table_cell(text: Column, width: int = 16) -> Column:
    """Text cut to fit a report cell: padded, or three dots after 13 characters."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(
        F.rpad(text, width, " ")
    )
