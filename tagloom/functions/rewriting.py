"""Column functions that apply rules to attribute lists and tags, and put the edits into the text."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions import patterns, scanner
from tagloom.functions.batches import stretches
from tagloom.functions.lets import let
from tagloom.functions.props import drop_attributes, new_attribute, pick_attributes, render_attributes, render_marked

OUTER = "{...OUTER_PROPS}"
INNER = "{...INNER_PROPS}"
CHILDREN = "{CHILDREN}"


def remove_props(attributes: Column, rule: Column) -> Column:
    """Attributes without the ones the rule removes."""
    return drop_attributes(attributes, rule["remove"])


def rename_props(attributes: Column, props: Column, rule: Column) -> Column:
    """Attributes with the rule's renames, one after the other.

    The value comes from the original props, so a prop removed before can come
    back under its new name; the renamed attribute moves to the end as text.
    """
    return F.aggregate(
        rule["rename"],
        attributes,
        lambda acc, e: F.when(
            F.map_contains_key(props, e["source"]),
            F.concat(
                drop_attributes(acc, F.array(e["source"], e["target"])),
                F.array(new_attribute(e["target"], props[e["source"]], F.lit("text"))),
            ),
        ).otherwise(acc),
    )


def set_props(attributes: Column, rule: Column) -> Column:
    """Attributes with the rule's values set: replaced, and moved to the end."""
    return F.concat(drop_attributes(attributes, rule["set"]["key"]), _set_attributes(rule))


def _set_attributes(rule: Column) -> Column:
    return F.transform(rule["set"], lambda e: new_attribute(e["key"], e["value"], e["literal"]))


def apply_rule(attributes: Column, props: Column, rule: Column) -> Column:
    """Remove, rename, set."""
    dropped = F.concat(rule["remove"], rule["set"]["key"])
    return F.when(
        F.size(rule["rename"]) == 0, F.concat(drop_attributes(attributes, dropped), _set_attributes(rule))
    ).otherwise(set_props(rename_props(remove_props(attributes, rule), props, rule), rule))


def split_for_template(attributes: Column, props: Column, rule: Column) -> Column:
    """STRUCT<outer, inner>: where a template puts the attributes.

    Set values open the outer list.  Surviving attributes go inside when the
    rule lists them, otherwise outside; without a list all go outside.  Spreads
    and attributes without a value do not survive, and renames are not applied.
    """
    named = F.filter(attributes, lambda a: F.map_contains_key(props, a["name"]))
    kept = let(named, lambda k: F.filter(k, lambda a, i: F.array_position(k["name"], a["name"]) == i + 1))
    survivors = drop_attributes(kept, rule["remove"])
    listed = F.coalesce(rule["inner_props"], F.array().cast("array<string>"))
    return F.struct(
        F.concat(_set_attributes(rule), drop_attributes(survivors, listed)).alias("outer"),
        pick_attributes(survivors, listed).alias("inner"),
    )


def fill_template(template: Column, outer: Column, inner: Column) -> Column:
    """Template text with its two attribute placeholders filled, by rendered attributes."""
    filled = F.replace(template, F.concat(F.lit(" "), F.lit(OUTER)), F.lit(OUTER))
    filled = F.replace(filled, F.concat(F.lit(" "), F.lit(INNER)), F.lit(INNER))
    filled = F.replace(filled, F.lit(OUTER), outer)
    return F.replace(filled, F.lit(INNER), inner)


def render_template(rule: Column, attributes: Column, props: Column, children: Column) -> Column:
    """An element rendered through the rule's template."""
    return let(
        split_for_template(attributes, props, rule),
        lambda s: F.replace(fill_template(F.btrim(rule["template"], F.lit(" \t\r\n")), render_attributes(s["outer"]), render_attributes(s["inner"])),
                            F.lit(CHILDREN), children),
    )


def rule_mutates(rule: Column) -> Column:
    """Whether applying the rule counts as a change, even where no value differs."""
    return (
        rule["template"].isNotNull()
        | (F.size(rule["remove"]) > 0)
        | (F.size(rule["rename"]) > 0)
        | (F.size(rule["set"]) > 0)
        | (rule["import_from"].isNotNull() & rule["import_to"].isNotNull())
    )


def tag_edit(tag: Mapping[str, Column], name: Column, attrs: Column, props: Column, rule: Column, rename_components: bool) -> Column:
    """What a rule does to an element: STRUCT<start, stop, text, close_start, close_stop, closing, unsupported, mutates, import_to>.

    ``text`` is null where the opening tag stays as it is.  A template needs
    ``{CHILDREN}`` and the element's own closing tag, unless the element closes
    itself; otherwise the element is left alone and counted as unsupported.
    """
    closed = tag["kind"] == "self"
    template = F.btrim(rule["template"], F.lit(" \t\r\n"))
    supported = rule["template"].isNull() | closed | (tag["close_start"].isNotNull() & F.contains(template, F.lit(CHILDREN)))
    new_name = F.coalesce(rule["new_component"], name) if rename_components else name
    plain = let(
        apply_rule(attrs, props, rule),
        lambda new: F.when((new["raw"] != attrs["raw"]) | (new_name != name), F.concat(
            F.lit("<"), new_name, render_marked(new), F.when(closed, " />").otherwise(">"))),
    )
    filled = let(
        split_for_template(attrs, props, rule), lambda s: fill_template(template, render_marked(s["outer"]), render_marked(s["inner"]))
    )
    whole = F.replace(filled, F.lit(CHILDREN), F.lit(""))
    before = F.substring_index(filled, CHILDREN, 1)
    after = F.substring(template, F.instr(template, CHILDREN) + len(CHILDREN), F.length(template))
    renamed = F.lit(rename_components) & rule["new_component"].isNotNull()
    return F.struct(
        tag["start"].alias("start"),
        tag["stop"].alias("stop"),
        F.when(~supported, None).when(rule["template"].isNull(), plain).when(closed, whole).otherwise(before).alias("text"),
        F.coalesce(tag["close_start"], F.lit(-1)).alias("close_start"),  # nulls among numbers would arrive as floats
        F.coalesce(tag["close_stop"], F.lit(-1)).alias("close_stop"),
        F.when(~supported, None).when(rule["template"].isNotNull(), after)
        .when(renamed, F.concat(F.lit("</"), new_name, F.lit(">"))).alias("closing"),
        (~supported).alias("unsupported"),
        (rule_mutates(rule) & supported).alias("mutates"),
        F.when(rule["import_from"].isNotNull(), rule["import_to"]).alias("import_to"),
    )


def rewritten_text(code: Column, edits: Column, spec: Column, component: Column, targets: Column, statements: Column | None = None) -> Column:
    """The text with its tags edited and the component's import moved to the targets.

    ``statements`` are the import statements of the text where they are known
    (``extract.scanned``); otherwise a text whose import moves is read for them.
    """
    cloudpickle.register_pickle_by_value(scanner)
    cloudpickle.register_pickle_by_value(patterns)

    @F.arrow_udf("string")
    def write(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for start, n in stretches(batch[0]):
                code, edits, *others = (column.slice(start, n) for column in batch)
                rows = zip(code.to_pylist(), _edit_rows(edits), *(column.to_pylist() for column in others), strict=True)
                yield pa.array([_write(*row) for row in rows], pa.string())

    found = F.lit(None).cast(STATEMENTS) if statements is None else statements
    return write(code, edits, F.struct(spec["package"].alias("package"), spec["import_type"].alias("import_type"), spec["local_name"].alias("local_name")), component, targets, found)


#: Import statements of a text: places, package, and what is bound.
STATEMENTS = "array<struct<start:int,stop:int,package:string,default:string,space:string,named:array<string>,is_type:boolean>>"


def _edit_rows(edits: pa.ListArray) -> Iterator[list[tuple]]:
    """The edits of each text as tuples (see ``_PLACES``); taken field by field, as an object for each edit costs more than making it."""
    flat = edits.flatten()
    fields = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
    rows = zip(*(fields[c].to_pylist() if fields[c].null_count or c in ("text", "closing") else fields[c].to_numpy().tolist() for c in _PLACES), strict=True)
    for size in edits.value_lengths().to_pylist():
        yield list(islice(rows, size or 0))


_PLACES = ("start", "stop", "text", "close_start", "close_stop", "closing")


def _write(code: str, edits: list[tuple], spec: dict, component: str, targets: list[str], statements: list[dict] | None) -> str:
    places = [(start, stop, text) for start, stop, text, _, _, _ in edits if text is not None]
    places += [(start, stop, closing) for _, _, _, start, stop, closing in edits if closing is not None and start >= 0]
    moved, top = [], ""
    if len(targets):
        imports = scanner.Scan(code).imports if statements is None else [(*list(s.values())[:5], list(s["named"]), s["is_type"]) for s in statements]
        moved, top = scanner.import_edits(code, imports, spec, component, list(targets))
    return top + scanner.spliced(code, places + moved)
