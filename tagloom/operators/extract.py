"""Files to import rows, element rows, usages and prop rows.

Everything here is narrow: scan, project, generate, filter.  Attribution needs
no join either, because a file's imports and its elements come from one row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from tagloom.functions import markup, patterns, scanner
from tagloom.functions.batches import stretches
from tagloom.functions.lets import built_once
from tagloom.functions.paths import relative_path
from tagloom.functions.props import reportable
from tagloom.functions.rewriting import STATEMENTS
from tagloom.operators.rows import each
from tagloom.operators.tables import bucket_count, bucketed_once


def _mentions(packages: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.col("code"), F.lit(p)) for p in packages])


def mentioning(files: DataFrame, packages: Sequence[str]) -> DataFrame:
    """Files whose text names one of the packages: a cheap test before any regex."""
    return files.filter(_mentions(packages))


SCAN = (
    "imports array<struct<package:string,pos:int,specifier_type:string,import_type:string,import_stm:string,"
    "local_name:string,imported_name:string>>,"
    "tags array<struct<name:string,pos:int,kind:string,line:int,column:int,start:int,stop:int,close_start:int,close_stop:int,children:string,"
    "attrs:array<struct<name:string,value:string,kind:string,raw:string,start:int,stop:int>>>>,"
    f"unread array<string>,statements {STATEMENTS}"
)


def scanned(code: str | Column, target: str | None = None, locate: bool = False, children: bool = False, statements: bool = False) -> Column:
    """Imports, tags and unread tags of a text column, read in one pass in Arrow batches.

    With a target only its tags are listed; ``locate`` fills line and column,
    ``children`` the text between a tag and its closing tag, ``statements`` the
    places of the import statements.  A batch is read a stretch of about a
    million characters at a time: its tags as rows take many times its text.
    """
    cloudpickle.register_pickle_by_value(scanner)  # the helper travels with the job, so executors need no copy of the package
    cloudpickle.register_pickle_by_value(patterns)

    kind = to_arrow_type(DataType.fromDDL(SCAN))

    @F.arrow_udf(SCAN)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for start, n in stretches(batch):
                texts = batch.slice(start, n).to_pylist()
                yield pa.array([_scan_row(text or "", target, locate, children, statements) for text in texts], kind)

    return read(F.col(code) if isinstance(code, str) else code)


def _scan_row(code: str, target: str | None, locate: bool, children: bool, statements: bool) -> tuple[list | None, ...]:
    """A row of :data:`SCAN`; tuples in the order of its fields, which Arrow takes several times as fast as dicts."""
    scan = scanner.Scan(code)
    starts = scanner.line_starts(code) if locate else None
    tags = []
    for name, pos, kind, start, stop, close_start, close_stop, attrs in scan.tags:
        if target is None or name == target:
            line, column = scanner.place(starts, start) if starts else (None, None)
            inside = code[stop:close_start] if children and close_start is not None else None
            tags.append((name, pos, kind, line, column, start, stop, close_start, close_stop, inside, scanner.attributes(code, attrs)))
    unread = [n for n in scan.unread if target is None or n == target]
    return scanner.specifiers(scan), tags, unread, scan.imports if statements else None


def scanned_once(files: DataFrame, packages: Sequence[str], target: str | None = None) -> DataFrame:
    """file_path, code and ``scan`` of each file, written once in buckets of the path.

    :func:`usages` and ``rewrite.rewrite_files`` take the result for files and read
    no text again; what they do inside a file needs no shuffle.  Files that name
    none of the packages are listed with an empty scan.  Texts are dealt over the
    buckets before they are read, as the rows of their tags take many times their size.
    """
    if "scan" in files.columns:
        return files
    dealt = files.select("file_path", "code").repartition(bucket_count(files.sparkSession), "file_path")
    return bucketed_once(dealt.withColumn("scan", scanned(F.when(_mentions(packages), F.col("code")), target, statements=True)), "file_path")


def scanned_files(files: DataFrame, target: str | None = None, locate: bool = False, children: bool = False) -> DataFrame:
    """file_path and ``scan`` (see :func:`scanned`) of each file."""
    return files.select("file_path", scanned("code", target, locate, children).alias("scan"))


def import_rows(
    files: DataFrame, packages: Sequence[str] | None = None, target: str | None = None
) -> DataFrame:
    """One row per import specifier: of the given packages, with the target as local name."""
    if packages is not None:
        files = mentioning(files, packages)
    rows = each(scanned_files(files, ""), F.col("scan.imports"), "s").select("file_path", "s.*")
    if packages is not None:
        rows = rows.filter(F.col("package").isin(list(packages)))
    return rows.filter(F.col("local_name") == target) if target else rows


def element_rows(files: DataFrame, target: str | None = None) -> DataFrame:
    """One row per element of source text with a simple name: pos, component, attrs, props and the other columns."""
    others = [c for c in files.columns if c != "code"]
    rows = each(files.select(*others, scanned("code", target).alias("scan")), F.col("scan.tags"), "t")
    return _with_props(rows, *[F.col(c) for c in others], F.col("t.pos").alias("pos"), F.col("t.name").alias("component"))


def _with_props(rows: DataFrame, *columns: Column) -> DataFrame:
    read = rows.select(*columns, F.col("t.attrs").alias("attrs"))
    return read.withColumn("props", markup.props_of(F.col("attrs")))


def page_element_rows(pages: DataFrame, text: str = "html") -> DataFrame:
    """One row per element of a web page, where quotes and braces in the text mean nothing."""
    others = [F.col(c) for c in pages.columns if c != text]
    rows = each(pages, _page_tags(text), "t")
    read = rows.select(
        *others, F.col("t.pos").alias("pos"), F.col("t.name").alias("component"),
        markup.attribute_sources(F.col("t.raw"), F.col("t.name")).alias("_sources"),
        markup.attribute_names(F.col("t.raw"), F.col("t.name")).alias("_names"),
        markup.attribute_values(F.col("t.raw"), F.col("t.name")).alias("_values"),
    )
    return read.select(
        *[c for c in read.columns if not c.startswith("_")],
        markup.attribute_list(F.col("_sources"), F.col("_names"), F.col("_values")).alias("attrs"),
        markup.props_from(F.col("_names"), F.col("_values")).alias("props"),
    )


@built_once
def _page_tags(text: str) -> Column:
    return markup.opening_tags(markup.tag_tokens(F.col(text)))


def with_import(files: DataFrame, packages: Sequence[str], target: str | None, locate: bool = False, children: bool = False) -> DataFrame:
    """(file_path, scan, import) of the files that name a package; import is null without a match."""
    read = files if "scan" in files.columns else scanned_files(mentioning(files, packages), target, locate, children)
    return read.select(
        "file_path", "scan", markup.first_import(F.col("scan.imports"), packages, target).alias("import")
    )


def usages(
    files: DataFrame,
    packages: Sequence[str],
    target: str | None = None,
    root: str = "",
    locate: bool = False,
    spans: bool = False,
    children: bool = False,
) -> DataFrame:
    """Elements attributed to the package their file imports the target from.

    An element belongs to the file's first import (best-ranked package, then
    text order); a file without such an import contributes nothing.  With
    ``locate`` each usage also gets its line, column and
    ``relpath:line:column`` identity; with ``spans`` the ranges of its tags
    (``tag_...``) and the number of the file's unread tags (``n_unread``).
    ``component`` is the name in the tag, ``resolved`` the exported component
    behind the import; rules go by that.  Files of :func:`scanned_once` are not
    read again; their scan has no places and no children.
    """
    tags = F.when(F.col("import").isNotNull(), F.col("scan.tags"))
    n_unread = [F.size("scan.unread").alias("n_unread")] if spans else []
    found = with_import(files, packages, target, locate, children).select("file_path", "import", tags.alias("_tags"), *n_unread)
    rows = each(found, F.col("_tags"), "t")  # all tags of a file are not repeated beside each of them
    rel = relative_path(F.col("file_path"), root)
    columns = [
        F.col("file_path"),
        rel.alias("rel_path"),
        F.col("import.package").alias("package"),
        F.col("t.name").alias("component"),
        F.col("import.local_name").alias("local_name"),
        markup.component_name(F.col("import")).alias("resolved"),
        F.col("t.pos").alias("pos"),
        F.col("import"),
    ]
    if locate:
        place = F.concat_ws(":", rel, F.col("t.line"), F.col("t.column"))
        columns += [F.col("t.line").alias("line"), F.col("t.column").alias("column"), place.alias("usage_id")]
    if children:
        columns.append(F.col("t.children").alias("children"))
    if spans:
        columns += [F.col(f"t.{c}").alias(f"tag_{c}") for c in ("kind", "start", "stop", "close_start", "close_stop")]
        columns.append(F.col("n_unread"))
    return _with_props(rows, *columns)


def unattributed(files: DataFrame, packages: Sequence[str], target: str) -> DataFrame:
    """Files with elements of the target that no import of theirs explains, and how many."""
    named = files.filter(F.contains(F.col("code"), F.lit(f"<{target}")))
    found = scanned_files(named, target).select("file_path", "scan", markup.first_import(F.col("scan.imports"), packages, target).alias("import"))
    count = F.size("scan.tags").cast("bigint")
    return each(found, F.when(F.col("import").isNull() & (count > 0), F.array(count)), "n_elements").select("file_path", "n_elements")


def unread_tags(files: DataFrame, target: str) -> DataFrame:
    """Files with tags of the target whose attributes cannot be read, and how many.

    Such tags give no usages and are left alone by a rewrite, and their file
    keeps its import.
    """
    found = scanned_files(files.filter(F.contains(F.col("code"), F.lit(f"<{target}"))), target)
    return each(found, F.when(F.size("scan.unread") > 0, F.array(F.size("scan.unread"))), "n_unread").select("file_path", "n_unread")


def event_usages(events: DataFrame, file: str, component: str, props: str, package: str) -> DataFrame:
    """Event records as usages: the event type is the component, JSON fields are the props."""
    return events.select(
        F.col(file).cast("string").alias("file_path"),
        F.lit(package).alias("package"),
        F.col(component).alias("component"),
        F.from_json(props, "map<string,string>").alias("props"),
    )


def prop_rows(used: DataFrame, ignored: bool = False) -> DataFrame:
    """One row per usage and prop; ignored props only on request."""
    others = [c for c in used.columns if c not in ("props", "attrs", "import")]
    props = F.col("props") if ignored else reportable(F.col("props"))
    # outer, then filtered: see ``rows.each``
    return used.select(*others, F.explode_outer(props).alias("prop", "value")).filter(F.col("prop").isNotNull())


def distinct_elements(located: DataFrame) -> DataFrame:
    """One row per element identity."""
    return located.dropDuplicates(["usage_id"])
