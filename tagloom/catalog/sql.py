"""SQL building blocks of the query twins (DuckDB dialect).

Each block is one named subquery; :func:`with_blocks` puts the ones a query
needs in front of it.  They share the regular expressions with the Spark side
(in the RE2 form) and nothing else.
"""

from __future__ import annotations

from tagloom.catalog.bindings import PACKAGES, TARGET
from tagloom.functions.patterns import (
    EMPTY_EXPRESSION,
    ENTITIES,
    EXPRESSION_KINDS,
    NAME,
    NAMED_EXPRESSION_KINDS,
    OTHER_EXPRESSION,
    RE2,
)
from tagloom.functions.props import IGNORED_PROPS
from tagloom.operators.rules import SIZES, TYPES, VARIANTS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def _by_pattern(expression: str, kinds) -> str:
    parts = []
    for pattern, result in kinds:
        if "\\1" in result:
            before, after = result.split("\\1")
            value = f"{quoted(before)} || regexp_extract({expression}, {quoted(pattern)}, 1) || {quoted(after)}"
        else:
            value = quoted(result)
        parts.append(f"WHEN regexp_matches({expression}, {quoted(pattern)}) THEN {value}")
    return "CASE " + " ".join(parts) + f" ELSE {quoted(OTHER_EXPRESSION)} END"


def expression_case(expression: str) -> str:
    parts = [f"WHEN {expression} = '' THEN {quoted(EMPTY_EXPRESSION)}"]
    for starts, kinds in EXPRESSION_KINDS:
        parts.append(f"WHEN left({expression}, 1) IN ({', '.join(quoted(c) for c in starts)}) THEN {_by_pattern(expression, kinds)}")
    return "CASE " + " ".join(parts) + f" ELSE {_by_pattern(expression, NAMED_EXPRESSION_KINDS)} END"


def _decoded(text: str) -> str:
    for entity, char in ENTITIES:
        text = f"replace({text}, {quoted(entity)}, {quoted(char)})"
    return text


BLANKS = r"E' \t\r\n'"

BLOCKS: dict[str, tuple[list[str], str]] = {}


def block(name: str, needs: list[str], sql: str) -> None:
    BLOCKS[name] = (needs, sql)


block(
    "code_files",
    [],
    """
    SELECT 'src/' || p_brand || '/' || p_type || '/C' || p_partkey || '.tsx' AS file_path,
      E'import React from "react";\\n' ||
      CASE WHEN p_size % 10 = 9 THEN E'import { Text as T } from "@acme/ui";\\n'
           WHEN p_size % 10 = 8 THEN E'import { Text } from "@acme/ui";\\nimport Text from "@acme/ui/Text";\\n'
           WHEN p_size % 10 = 7 THEN E'import {\\n  Text,\\n  Box,\\n} from "@acme/ui";\\n'
           WHEN p_size % 10 = 6 THEN E'import * as UI from "@acme/kit";\\nimport { Title as Text } from "@acme/ui";\\n'
           WHEN p_size % 3 = 0 THEN E'import { Text, Box } from "@acme/ui";\\n'
           WHEN p_size % 3 = 1 THEN E'import Text from "@acme/ui/Text";\\n'
           ELSE '' END ||
      E'// <Text old />\\n\\nexport const View = () => (\\n  <Box>\\n' || body || E'\\n  </Box>\\n);\\n' AS code
    FROM part JOIN (
      SELECT l_partkey, string_agg(el, chr(10) ORDER BY el) AS body FROM (
        SELECT l_partkey, '    <' || nm || CASE WHEN extra = 4 THEN ' size="old"' ELSE '' END ||
          CASE q WHEN 1 THEN ' size="huge"' WHEN 2 THEN ' size="large"' WHEN 3 THEN ' size="medium"'
                 WHEN 4 THEN ' size="small"' WHEN 5 THEN ' size="tiny"' ELSE '' END ||
          CASE CASE WHEN q <> 0 THEN ln END WHEN 1 THEN ' type="body"' WHEN 2 THEN ' type="heading"' WHEN 3 THEN ' type="label"'
                  WHEN 4 THEN ' type="link"' WHEN 5 THEN ' type="metric"' WHEN 6 THEN ' type="mono"' ELSE '' END ||
          CASE rf WHEN 'R' THEN ' tag="a" href={url}' WHEN 'A' THEN ' className="x"' ELSE '' END ||
          CASE WHEN ls = 'F' THEN ' onClick={() => go(1)}' ELSE '' END ||
          CASE WHEN bold THEN ' bold' ELSE '' END ||
          CASE extra WHEN 0 THEN ' {...rest}' WHEN 1 THEN ' id=""' WHEN 2 THEN ' color={theme.primary}'
                     WHEN 3 THEN ' color={pick(theme)}' ELSE '' END ||
          ' n={' || n || '}>' || rf || '</' || nm || '>' AS el
        FROM (
          SELECT *, CASE WHEN ln = 7 THEN 'Box' WHEN dotted THEN 'Text.Bold' ELSE 'Text' END AS nm FROM (
            SELECT l_partkey, l_quantity::BIGINT % 7 AS q, l_linenumber AS ln, l_returnflag AS rf, l_linestatus AS ls,
                   l_suppkey % 11 = 0 AS dotted, l_suppkey % 5 = 0 AS bold, l_suppkey % 6 AS extra, count(*) AS n
            FROM lineitem GROUP BY ALL)))
      GROUP BY l_partkey) ON p_partkey = l_partkey
    """,
)

block(
    "statements",
    ["code_files"],
    f"""
    SELECT file_path, st_no, trim(raw, {BLANKS}) AS st,
      regexp_replace(regexp_extract(trim(raw, {BLANKS}), '^import\\s+([\\s\\S]*?)\\s*from\\s*["'']', 1), '^type\\s+', '') AS body
    FROM (SELECT file_path, unnest(r) AS raw, generate_subscripts(r, 1) AS st_no FROM (
      SELECT file_path, regexp_extract_all(code, {quoted(RE2.import_statement)}) AS r FROM code_files))
    """,
)

block(
    "all_imports",
    ["statements"],
    f"""
    SELECT file_path, package, row_number() OVER (PARTITION BY file_path ORDER BY st_no, sp_no) - 1 AS pos,
      specifier_type, import_type, import_stm, local_name, imported_name
    FROM (
      SELECT file_path, st_no, regexp_extract(st, 'from\\s*["'']([^"'']+)["'']', 1) AS package,
        replace(replace(st, E',\\n}}', ' }}'), E'\\n  ', ' ') AS import_stm, s.*
      FROM (
        SELECT *, -2 AS sp_no, 'ImportDefaultSpecifier' AS specifier_type, 'default' AS import_type,
          regexp_extract(body, '^([A-Za-z0-9_$]+)', 1) AS local_name, 'default' AS imported_name
        FROM statements WHERE regexp_matches(body, '^[A-Za-z0-9_$]')
        UNION ALL
        SELECT *, -1, 'ImportNamespaceSpecifier', NULL, regexp_extract(body, '\\*\\s*as\\s+([A-Za-z0-9_$]+)', 1), NULL
        FROM statements WHERE regexp_matches(body, '\\*\\s*as\\s+')
        UNION ALL
        SELECT file_path, st_no, st, body, sp_no, 'ImportSpecifier', 'named',
          regexp_extract(part, '([A-Za-z0-9_$]+)$', 1), regexp_extract(part, '^([A-Za-z0-9_$]+)', 1)
        FROM (SELECT file_path, st_no, st, body, trim(unnest(p), {BLANKS}) AS part, generate_subscripts(p, 1) AS sp_no
              FROM (SELECT *, string_split(regexp_extract(body, '\\{{([^}}]*)\\}}', 1), ',') AS p FROM statements
                    WHERE regexp_matches(body, '\\{{')))
        WHERE part <> ''
      ) AS t(file_path, st_no, st, body, sp_no, specifier_type, import_type, local_name, imported_name),
      LATERAL (SELECT t.sp_no, t.specifier_type, t.import_type, t.local_name, t.imported_name) AS s)
    """,
)

block(
    "imports",
    ["all_imports"],
    f"SELECT * FROM all_imports WHERE package IN ({', '.join(map(quoted, PACKAGES))}) AND local_name = {quoted(TARGET)}",
)

block(
    "chosen",
    ["imports"],
    f"""
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY list_position({_list(PACKAGES)}, package), pos) AS rn
      FROM imports) WHERE rn = 1
    """,
)


def tokens_sql(source: str, key: str, text: str) -> str:
    return f"""
    SELECT {key}, tok, pos, regexp_extract(tok, {quoted("^<(" + NAME + ")")}, 1) AS component FROM (
      SELECT {key}, unnest(r) AS tok, generate_subscripts(r, 1) - 1 AS pos FROM (
        SELECT {key}, regexp_extract_all({text}, {quoted(RE2.token)}) AS r FROM {source}))
    WHERE regexp_matches(tok, '^<[A-Za-z_$]')
    """


def attributes_sql(source: str) -> str:
    """Attributes of the elements of ``source`` (tok, component and any key columns)."""
    value = f"""
      CASE WHEN raw LIKE '{{%' THEN NULL
           WHEN src IS NULL THEN 'true'
           WHEN src LIKE '{{%' THEN {expression_case(f"trim(substr(src, 2, length(src) - 2), {BLANKS})")}
           WHEN src LIKE '"%' OR src LIKE '''%' THEN {_decoded("substr(src, 2, length(src) - 2)")}
           ELSE src END"""
    return f"""
    SELECT * EXCLUDE (r, tok, src), {value} AS value FROM (
      SELECT *, CASE WHEN raw NOT LIKE '{{%' THEN regexp_extract(raw, '^[^\\s=]+') END AS prop,
        CASE WHEN contains(raw, '=') THEN trim(substr(raw, instr(raw, '=') + 1), {BLANKS}) END AS src
      FROM (
        SELECT *, unnest(r) AS raw, generate_subscripts(r, 1) AS attr_no FROM (
          SELECT *, regexp_extract_all(substr(tok, length(component) + 2,
                      length(tok) - length(component) - 1 - CASE WHEN tok LIKE '%/>' THEN 2 ELSE 1 END),
                    {quoted(RE2.attribute)}) AS r
          FROM {source})))
    """


block("elements", ["code_files"], tokens_sql("code_files", "file_path", "code"))
block("element_attrs", ["elements"], attributes_sql("elements"))

block(
    "used",
    ["elements", "chosen"],
    f"""
    SELECT e.file_path, substr(e.file_path, 5) AS rel_path, c.package, e.component, c.local_name, e.pos, e.tok,
      c.import_type, c.imported_name
    FROM elements e JOIN chosen c USING (file_path) WHERE e.component = {quoted(TARGET)}
    """,
)
block("attrs", ["used"], attributes_sql("used"))
# all props of the attributed usages: no spreads, no empty values, the last one wins
block(
    "props",
    ["attrs"],
    """
    SELECT * EXCLUDE (rn, attr_no) FROM (
      SELECT *, row_number() OVER (PARTITION BY file_path, pos, prop ORDER BY attr_no DESC) AS rn
      FROM attrs WHERE prop IS NOT NULL AND value <> '') WHERE rn = 1
    """,
)
block(
    "reported",
    ["props"],
    f"SELECT * FROM props WHERE prop NOT IN ({', '.join(map(quoted, IGNORED_PROPS))})",
)
block(
    "prop_sets",
    ["used", "reported"],
    """
    SELECT u.file_path, u.pos, u.package, u.component, u.rel_path,
      coalesce(string_agg(r.prop || '=' || r.value, ',' ORDER BY r.prop), '') AS props, count(r.prop) AS n_props
    FROM used u LEFT JOIN reported r USING (file_path, pos) GROUP BY ALL
    """,
)
block(
    "wide",
    ["used", "props"],
    """
    SELECT u.file_path, u.pos, u.package, u.component, u.local_name, u.import_type, u.imported_name,
      max(value) FILTER (prop = 'size') AS size, max(value) FILTER (prop = 'type') AS type,
      max(value) FILTER (prop = 'tag') AS tag, max(value) FILTER (prop = 'href') AS href,
      max(value) FILTER (prop = 'onClick') AS on_click, max(value) FILTER (prop = 'bold') AS bold,
      max(value) FILTER (prop = 'color') AS color, max(value) FILTER (prop = 'n') AS n,
      max(value) FILTER (prop = 'className') AS class_name
    FROM used u LEFT JOIN props p USING (file_path, pos) GROUP BY ALL
    """,
)
block(
    "variants",
    [],
    "SELECT * FROM (VALUES " + ", ".join(f"({quoted(t)}, {quoted(s)}, {quoted(v)})" for t, s, v in VARIANTS)
    + ") AS v(type, size, variant)",
)
block(
    "scenarios",
    [],
    f"""
    SELECT NULL AS type, s AS size, i - 1 AS scenario_no FROM (SELECT unnest({_list(SIZES)}) AS s, generate_subscripts({_list(SIZES)}, 1) AS i)
    UNION ALL
    SELECT t, NULL, i - 1 + {len(SIZES)} FROM (SELECT unnest({_list(TYPES)}) AS t, generate_subscripts({_list(TYPES)}, 1) AS i)
    UNION ALL
    SELECT t, s, (i - 1) * {len(SIZES)} + (j - 1) + {len(SIZES) + len(TYPES)}
    FROM (SELECT unnest({_list(TYPES)}) AS t, generate_subscripts({_list(TYPES)}, 1) AS i),
         (SELECT unnest({_list(SIZES)}) AS s, generate_subscripts({_list(SIZES)}, 1) AS j)
    """,
)
block(
    "clauses",
    ["scenarios", "variants"],
    """
    SELECT s.scenario_no, s.type, s.size, v.variant,
      (s.type IS NOT NULL)::INT + (s.size IS NOT NULL)::INT AS n_terms
    FROM scenarios s JOIN variants v ON v.type = coalesce(s.type, 'body') AND v.size = coalesce(s.size, 'medium')
    """,
)
block(
    "variant_pos",
    ["clauses"],
    "SELECT variant, row_number() OVER (ORDER BY min(scenario_no)) - 1 AS vpos FROM clauses GROUP BY variant",
)


#: The source files where every element keeps its type, also the ones of quantities that are a multiple of seven.
TYPED_FILES = BLOCKS["code_files"][1].replace("CASE CASE WHEN q <> 0 THEN ln END WHEN 1", "CASE ln WHEN 1")


def with_blocks(query: str, *names: str, typed: bool = False) -> str:
    """A query with the blocks it needs in front, in dependency order; ``typed``: on :data:`TYPED_FILES`."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in BLOCKS[name][0]:
            visit(needed)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    bodies = {n: TYPED_FILES if typed and n == "code_files" else BLOCKS[n][1] for n in order}
    heads = ",\n".join(f"{n} AS MATERIALIZED ({bodies[n].strip()})" for n in order)
    return f"WITH {heads}\n{query.strip()}"
