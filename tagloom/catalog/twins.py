"""SQL twins of the catalog queries (DuckDB dialect)."""

from __future__ import annotations

from tagloom.catalog.bindings import NEW_PACKAGE, PACKAGES
from tagloom.catalog.sql import attributes_sql, block, quoted, tokens_sql, with_blocks
from tagloom.functions.patterns import RE2

TWINS: dict[str, str] = {}


def twin(name: str, query: str, *blocks: str, typed: bool = False) -> None:
    TWINS[name] = with_blocks(query, *blocks, typed=typed) if blocks else query.strip()


# ---- blocks of this module ----

block(
    "page_files",
    [],
    "SELECT page_id::VARCHAR AS file_path, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS package, html FROM pages",
)
block("page_elements", ["page_files"], tokens_sql("page_files", "file_path, package", "html"))
block("page_attrs", ["page_elements"], attributes_sql("page_elements"))
block(
    "page_props",
    ["page_attrs"],
    """
    SELECT * EXCLUDE (rn, attr_no) FROM (
      SELECT *, row_number() OVER (PARTITION BY file_path, pos, prop ORDER BY attr_no DESC) AS rn
      FROM page_attrs WHERE prop IS NOT NULL AND value <> '') WHERE rn = 1
    """,
)
block(
    "full_sets",
    ["used", "props"],
    """
    SELECT u.file_path, u.pos, u.package, u.component, u.local_name,
      CASE WHEN u.import_type = 'default' THEN u.local_name ELSE coalesce(u.imported_name, u.local_name) END AS resolved,
      coalesce(string_agg(p.prop || '=' || p.value, ',' ORDER BY p.prop), '') AS props
    FROM used u LEFT JOIN props p USING (file_path, pos) GROUP BY ALL
    """,
)
block(
    "ruled",
    ["wide"],
    "SELECT * FROM wide WHERE CASE WHEN import_type = 'default' THEN local_name ELSE coalesce(imported_name, local_name) END = 'Text'",
)
# every rule every usage satisfies; spec = terms of the first clause
block(
    "hits",
    ["ruled", "clauses", "variant_pos"],
    f"""
    SELECT file_path, pos, package, rule_pos, spec FROM (
      SELECT file_path, pos, package, 0 AS rule_pos, 2 AS spec FROM ruled
        WHERE package = '@acme/ui' AND href IS NOT NULL AND bold IS NOT NULL
      UNION ALL SELECT file_path, pos, package, 1, 1 FROM ruled WHERE package = '@acme/ui' AND href = 'url'
      UNION ALL SELECT file_path, pos, package, 2, 2 FROM ruled
        WHERE package = '@acme/ui' AND (class_name = 'x' AND type = 'mono' OR class_name IS NOT NULL AND type = 'label')
      UNION ALL SELECT file_path, pos, package, 3, 3 FROM ruled
        WHERE package = '@acme/ui' AND type IS NULL AND on_click IS NULL AND color IS DISTINCT FROM 'CallExpression'
      UNION ALL SELECT file_path, pos, package, 4, 1 FROM ruled WHERE package = '@acme/ui' AND color = 'theme.primary'
      UNION ALL
      SELECT DISTINCT r.file_path, r.pos, r.package, vpos + CASE WHEN r.package = '@acme/ui' THEN 5 ELSE 0 END, f.n_terms
      FROM ruled r
      JOIN clauses c ON (c.size IS NULL OR c.size = r.size) AND (c.type IS NULL OR c.type = r.type)
      JOIN variant_pos USING (variant)
      JOIN (SELECT variant, arg_min(n_terms, scenario_no) AS n_terms FROM clauses GROUP BY variant) f USING (variant)
      UNION ALL SELECT file_path, pos, package, 20, 0 FROM ruled WHERE package = '@acme/ui')
    """,
)
block(
    "won",
    ["hits"],
    "SELECT file_path, pos, package, min(rule_pos) AS rule_pos FROM hits GROUP BY ALL",
)
block(
    "effects",
    ["variant_pos"],
    """
    SELECT '@acme/ui/Text' AS package, vpos AS rule_pos, 'variant' AS key, variant AS value FROM variant_pos
    UNION ALL SELECT '@acme/ui', vpos + 5, 'variant', variant FROM variant_pos
    UNION ALL SELECT '@acme/ui', * FROM (VALUES (0, 'tone', 'quiet'), (1, 'plain', 'true'), (1, 'tone', 'loud'),
      (2, 'box', 'tight'), (3, 'level', 'base'))
    """,
)
block(
    "removals",
    ["variant_pos"],
    """
    SELECT package, rule_pos, unnest(['type', 'size']) AS prop FROM (
      SELECT '@acme/ui/Text' AS package, vpos AS rule_pos FROM variant_pos
      UNION ALL SELECT '@acme/ui', vpos + 5 FROM variant_pos)
    UNION ALL SELECT '@acme/ui', * FROM (VALUES (0, 'bold'), (0, 'color'), (0, 'size'), (1, 'tag'), (2, 'className'))
    """,
)
# attributes after remove, rename and set; sort_no keeps their order
block(
    "new_attrs",
    ["won", "attrs", "props", "effects", "removals"],
    """
    WITH kept AS (
      SELECT a.file_path, a.pos, a.attr_no AS sort_no, a.prop, a.value, a.raw
      FROM attrs a JOIN won w USING (file_path, pos)
      WHERE a.prop IS NULL OR NOT (
        EXISTS (SELECT 1 FROM removals r WHERE r.package = w.package AND r.rule_pos = w.rule_pos AND r.prop = a.prop)
        OR EXISTS (SELECT 1 FROM effects e WHERE e.package = w.package AND e.rule_pos = w.rule_pos AND e.key = a.prop)
        OR (w.package = '@acme/ui' AND w.rule_pos = 1 AND a.prop IN ('href', 'goto')
            AND EXISTS (SELECT 1 FROM props p WHERE p.file_path = a.file_path AND p.pos = a.pos AND p.prop = 'href'))))
    SELECT * FROM kept
    UNION ALL
    SELECT p.file_path, p.pos, 1000, 'goto', p.value, 'goto="' || p.value || '"'
    FROM props p JOIN won w USING (file_path, pos) WHERE w.package = '@acme/ui' AND w.rule_pos = 1 AND p.prop = 'href'
    UNION ALL
    SELECT w.file_path, w.pos, 2000 + row_number() OVER (PARTITION BY w.file_path, w.pos ORDER BY e.key), e.key, e.value,
      CASE WHEN e.key = 'plain' THEN 'plain' ELSE e.key || '="' || e.value || '"' END
    FROM won w JOIN effects e USING (package, rule_pos)
    """,
)


def shown_props(attrs: str) -> str:
    """Sorted props text per usage of an attribute table (file_path, pos, sort_no, prop, value)."""
    return f"""
    SELECT w.file_path, w.pos, w.package, w.rule_pos, coalesce(string_agg(a.prop || '=' || a.value, ',' ORDER BY a.prop), '') AS props
    FROM won w LEFT JOIN (
      SELECT file_path, pos, prop, arg_max(value, sort_no) AS value FROM {attrs}
      WHERE prop IS NOT NULL AND value <> '' GROUP BY ALL) a USING (file_path, pos)
    GROUP BY ALL"""


block("new_sets", ["won", "new_attrs"], shown_props("new_attrs"))
block(
    "outer_inner",
    ["won", "attrs", "props"],
    """
    SELECT w.file_path, w.pos, ' tone="quiet"' ||
        coalesce(string_agg(' ' || a.raw, '' ORDER BY a.attr_no) FILTER (a.prop NOT IN ('href', 'n')), '') AS outer_attrs,
      coalesce(string_agg(' ' || a.raw, '' ORDER BY a.attr_no) FILTER (a.prop IN ('href', 'n')), '') AS inner_attrs
    FROM won w LEFT JOIN (
      SELECT a.* FROM attrs a JOIN props p USING (file_path, pos, prop) WHERE a.prop NOT IN ('bold', 'color', 'size')) a
      USING (file_path, pos)
    WHERE w.package = '@acme/ui' AND w.rule_pos = 0
    GROUP BY ALL
    """,
)
block(
    "moving",
    ["won", "chosen"],
    """
    SELECT DISTINCT c.file_path, c.package, c.import_type, c.local_name
    FROM chosen c JOIN won w USING (file_path) WHERE NOT (w.package = '@acme/ui' AND w.rule_pos = 4)
    """,
)
block(
    "kept_imports",
    ["all_imports", "moving"],
    """
    SELECT i.* FROM all_imports i WHERE NOT EXISTS (
      SELECT 1 FROM moving m WHERE m.file_path = i.file_path AND m.package = i.package AND m.import_type = i.import_type
        AND m.local_name = CASE WHEN i.import_type = 'default' THEN i.local_name ELSE i.imported_name END)
    """,
)
block(
    "all_tokens",
    ["code_files"],
    f"""
    SELECT file_path, unnest(g) AS gap, unnest(list_concat(r, [''])) AS tok, generate_subscripts(g, 1) - 1 AS pos FROM (
      SELECT file_path, regexp_extract_all(code, {quoted(RE2.token)}) AS r,
        regexp_split_to_array(code, {quoted(RE2.token)}) AS g FROM code_files)
    """,
)
block(
    "new_tags",
    ["won", "new_attrs", "outer_inner"],
    """
    SELECT w.file_path, w.pos, '<Text' || coalesce(string_agg(' ' || a.raw, '' ORDER BY a.sort_no), '') || '>' AS tag, '</Text>' AS closing
    FROM won w LEFT JOIN new_attrs a USING (file_path, pos)
    WHERE NOT (w.package = '@acme/ui' AND w.rule_pos = 0) GROUP BY ALL
    UNION ALL
    SELECT file_path, pos, '<Card' || outer_attrs || E'>\\n    <Card.Link kind="jump"' || inner_attrs || '>', E'</Card.Link>\\n</Card>' FROM outer_inner
    """,
)
block(
    "rewritten",
    ["code_files", "all_tokens", "new_tags", "chosen", "won", "moving"],
    f"""
    SELECT f.file_path, c.package, f.code AS code_before,
      CASE WHEN m.file_path IS NULL THEN t.body
           WHEN c.package = '@acme/ui/Text'
             THEN E'import {{ Text }} from "{NEW_PACKAGE}";\\n' || replace(t.body, E'\\nimport Text from "@acme/ui/Text";', '')
           WHEN contains(t.body, E'import {{\\n  Text,') THEN
             E'import {{ Text }} from "{NEW_PACKAGE}";\\n' || replace(t.body, E'import {{\\n  Text,\\n  Box,\\n}} from', 'import {{ Box }} from')
           ELSE E'import {{ Text }} from "{NEW_PACKAGE}";\\n' || replace(t.body, 'import {{ Text, Box }} from', 'import {{ Box }} from')
      END AS code_after
    FROM code_files f JOIN chosen c USING (file_path)
    JOIN (SELECT file_path, string_agg(gap || tok, '' ORDER BY pos) AS body FROM (
            SELECT t.file_path, t.pos, t.gap, coalesce(n.tag, o.closing, t.tok) AS tok
            FROM all_tokens t LEFT JOIN new_tags n USING (file_path, pos)
            LEFT JOIN new_tags o ON o.file_path = t.file_path AND o.pos = t.pos - 1)
          GROUP BY file_path) t USING (file_path)
    LEFT JOIN moving m USING (file_path)
    WHERE f.file_path IN (SELECT file_path FROM won WHERE NOT (package = '@acme/ui' AND rule_pos = 4))
    """,
)
block(
    "edited",
    [],
    """
    SELECT doc_id::VARCHAR AS file_path, text AS code_before,
      replace(replace(text, ' de ', ' of '), chr(10), chr(10) || chr(10)) AS code_after FROM documents
    """,
)


def line_changes_sql(source: str) -> str:
    return f"""
    SELECT file_path, line, sum(s)::BIGINT AS n FROM (
      SELECT file_path, unnest(string_split(code_after, chr(10))) AS line, 1 AS s FROM {source}
      UNION ALL SELECT file_path, unnest(string_split(code_before, chr(10))), -1 FROM {source})
    GROUP BY ALL HAVING sum(s) <> 0"""


block("edit_lines", ["edited"], line_changes_sql("edited"))


def levels_sql(source: str) -> str:
    return f"""
    SELECT CASE WHEN grouping(package) = 1 THEN 'all' WHEN grouping(component) = 1 THEN 'package' ELSE 'component' END AS level,
      package, component, prop, count(*) AS n, count(DISTINCT value) AS n_values
    FROM {source} GROUP BY GROUPING SETS ((prop), (package, prop), (package, component, prop))"""


PKGS = ", ".join(map(quoted, PACKAGES))

# ---- extraction ----

twin("element_usages", """
    SELECT e.file_path, e.package, e.component, e.pos, coalesce(string_agg(p.prop || '=' || p.value, ',' ORDER BY p.prop), '') AS props
    FROM page_elements e LEFT JOIN page_props p USING (file_path, pos) GROUP BY ALL""", "page_elements", "page_props")
twin("prop_entries", """
    SELECT file_path, pos, component, attr_no - 1 AS attr_no, prop, value,
      CASE WHEN raw LIKE '{%' THEN 'spread' WHEN NOT contains(raw, '=') THEN 'shorthand' WHEN contains(raw, '={') THEN 'expr' ELSE 'text' END AS kind
    FROM element_attrs""", "element_attrs")
twin("prop_values", """
    SELECT component, prop, value, count(*) AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY file_path, pos, prop ORDER BY attr_no DESC) AS rn
      FROM element_attrs WHERE prop IS NOT NULL AND value <> '') WHERE rn = 1 GROUP BY ALL""", "element_attrs")
twin("rel_paths", """
    SELECT DISTINCT 'src/' || p_brand || '/' || p_type || '/C' || p_partkey || '.tsx' AS file_path,
      p_brand || '/' || p_type || '/C' || p_partkey || '.tsx' AS rel_path, 'C' || p_partkey || '.tsx' AS file_name,
      2 + length(p_type) - length(replace(p_type, '/', '')) + 1 AS depth
    FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_type <> 'PROMO' AND p_brand <> 'Brand#13'""")
twin("import_specifiers", "SELECT * FROM all_imports", "all_imports")
twin("target_imports", """
    SELECT file_path, package, import_type, imported_name,
      CASE WHEN import_type = 'default' THEN local_name ELSE coalesce(imported_name, local_name) END AS component
    FROM imports""", "imports")
twin("package_members", f"""
    SELECT package, (list_position([{PKGS}], package) - 1)::BIGINT AS pkg_rank, count(*) AS n, count(DISTINCT local_name) AS n_names
    FROM all_imports WHERE package IN ({PKGS}) GROUP BY ALL""", "all_imports")
twin("usage_location", """
    SELECT u.rel_path || ':' || l.line || ':' || l.col AS usage_id, l.line, l.col AS "column", u.package, u.component
    FROM used u JOIN (
      SELECT file_path, pos, 1 + length(before) - length(replace(before, chr(10), '')) AS line,
        length(string_split(before, chr(10))[-1]) AS col
      FROM (SELECT file_path, pos, gap, string_agg(gap || tok, '' ORDER BY pos) OVER (
              PARTITION BY file_path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
              coalesce(prev, '') || gap AS before FROM all_tokens)) l USING (file_path, pos)""", "used", "all_tokens")
twin("elements_dedup", "SELECT package, count(*) AS n, count(DISTINCT file_path) AS n_files FROM used GROUP BY package", "used")
twin("selected_elements", """
    SELECT file_path, count(*) AS n_elements, max(pos) AS last_pos FROM used
    WHERE file_path IN (SELECT file_path FROM won WHERE package = '@acme/ui' AND rule_pos = 0) GROUP BY file_path""", "used", "won")

# ---- attribution ----

twin("attributed_usages", """
    SELECT f.file_path, substr(f.file_path, 5) AS rel_path, f.pos, f.package, f.component, f.local_name, f.resolved,
      c.import_type, c.import_stm, f.props FROM full_sets f JOIN chosen c USING (file_path)""", "full_sets", "chosen")
twin("attributed_join", "SELECT file_path, pos, package, component, import_type FROM used", "used")
twin("unattributed_files", """
    SELECT file_path, count(*) AS n_elements FROM elements
    WHERE component = 'Text' AND file_path NOT IN (SELECT file_path FROM imports) GROUP BY file_path""", "elements", "imports")
twin("usage_import_decl", f"""
    SELECT u.package, i.import_stm, count(*) AS n FROM used u JOIN (
      SELECT file_path, package, arg_max(import_stm, pos) AS import_stm FROM all_imports
      WHERE package IN ({PKGS}) GROUP BY ALL) i USING (file_path, package) GROUP BY ALL""", "used", "all_imports")
twin("reread_elements", """
    SELECT file_path, count(*) AS n_elements, max(pos) AS last_pos FROM elements
    WHERE component = 'Text' AND file_path LIKE 'src/Brand#1%' AND file_path IN (SELECT file_path FROM imports WHERE package = '@acme/ui/Text')
    GROUP BY file_path""", "elements", "imports")
twin("scope_counts", """
    SELECT 'all' AS scope, count(*) AS n FROM used
    UNION ALL SELECT 'package', count(*) FROM used WHERE package = '@acme/ui'
    UNION ALL SELECT 'component', count(*) FROM used WHERE package = '@acme/ui/Text' AND component = 'Text'""", "used")

# ---- reports ----

twin("usage_summary", """
    SELECT package, component, count(*) AS n_usages, count(DISTINCT file_path) AS n_files FROM used GROUP BY ALL""", "used")
twin("summary_rows", "SELECT package, component, local_name, props, count(*) AS n FROM full_sets GROUP BY ALL", "full_sets")
twin("prop_levels", levels_sql("reported"), "reported")
twin("page_prop_levels", levels_sql("page_props WHERE prop NOT IN ('className', 'data-testid', 'id', 'style', 'key')"), "page_props")
twin("event_prop_levels", """
    SELECT CASE WHEN grouping(package) = 1 THEN 'all' WHEN grouping(component) = 1 THEN 'package' ELSE 'component' END AS level,
      package, component, prop, count(*) AS n, count(DISTINCT value) AS n_values
    FROM (SELECT 'events' AS package, event_type AS component, unnest(json_keys(props)) AS prop,
            props ->> unnest(json_keys(props)) AS value FROM events)
    GROUP BY GROUPING SETS ((prop), (package, prop), (package, component, prop))""")
twin("prop_value_freq", "SELECT prop, value, count(*) AS n FROM reported GROUP BY ALL", "reported", typed=True)
twin("prop_file_freq", "SELECT prop, file_path, count(*) AS n FROM reported GROUP BY ALL", "reported")
twin("prop_totals", "SELECT prop, count(*) AS n FROM reported GROUP BY prop ORDER BY n DESC, prop", "reported")
twin("column_totals", """
    SELECT prop, count(*) || 'x' AS total, CASE WHEN length(prop) > 16 THEN left(prop, 13) || '...' ELSE rpad(prop, 16, ' ') END AS cell
    FROM reported GROUP BY prop""", "reported")
twin("distinct_props", "SELECT DISTINCT prop FROM reported", "reported")
twin("prop_combos", """
    SELECT props, count(*) AS n, count(DISTINCT file_path) AS n_files, n_props FROM prop_sets GROUP BY props, n_props""", "prop_sets")
twin("combo_files", "SELECT props, file_path, count(*) AS n FROM prop_sets GROUP BY ALL", "prop_sets", typed=True)
twin("combo_table", """
    SELECT row_number() OVER (ORDER BY n_props DESC, n DESC, props) AS row_no, props, n, n_props
    FROM (SELECT props, n_props, count(*) AS n FROM prop_sets GROUP BY ALL)""", "prop_sets", typed=True)
twin("combo_count", "SELECT count(DISTINCT props) AS n_combos FROM prop_sets", "prop_sets")
twin("combo_cells", """
    SELECT c.props, r.prop, r.value, c.n, t.n AS prop_total FROM (
      SELECT props, count(*) AS n FROM prop_sets GROUP BY props) c
    JOIN (SELECT DISTINCT s.props, r.prop, r.value FROM prop_sets s JOIN reported r USING (file_path, pos)) r USING (props)
    JOIN (SELECT prop, count(*) AS n FROM reported GROUP BY prop) t USING (prop)""", "prop_sets", "reported")
block(
    "pivot_order",
    ["reported"],
    """
    SELECT prop, total, (no - 1) // 3 AS block, (no - 1) % 3 AS slot FROM (
      SELECT prop, count(*) AS total, row_number() OVER (ORDER BY count(*) DESC, prop) AS no FROM reported GROUP BY prop)
    """,
)
twin("pivot_columns", "SELECT * FROM pivot_order", "pivot_order")
twin("combo_pivot", """
    SELECT c.props, c.n, b.block, coalesce(max(value) FILTER (slot = 0), '-') AS c1, coalesce(max(value) FILTER (slot = 1), '-') AS c2,
      coalesce(max(value) FILTER (slot = 2), '-') AS c3
    FROM (SELECT props, count(*) AS n FROM prop_sets GROUP BY props) c
    JOIN (SELECT DISTINCT props, 0::BIGINT AS block, NULL AS slot, NULL AS value FROM prop_sets
          UNION ALL SELECT DISTINCT s.props, o.block, o.slot, r.value FROM prop_sets s JOIN reported r USING (file_path, pos)
            JOIN pivot_order o USING (prop)) b USING (props)
    GROUP BY ALL""", "prop_sets", "pivot_order")
twin("combo_sketches", """
    SELECT CASE WHEN grouping(package) = 1 THEN 'all' WHEN grouping(component) = 1 THEN 'package' ELSE 'component' END AS level,
      package, component, count(DISTINCT props) AS n_exact, true AS near
    FROM prop_sets GROUP BY GROUPING SETS ((), (package), (package, component))""", "prop_sets")
twin("usages_per_file", "SELECT file_path, count(*) AS n_elements FROM used GROUP BY file_path", "used")
twin("props_per_usage", "SELECT file_path, pos, n_props FROM prop_sets ORDER BY n_props DESC, file_path, pos", "prop_sets")
twin("directory_rollup", """
    SELECT array_to_string(parts[1:i], '/') AS prefix, count(*) AS n_usages, count(DISTINCT rel_path) AS n_files FROM (
      SELECT rel_path, string_split(rel_path, '/') AS parts, unnest(range(1, len(string_split(rel_path, '/')) + 1)) AS i FROM used)
    GROUP BY ALL""", "used")
twin("component_index", """
    SELECT package, component, dense_rank() OVER (ORDER BY package) AS pkg_no,
      row_number() OVER (PARTITION BY package ORDER BY component) AS comp_no
    FROM (SELECT DISTINCT package, component FROM page_elements)""", "page_elements")
twin("prop_names_locale", """
    SELECT names, count(*) AS n FROM (
      SELECT u.file_path, u.pos, coalesce(string_agg(prop, ',' ORDER BY lower(prop), prop), '') AS names
      FROM used u LEFT JOIN reported r USING (file_path, pos) GROUP BY ALL) GROUP BY names""", "used", "reported")

# ---- rules ----

twin("rule_scenarios", """
    SELECT s.scenario_no, s.type, s.size, count(w.file_path) AS n FROM scenarios s
    LEFT JOIN wide w ON w.type IS NOT DISTINCT FROM s.type AND w.size IS NOT DISTINCT FROM s.size GROUP BY ALL""", "scenarios", "wide")
twin("variant_rules", """
    SELECT v.variant, count(*) AS n, count(w.type) AS n_type, count(w.size) AS n_size FROM wide w
    JOIN variants v ON v.type = coalesce(w.type, 'body') AND v.size = coalesce(w.size, 'medium') GROUP BY v.variant""", "wide", "variants")
twin("variant_clauses", """
    SELECT p.package, v.vpos AS rule_pos, v.vpos * 2 + p.no + 300 AS rule_order, v.variant,
      (SELECT count(*) FROM clauses c WHERE c.variant = v.variant) AS n_clauses, coalesce(h.n, 0) AS n
    FROM variant_pos v CROSS JOIN (VALUES ('@acme/ui/Text', 0), ('@acme/ui', 1)) AS p(package, no)
    LEFT JOIN (
      SELECT package, vpos, count(*) AS n FROM (
        SELECT r.file_path, r.pos, r.package, min(vpos) AS vpos FROM ruled r
        JOIN clauses c ON (c.size IS NULL OR c.size = r.size) AND (c.type IS NULL OR c.type = r.type)
        JOIN variant_pos USING (variant) GROUP BY ALL)
      GROUP BY ALL) h ON h.package = p.package AND h.vpos = v.vpos""", "ruled", "variant_pos")
twin("package_rules", """
    SELECT package, rule_pos, variant, n_terms::BIGINT AS n_terms, count(*) AS n FROM (
      SELECT r.file_path, r.pos, r.package, min(c.rule_pos) AS rule_pos, arg_min(c.variant, c.rule_pos) AS variant,
        arg_min(c.n_terms, c.rule_pos) AS n_terms
      FROM ruled r JOIN (SELECT *, row_number() OVER (ORDER BY n_terms DESC, scenario_no) - 1 AS rule_pos FROM clauses) c
        ON (c.size IS NULL OR c.size = r.size) AND (c.type IS NULL OR c.type = r.type) GROUP BY ALL)
    GROUP BY ALL""", "ruled", "clauses")
twin("rebound_rules", """
    SELECT package, vpos AS rule_pos, package AS import_from, count(*) AS n FROM (
      SELECT r.file_path, r.pos, r.package, min(vpos) AS vpos FROM ruled r
      JOIN clauses c ON (c.size IS NULL OR c.size = r.size) AND (c.type IS NULL OR c.type = r.type)
      JOIN variant_pos USING (variant) GROUP BY ALL)
    GROUP BY ALL""", "ruled", "clauses", "variant_pos")
twin("rule_skeletons", f"""
    SELECT p.package, 'Text' AS component, (c.no - 1) * 2 + p.no + 1 AS rule_order, c.props AS "match", 'Label' AS new_component,
      p.package AS import_from, {quoted(NEW_PACKAGE)} AS import_to
    FROM (SELECT props, row_number() OVER (ORDER BY n_props DESC, n DESC, props) AS no
          FROM (SELECT props, n_props, count(*) AS n FROM prop_sets GROUP BY ALL)) c
    CROSS JOIN (VALUES ('@acme/ui/Text', 0), ('@acme/ui', 1)) AS p(package, no)""", "prop_sets")

# ---- matching ----

twin("first_match", "SELECT file_path, pos, package, rule_pos FROM won", "won")
twin("match_anchor", "SELECT file_path, pos, package, rule_pos FROM won", "won")
twin("most_specific_match", """
    SELECT file_path, pos, package, arg_min(rule_pos, -spec * 1000 + rule_pos) AS rule_pos FROM hits GROUP BY ALL""", "hits")
twin("negated_match", """
    SELECT f.file_path, f.pos, f.props FROM full_sets f JOIN won w USING (file_path, pos)
    WHERE w.package = '@acme/ui' AND w.rule_pos = 3""", "full_sets", "won")
twin("unmatched_usages", """
    SELECT package, resolved, count(*) AS n FROM full_sets f
    WHERE NOT EXISTS (SELECT 1 FROM won w WHERE w.file_path = f.file_path AND w.pos = f.pos) GROUP BY ALL""", "full_sets", "won")
twin("files_without_rules", """
    SELECT file_path, package, resolved, count(*) AS n_elements FROM full_sets WHERE resolved <> 'Text' GROUP BY ALL""", "full_sets")

# ---- rewriting ----

twin("props_removed", f"""
    SELECT file_path, pos, props FROM ({shown_props('''(
      SELECT a.*, a.attr_no AS sort_no FROM attrs a JOIN won w USING (file_path, pos)
      WHERE NOT EXISTS (SELECT 1 FROM removals r WHERE r.package = w.package AND r.rule_pos = w.rule_pos AND r.prop = a.prop))''')})
    """, "won", "attrs", "removals")
twin("props_renamed", """
    SELECT w.file_path, w.pos, string_agg(CASE WHEN prop = 'href' THEN 'goto' ELSE prop END || '=' || value, ','
      ORDER BY CASE WHEN prop = 'href' THEN 'goto' ELSE prop END) AS props
    FROM won w JOIN props p USING (file_path, pos)
    WHERE w.package = '@acme/ui' AND w.rule_pos = 1 AND prop <> 'tag' GROUP BY ALL""", "won", "props")
twin("props_set", f"""
    SELECT file_path, pos, props FROM ({shown_props('''(
      SELECT a.file_path, a.pos, a.attr_no AS sort_no, a.prop, a.value FROM attrs a
      UNION ALL SELECT w.file_path, w.pos, 2000, e.key, e.value FROM won w JOIN effects e USING (package, rule_pos))''')})
    """, "won", "attrs", "effects")
twin("rule_applied", """
    SELECT s.file_path, s.pos, s.rule_pos, s.props, coalesce(r.rendered, '') AS rendered FROM new_sets s LEFT JOIN (
      SELECT file_path, pos, string_agg(' ' || raw, '' ORDER BY sort_no) AS rendered FROM new_attrs GROUP BY ALL) r
    USING (file_path, pos)""", "new_sets", "new_attrs")
twin("variant_counts", """
    SELECT s.package, coalesce(e.value, '-') AS variant, count(*) AS n FROM new_sets s
    LEFT JOIN effects e ON e.package = s.package AND e.rule_pos = s.rule_pos AND e.key = 'variant' GROUP BY ALL""", "new_sets", "effects")
twin("template_split", "SELECT * FROM outer_inner", "outer_inner")
twin("template_rendered", """
    SELECT o.file_path, o.pos, '<Card' || outer_attrs || E'>\\n    <Card.Link kind="jump"' || inner_attrs || '>' || t.gap || E'</Card.Link>\\n</Card>' AS rendered
    FROM outer_inner o JOIN all_tokens t ON t.file_path = o.file_path AND t.pos = o.pos + 1""", "outer_inner", "all_tokens")
twin("mutated_flags", """
    SELECT w.package, w.rule_pos, NOT (w.package = '@acme/ui' AND w.rule_pos = 4) AS mutated,
      NOT (w.package = '@acme/ui' AND w.rule_pos IN (4, 20)) AS changed, count(*) AS n
    FROM won w GROUP BY ALL""", "won")

# ---- imports ----

twin("imports_pruned", "SELECT file_path, package, specifier_type, local_name FROM kept_imports", "kept_imports")
twin("imports_added", f"""
    SELECT file_path, {quoted(NEW_PACKAGE)} AS package, {quoted(f'import {{ Text }} from "{NEW_PACKAGE}";')} AS import_stm, 'Text' AS local_name
    FROM moving""", "moving")
twin("imports_rewired", f"""
    SELECT package, specifier_type, local_name, count(*) AS n FROM (
      SELECT package, specifier_type, local_name FROM kept_imports
      UNION ALL SELECT {quoted(NEW_PACKAGE)}, 'ImportSpecifier', 'Text' FROM moving) GROUP BY ALL""", "kept_imports", "moving")
twin("migration_units", f"""
    SELECT file_path, arg_max(package, (list_position([{PKGS}], package), component)) AS package,
      arg_max(component, (list_position([{PKGS}], package), component)) AS component, count(*) AS n_elements
    FROM (SELECT file_path, package, CASE WHEN import_type = 'default' THEN local_name ELSE coalesce(imported_name, local_name) END AS component
          FROM all_imports WHERE package IN ({PKGS})) GROUP BY file_path""", "all_imports")

# ---- change sets ----

twin("changed_files", "SELECT file_path, code_before, code_after FROM rewritten", "rewritten")
twin("line_changes", line_changes_sql("rewritten"), "rewritten")
twin("document_line_changes", """
    SELECT file_path, sum(greatest(n, 0))::BIGINT AS added, sum(greatest(-n, 0))::BIGINT AS removed FROM edit_lines GROUP BY file_path""", "edit_lines")
twin("blank_moves_dropped", "SELECT file_path, md5(line) AS line_hash, n FROM edit_lines WHERE regexp_matches(line, '\\S')", "edit_lines")
twin("run_summary", """
    SELECT r.package, 'Text' AS component, count(*) AS n_files, sum(u.n)::BIGINT AS n_elements, 'would migrate' AS mode
    FROM rewritten r JOIN (SELECT file_path, count(*) AS n FROM used GROUP BY file_path) u USING (file_path) GROUP BY r.package""",
    "rewritten", "used")

# ---- stored tables ----

twin("stored_usages", """
    SELECT f.package, f.component, c.import_type, f.props, count(*) AS n FROM full_sets f JOIN chosen c USING (file_path)
    WHERE f.package = '@acme/ui' GROUP BY ALL""", "full_sets", "chosen")
twin("stored_summary", "SELECT prop, value, count(*) AS n FROM reported GROUP BY ALL", "reported")
twin("stored_tree", "SELECT package, rel_path, count(*) AS n_usages FROM used GROUP BY ALL", "used")
twin("stored_rules", """
    SELECT package, count(*) AS n, count(DISTINCT props) AS n_rules FROM prop_sets GROUP BY package""", "prop_sets")
twin("stored_rewrites", """
    SELECT file_path, length(code_before) - length(replace(code_before, chr(10), '')) + 1 AS lines_before,
      length(code_after) - length(replace(code_after, chr(10), '')) + 1 AS lines_after FROM rewritten""", "rewritten")
twin("tree_scan", """
    SELECT file_path, length(code) AS n_chars, md5(code) AS code_hash FROM code_files
    WHERE NOT contains('/' || file_path, '/PROMO/')""", "code_files")
twin("spec_packages", """
    SELECT CASE package WHEN '@acme/ui/Text' THEN 0 ELSE 1 END::BIGINT AS pkg_rank, package, count(*) AS n_usages
    FROM used GROUP BY package""", "used")
twin("nested_tree", """
    SELECT package, CASE number % 3 WHEN 0 THEN rel_path WHEN 1 THEN p[2] || '/' || p[3]
      ELSE p[1] || '/' || p[2] || '/deep/x' || number % 5 || '/' || p[3] END AS rel_path, count(*) AS n_usages
    FROM (SELECT package, rel_path, string_split(rel_path, '/') AS p, regexp_extract(rel_path, 'C([0-9]+)[.]tsx$', 1)::BIGINT AS number FROM used)
    GROUP BY ALL""", "used")
twin("skeleton_rewrites", f"""
    SELECT f.file_path, c.package,
      CASE WHEN c.package = '@acme/ui/Text'
             THEN E'import {{ Text }} from "{NEW_PACKAGE}";\\n' || replace(t.body, E'\\nimport Text from "@acme/ui/Text";', '')
           WHEN contains(t.body, E'import {{\\n  Text,') THEN
             E'import {{ Text }} from "{NEW_PACKAGE}";\\n' || replace(t.body, E'import {{\\n  Text,\\n  Box,\\n}} from', 'import {{ Box }} from')
           ELSE E'import {{ Text }} from "{NEW_PACKAGE}";\\n' || replace(t.body, 'import {{ Text, Box }} from', 'import {{ Box }} from')
      END AS code_after
    FROM code_files f JOIN chosen c USING (file_path)
    JOIN (SELECT file_path, string_agg(gap || tok, '' ORDER BY pos) AS body FROM (
            SELECT t.file_path, t.pos, t.gap, coalesce(n.tag, t.tok) AS tok FROM all_tokens t LEFT JOIN (
              SELECT u.file_path, u.pos, '<Text' || coalesce(string_agg(' ' || a.raw, '' ORDER BY a.attr_no), '') || ' seen>' AS tag
              FROM used u LEFT JOIN attrs a USING (file_path, pos) GROUP BY ALL) n USING (file_path, pos))
          GROUP BY file_path) t USING (file_path)
    WHERE (c.package = '@acme/ui/Text' OR c.imported_name = 'Text')
      AND f.file_path IN (SELECT file_path FROM used)""", "code_files", "all_tokens", "chosen", "used", "attrs")
twin("nested_elements", """
    SELECT 'kit/S' || s_suppkey || '.tsx' AS file_path, component, n, count(*) AS found FROM (
      SELECT s_suppkey, unnest(CASE s_suppkey % 8
        WHEN 0 THEN [('Box', 'outer'), ('Text', 'inner')]
        WHEN 1 THEN [('Text', 'deep')]
        WHEN 2 THEN [('Text', 'real')]
        WHEN 3 THEN [('Text', 'typed')]
        WHEN 4 THEN [('Text', 'after')]
        WHEN 5 THEN [('Text', 'a'), ('Text', 'b'), ('Text', 'c')]
        WHEN 6 THEN [('Text', 'said')]
        ELSE [('Text', 'in')] END) AS e FROM supplier), LATERAL (SELECT e[1] AS component, e[2] AS n)
    GROUP BY ALL""")
twin("unread_tags", """
    SELECT 'kit/S' || s_suppkey || '.tsx' AS file_path, 1::BIGINT AS n_unread FROM supplier WHERE s_suppkey % 8 = 7""")
