import pytest

from tagloom.operators import changes, extract, imports, rewrite
from tagloom.plans import migrate
from tagloom.sources.rules import rules_from_document

HEAD = 'import React from "react";\nimport { Text, Box } from "old";\n'
MOVE = {"importFrom": "old", "importTo": "new"}


def run(spark, files_of, rules, body, head=HEAD, **options):
    table = rules_from_document(spark, {"old": {"Text": rules}})
    rows = rewrite.rewrite_files(files_of({"f": head + body}), ["old"], table, "Text", **options).collect()
    return rows[0] if rows else None


def test_remove_rename_set(spark, files_of):
    rule = {"match": [{"a": True}], "remove": ["a", "size"], "rename": {"a": "b", "href": "to"}, "set": {"v": "x", "on": True, "off": False}}
    row = run(spark, files_of, [rule], '<Text a={go} size="s" {...r} v="old" href={url}>hi</Text>\n<Text z="1"/>\n')
    assert row.code_after == HEAD + '<Text {...r} b="go" to="url" v="x" on off={false}>hi</Text>\n<Text z="1"/>\n'
    assert (row.mutated, row.n_elements, row.n_matched) == (True, 2, 1)


def test_renames_follow_one_another(spark, files_of):
    row = run(spark, files_of, [{"match": [{}], "rename": {"a": "b", "b": "c"}}], '<Text a="1" b="2" />')
    # b is renamed from its original value, which takes the b just written with it
    assert row.code_after.endswith('<Text c="2" />')


def test_template_around_nested_children(spark, files_of):
    rule = {
        "match": [{"tag": "a"}], "remove": ["tag"], "set": {"asChild": True, "n": 5},
        "replaceWith": {"INNER_PROPS": ["href"], "code": "\n<Text {...OUTER_PROPS}>\n  <a {...INNER_PROPS}>{CHILDREN}</a>\n</Text>"},
    }
    body = '<Text tag="a" href={u} color="c"><b>x</b><Text>in</Text><Text tag="a">deep</Text></Text>'
    row = run(spark, files_of, [rule], body)
    inner = "<Text asChild n={5}>\n  <a>deep</a>\n</Text>"
    assert row.code_after == HEAD + f'<Text asChild n={{5}} color="c">\n  <a href={{u}}><b>x</b><Text>in</Text>{inner}</a>\n</Text>'


def test_template_without_place_for_children(spark, files_of):
    rule = {"match": [{"a": True}], "replaceWith": {"code": "<Icon {...OUTER_PROPS} />"}}
    row = run(spark, files_of, [rule], '<Text a="1">x</Text><Text a="2" /><Text a="3">')
    assert row.code_after == HEAD + '<Text a="1">x</Text><Icon a="2" /><Text a="3">'
    assert (row.n_matched, row.n_unsupported) == (3, 2)


def test_component_rename_is_opt_in(spark, files_of):
    rule = {"match": [{"a": "1"}], "newCompName": "Label"}
    body = '<Text a="1"><Text>i</Text></Text>'
    assert run(spark, files_of, [rule], body).code_after == HEAD + body
    assert run(spark, files_of, [rule], body, rename_components=True).code_after == HEAD + '<Label a="1"><Text>i</Text></Label>'


@pytest.mark.parametrize(
    "head, expected",
    [
        ('import { Text, Box } from "old";\n', 'import { Text } from "new";\nimport { Box } from "old";\n'),
        ('import { Text } from "old";\n', 'import { Text } from "new";\n'),
        ('import Text from "old";\nlet a;\n', 'import { Text } from "new";\nlet a;\n'),
        ('import Text, { Box } from "old";\n', 'import { Text } from "new";\nimport { Box } from "old";\n'),
        ('import { Text } from "old";\nimport { X } from "new";\n', 'import { X } from "new";\n'),
        ('import { Text } from "old";\nimport N from "new";\n', 'import { Text } from "new";\nimport N from "new";\n'),
        ("import {\n  Text,\n  Box as B,\n} from 'old'\n", "import { Text } from \"new\";\nimport { Box as B } from 'old'\n"),
    ],
)
def test_import_rewiring(spark, files_of, head, expected):
    row = run(spark, files_of, [{"match": [{}], **MOVE}], "<Text/>\n", head=head)
    assert row.code_after == expected + "<Text/>\n"


def test_alias_import_has_no_rules(spark, files_of):
    assert run(spark, files_of, [{"match": [{}], **MOVE}], "<Text/>", head='import { Foo as Text } from "old";\n') is None


def test_unmatched_file_is_unchanged(spark, files_of):
    row = run(spark, files_of, [{"match": [{"q": "1"}], "set": {"a": "b"}, **MOVE}], '<Text a="1"/>')
    assert row.code_after == row.code_before and not row.mutated


def test_twice_is_once(spark, files_of):
    rules = rules_from_document(spark, {"old": {"Text": [{"match": [{"a": "1"}], "remove": ["a"], "set": {"v": "x"}}]}})
    files = files_of({"f": HEAD + '<Text a="1" b="2">x</Text>'})
    once = rewrite.rewrite_files(files, ["old"], rules, "Text").selectExpr("file_path", "code_after AS code")
    twice = rewrite.rewrite_files(once, ["old"], rules, "Text").collect()[0]
    assert twice.code_after == once.collect()[0].code and not twice.mutated


def test_dry_run_equals_apply(spark, files_of, tmp_path):
    rules = rules_from_document(spark, {"old": {"Text": [{"match": [{"a": "1"}], "remove": ["a"], **MOVE}]}})
    files = files_of({"f": HEAD + '\n\n\n<Text a="1" b="2">x</Text>\n', "g": "nothing"})
    done = rewrite.rewrite_files(files, ["old"], rules, "Text")
    stored = migrate.apply(done, str(tmp_path / "new"))
    assert sorted(map(str, migrate.dry_run(done).collect())) == sorted(map(str, changes.hunks(stored).collect()))
    hunk = [(h.op, h.line) for h in migrate.dry_run(done).orderBy("hunk", "line_no").collect()]
    assert ("-", '<Text a="1" b="2">x</Text>') in hunk and ("+", '<Text b="2">x</Text>') in hunk
    lines = {(x.line, x.n) for x in changes.line_changes(stored).collect()}
    assert lines == {
        ('import { Text, Box } from "old";', -1), ('import { Box } from "old";', 1), ('import { Text } from "new";', 1),
        ('<Text a="1" b="2">x</Text>', -1), ('<Text b="2">x</Text>', 1),
    }
    assert changes.run_summary(done).collect()[0]["mode"] == "would migrate"
    assert changes.run_summary(done, apply=True).collect()[0]["mode"] == "migrated"


def test_table_form_of_imports_agrees(spark, files_of):
    rules = rules_from_document(spark, {"old": {"Text": [{"match": [{}], **MOVE}]}})
    files = files_of({"a": HEAD + "<Text/>", "b": 'import Text from "old";\n<Text/>', "c": 'import { Text } from "x";\n<Text/>'})
    after = imports.rewired_imports(imports.file_moves(files, ["old"], rules, "Text"))
    texts = rewrite.rewrite_files(files, ["old"], rules, "Text").selectExpr("file_path", "code_after AS code")
    key = ("file_path", "package", "local_name")
    want = {tuple(x[k] for k in key) for x in extract.import_rows(texts).collect()}
    got = {tuple(x[k] for k in key) for x in after.filter("file_path <> 'c'").collect()}
    assert got == want


def test_pairing_in_a_text_with_very_many_tags(spark, files_of):
    body = '<Text a="1">x</Text>' * 3000
    rule = {"match": [{"a": "1"}], "replaceWith": {"code": "<T>{CHILDREN}</T>"}}
    row = run(spark, files_of, [rule], body)
    assert row.code_after == HEAD + "<T>x</T>" * 3000


def test_nested_elements_are_rewritten_inside_out(spark, files_of):
    rules = [{"match": [{"drop": True}], "remove": ["drop"]}, {"match": [{"a": "1"}], "set": {"v": "x"}, **MOVE}]
    body = '<Text b={<Text a="1" c={() => <Text a="1">{1}</Text>} />} a="1">t</Text><Text drop={<Text a="1"/>} k={<Text a="1"/>} />'
    row = run(spark, files_of, rules, body)
    assert row.code_after == 'import { Text } from "new";\nimport React from "react";\nimport { Box } from "old";\n' + (
        '<Text b={<Text a="1" c={() => <Text a="1" v="x">{1}</Text>} v="x" />} a="1" v="x">t</Text><Text k={<Text a="1" v="x" />} />'
    )


def test_a_template_keeps_edits_in_its_attributes(spark, files_of):
    rules = [{"match": [{"t": True}], "replaceWith": {"code": "<Q {...OUTER_PROPS}><R {...INNER_PROPS}>{CHILDREN}</R></Q>", "INNER_PROPS": ["i"]}}, {"match": [{"a": "1"}], "remove": ["a"]}]
    row = run(spark, files_of, rules, '<Text t i={<Text a="1" />} o={<Text a="1" z="2" />}>x</Text>')
    assert row.code_after == HEAD + '<Q t o={<Text z="2" />}><R i={<Text />}>x</R></Q>'


def test_strings_and_comments_stay(spark, files_of):
    body = "const s = '<Text a=\"1\">'; // <Text a=\"1\" />\n"
    assert run(spark, files_of, [{"match": [{}], "set": {"v": "x"}, **MOVE}], body) is None
    row = run(spark, files_of, [{"match": [{}], "set": {"v": "x"}}], body + "<Text/>")
    assert row.code_after == HEAD + body + '<Text v="x" />'


def test_unread_tags_keep_the_import(spark, files_of):
    row = run(spark, files_of, [{"match": [{}], "set": {"v": "x"}, **MOVE}], '<Text a="1" =/>\n<Text/>')
    assert row.code_after == HEAD + '<Text a="1" =/>\n<Text v="x" />'


def test_thousands_of_rules(spark, files_of):
    rules = [{"match": [{"n": str(i), "m": True}], "set": {"v": f"x{i}"}} for i in range(5000)]
    row = run(spark, files_of, rules, "".join(f'<Text n="{i}" m />' for i in range(0, 5000, 500)))
    assert row.code_after == HEAD + "".join(f'<Text n="{i}" m v="x{i}" />' for i in range(0, 5000, 500))
    assert row.n_matched == 10


def test_compiled_rules_rewrite_alike(spark, files_of):
    rules = [{"match": [{"a": "1"}], "set": {"v": "x"}}, {"match": [{"!b": True}], "remove": ["c"], **MOVE}]
    body = '<Text a="1"/><Text b="2" c="3"/><Text c="4">x</Text>'
    assert run(spark, files_of, rules, body) == run(spark, files_of, rules, body, compiled=True)


def test_compiled_rules_edit_inside_the_files_row(spark, files_of):
    """The same edits as by the join, without a shuffle; counting them reads no text a second time."""
    texts = {
        "a": 'import { Text, Box } from "old";\n<Text a="1"><Text a={<Text b/>}/></Text>',
        "b": 'import Text from "old";\nimport { X } from "new";\n<Text b>x</Text><Text/>',
        "c": 'import { Text } from "old";\n<Text a="1" bad={1} =><Text a="1"/>',
        "d": 'import { Title as Text } from "old";\n<Text a="1"/>',
        "e": "<Text a='1'/>",
    }
    rules = rules_from_document(spark, {"old": {"Text": [
        {"match": [{"a": "1"}], "set": {"z": True}, "importFrom": "old", "importTo": "new"},
        {"match": [{"b": True}], "replaceWith": {"code": "<W {...OUTER_PROPS}>{CHILDREN}</W>"}, "importFrom": "old", "importTo": "other"},
        {"match": [{"a": True}], "remove": ["a"]},
    ]}})
    files = files_of(texts)
    inside = rewrite.rewrite_files(files, ["old"], rules, "Text", compiled=True)
    joined = rewrite.rewrite_files(files, ["old"], rules, "Text")
    assert sorted(map(str, inside.collect())) == sorted(map(str, joined.collect()))
    shown = inside._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in shown and "Join" not in shown and shown.count("ArrowEvalPython [") == 2
    counted = rewrite.file_edits(files, ["old"], rules, "Text", compiled=True).filter("mutated").groupBy("package").count()
    assert counted._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1


def test_moves_with_compiled_rules_group_one_row_a_file(spark):
    document = {"old": {"Text": [{"match": [{"a": True}], **MOVE}, {"match": [{"b": True}], "importFrom": "old", "importTo": "also"}, {"match": [{"c": True}], "importTo": "no"}]}}
    table = rules_from_document(spark, document)
    files = spark.createDataFrame([
        ("f", HEAD + "<Text a />\n" * 40 + "<Text b />\n<Text c />\n<Text />\n<Box a />\n"), ("none", HEAD), ("no import", "<Text a />\n"),
        ("unread", HEAD + "<Text a /><Text a={1} =></Text>\n"), ("twice", HEAD + "<Text a />\n"), ("twice", HEAD + "<Text a />\n"),
        (None, HEAD + "<Text b />\n"), ("empty", None),
    ], "file_path string, code string")
    moves = [imports.file_moves(files, ["old"], table, "Text", compiled=c) for c in (False, True)]
    by_join, in_rows = [sorted(map(repr, m.collect())) for m in moves]
    assert in_rows == by_join
    assert {r.file_path: r.targets for r in moves[1].collect()} == {
        "f": ["also", "new"], "none": [], "no import": [], "unread": [], "twice": ["new"], None: ["also"], "empty": [],
    }
    assert "Generate" not in moves[1]._jdf.queryExecution().optimizedPlan().toString()  # no row per tag reaches the grouping
