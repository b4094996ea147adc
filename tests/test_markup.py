import re
import time

import pytest

from tagloom.functions import scanner
from tagloom.operators import extract

UI = 'import { Text } from "@acme/ui";\n'


def props(files_of, body, target="Text", header=UI):
    rows = extract.usages(files_of({"/r/a.tsx": header + body}), ["@acme/ui"], target, "/r").orderBy("pos").collect()
    return [r.props for r in rows]


@pytest.mark.parametrize(
    "tag, expected",
    [
        ("<Text bold>", {"bold": "true"}),
        ('<Text id="">', {}),
        ('<Text {...p} a="1">', {"a": "1"}),
        ("<Text o={a.b}>", {"o": "a.b"}),
        ("<Text o={a.b.c}>", {"o": "undefined.c"}),
        ("<Text o={a[b]} p={a['b']}>", {"o": "a[b]", "p": "a[undefined]"}),
        ("<Text o={this.b}>", {"o": "undefined.b"}),
        ('<Text a="x" a="y">', {"a": "y"}),
        ('<Text a="x" a="">', {"a": "x"}),
        ('<Text {...p} {...q} a="x" {...p} b="">', {"a": "x"}),
        ("<Text n={01.50} z={0} t={true} u={null}>", {"n": "1.5", "z": "0", "t": "true", "u": "null"}),
        ("<Text s={'q'} e={\"\"}>", {"s": "q"}),
        ("<Text f={() => a > b}>", {"f": "ArrowFunctionExpression"}),
        ("<Text f={async x => { if (x) { y({z: 1}) } }}>", {"f": "ArrowFunctionExpression"}),
        ("<Text s={{a: 1}} t={`x`} l={[1, 2]}>", {"s": "ObjectExpression", "t": "TemplateLiteral", "l": "ArrayExpression"}),
        ("<Text c={f(1)} n={!a} m={-1}>", {"c": "CallExpression", "n": "UnaryExpression", "m": "UnaryExpression"}),
        ("<Text o={a?.b} x={a ? b : c} j={<b/>}>", {"o": "OptionalMemberExpression", "x": "Expression", "j": "JSXElement"}),
        ('<Text t="a &amp; &lt;b&gt;">', {"t": "a & <b>"}),
        ("<Text\n  a='1'\n  data-x={2}\n>", {"a": "1", "data-x": "2"}),
        ('<Text a="x"/>', {"a": "x"}),
        ('<Text a = "x" b= {y} />', {"a": "x", "b": "y"}),
        ("<Text a={/* no */}>", {"a": "JSXEmptyExpression"}),
    ],
)
def test_props(files_of, tag, expected):
    assert props(files_of, tag) == [expected]


@pytest.mark.parametrize(
    "body",
    ["<Text.Bold a='1' />", "<Texts a='1' />", "// <Text />\n", "/* <Text /> */", "<!-- <Text /> -->", "a <Text && b", "</Text>"],
)
def test_not_an_element(files_of, body):
    assert props(files_of, body) == []


def test_long_input_does_not_overflow(files_of):
    tag = "<Text " + " ".join(f"a{i}={{b{i}}}" for i in range(20000)) + ">"
    text = "<b " + "word " * 50000 + tag + "x" * 100000
    assert len(props(files_of, text)[0]) == 20000


@pytest.mark.parametrize(
    "header, found",
    [
        ('import { Text as T } from "@acme/ui";\n', False),
        ('import { Foo as Text } from "@acme/ui";\n', True),
        ('import Text from "@acme/ui";\n', True),
        ('import * as Text from "@acme/ui";\n', True),
        ('import type { Text } from "@acme/ui";\n', True),
        ("import {\n  Box,\n  Text,\n} from '@acme/ui'\n", True),
        ('import { Text } from "@acme/other";\n', False),
        ("", False),
        ('import "@acme/ui";\n', False),
    ],
)
def test_import_decides(files_of, header, found):
    assert len(props(files_of, "<Text a='1'/>", header=header)) == found


def test_import_rows(files_of):
    code = 'import D, { a, type b as c } from "p";\nimport * as N from "q";\nimport {\n  x,\n  y,\n} from "r";\n'
    rows = extract.import_rows(files_of({"f": code})).orderBy("pos").collect()
    assert [(r.package, r.import_type, r.local_name, r.imported_name) for r in rows] == [
        ("p", "default", "D", "default"), ("p", "named", "a", "a"), ("p", "named", "c", "b"),
        ("q", None, "N", None), ("r", "named", "x", "x"), ("r", "named", "y", "y"),
    ]
    assert rows[4].import_stm == 'import { x, y } from "r";'


def test_best_ranked_package_wins(files_of):
    code = 'import { Text } from "@acme/ui";\nimport Text from "@acme/ui/Text";\n<Text a="1"/>'
    row = extract.usages(files_of({"f": code}), ["@acme/ui/Text", "@acme/ui"], "Text").collect()[0]
    assert (row.package, row.resolved) == ("@acme/ui/Text", "Text")


def test_locations_against_plain_python(spark, files_of):
    code = UI + "\n".join(f"{'é' * (i % 7)}<Text n={{{i}}}\n  a='x'>{i}</Text>" + "\n" * (i % 3) for i in range(700))
    rows = extract.usages(files_of({"/r/s/a.tsx": code}), ["@acme/ui"], "Text", "/r", locate=True).orderBy("pos").collect()
    want = []
    for m in re.finditer(r"<Text\b", code):
        before = code[: m.start()]
        want.append((before.count("\n") + 1, len(before) - before.rfind("\n") - 1))
    assert [(r.line, r.column) for r in rows] == want
    assert rows[0].usage_id == f"s/a.tsx:{want[0][0]}:{want[0][1]}"
    assert rows[0].rel_path == "s/a.tsx"


def test_no_target_takes_every_simple_name(files_of):
    code = UI + "<Box><Text a='1'/><b/></Box>"
    rows = extract.usages(files_of({"f": code}), ["@acme/ui"]).orderBy("pos").collect()
    assert [r.component for r in rows] == ["Box", "Text", "b"]


def test_attribute_kinds(files_of):
    row = extract.element_rows(files_of({"f": "<A b c='1' d={2} {...e}/>"})).collect()[0]
    assert [(a.name, a.kind) for a in row.attrs] == [("b", "shorthand"), ("c", "text"), ("d", "expr"), ("", "spread")]


def test_text_is_read_once(files_of):
    used = extract.usages(files_of({"f": UI}), ["@acme/ui"], "Text").select("file_path", "props")
    plan = used._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1


def test_unread_tags_are_listed(files_of):
    broken = '<Text a="1" =/>'
    deep = "<Text a=" + "{" * 900 + "1" + "}" * 900 + " />"
    files = files_of({"deep": UI + deep, "broken": UI + "<Text/>" + broken, "note": UI + "// " + broken, "less": "a <Text && b"})
    assert [tuple(r) for r in extract.unread_tags(files, "Text").collect()] == [("broken", 1)]


def tags(files_of, code, target=None):
    return [(r.component, r.props) for r in extract.element_rows(files_of({"f": code}), target).orderBy("pos").collect()]


@pytest.mark.parametrize(
    "code, expected",
    [
        ('<Box icon={<Text a="1" />} />', [("Box", {"icon": "JSXElement"}), ("Text", {"a": "1"})]),
        ('<Text b={<Text a="1" />} a="2">', [("Text", {"b": "JSXElement", "a": "2"}), ("Text", {"a": "1"})]),
        ('<Text<Foo> a="1" />', [("Text", {"a": "1"})]),
        ("<Text a={{b: {c: {d: {e: {f: {g: {h: 1}}}}}}}} />", [("Text", {"a": "ObjectExpression"})]),
        ("const s = '<Text a=\"1\">';", []),
        ("const s = `<Text a='1'>${<b c='2'/>}`;", [("b", {"c": "2"})]),
        ('foo(); // <Text a="1" />', []),
        ("x.replace(/['\"]/g, '') && <Text a='1'/>", [("Text", {"a": "1"})]),
        ("<p>don't <b a='1'/> won't</p>", [("p", {}), ("b", {"a": "1"})]),
        ("<p>{/* <Text /> */}{'<Text />'}<b/></p>", [("p", {}), ("b", {})]),
        ("useState<Text>(1); f(a < b, c > d)", []),
        ("const f = <T extends U>(x) => <Text a='1'/>", [("Text", {"a": "1"})]),
        ("<Text n={1e3} h={0x1f} u={1_000} />", [("Text", {"n": "1000", "h": "31", "u": "1000"})]),
        ('<Text t="&copy; &nbsp;&#65;&x" />', [("Text", {"t": "\u00a9 \u00a0A&x"})]),
        ("<Text a={'}'} b={/* } */ 1} />", [("Text", {"a": "}", "b": "Expression"})]),
        ("<>a<Text/></>", [("Text", {})]),
    ],
)
def test_source_text_beyond_patterns(files_of, code, expected):
    assert tags(files_of, code) == expected


@pytest.mark.parametrize(
    "code, packages",
    [
        ('import A from "x"; import { Text } from "@acme/ui";', ["x", "@acme/ui"]),
        ('import { Text /* c */, // d\n Box } from "@acme/ui";', ["@acme/ui", "@acme/ui"]),
        ('/* import { Text } from "a"; */ // import B from "b"\nimport C from "c"', ["c"]),
        ("const s = 'import D from \"d\"';\nfunction f() { import E from 'e' }", []),
    ],
)
def test_imports_wherever_they_stand(files_of, code, packages):
    assert [r.package for r in extract.import_rows(files_of({"f": code})).orderBy("pos").collect()] == packages


def test_time_is_linear_in_the_text(files_of):
    code = "<Text a={" * 3000 + "1" + "}/>" * 3000 + "'" * 5000 + "/" * 5000 + "<a " * 5000 + "{" * 5000
    assert len(tags(files_of, code, "Text")) == 3000


ODD_NUMBERS = [("1e999", "Infinity"), ("0x_", "Expression"), ("0x" + "f" * 6000, "Infinity"), ("9" * 5000, "Infinity"), ("1_000", "1000"), ("0xff", "255"), ("1.50", "1.5"), (".5", "0.5")]


@pytest.mark.parametrize("text, want", ODD_NUMBERS)
def test_odd_numbers_are_recorded(text, want):
    assert scanner.expression_text(text) == want


ODD_TEXTS = ["import" + " " * 1_000_000 + "x", "<A>" + "</x>" * 100_000, "import a\n" * 50_000, "import {" + "\n" * 500_000 + "} from", "<A><B>" * 20_000 + "</x>" * 50_000 + "</A>"]


@pytest.mark.parametrize("text", ODD_TEXTS, ids=range(len(ODD_TEXTS)))
def test_reading_is_linear(text):
    begin = time.process_time()
    scanner.Scan(text)
    assert time.process_time() - begin < 3


IMPORTS = [
    ('import type from "x"', ("x", "type", "", [], False)),
    ('import type { A, type B } from "x";', ("x", "", "", ["A", "B"], True)),
    ("import A, * as B from 'y'", ("y", "A", "B", [], False)),
    ('import from from "z"', ("z", "from", "", [], False)),
    ('import A /* from "q" */ from "x"', ("x", "A", "", [], False)),
    ('import /*c*/ {\n A as B,\n} // z\n from "x";', ("x", "", "", ["A as B"], False)),
    ('import broken\nimport A from "x"', ("x", "A", "", [], False)),
]


@pytest.mark.parametrize("text, want", IMPORTS)
def test_import_clauses(text, want):
    (found,) = scanner.Scan(text).imports
    assert found[2:] == want


def test_elements_close_in_their_own_stretch():
    scan = scanner.Scan("<A>{<B/>}</A><C><D></C></D>")
    assert [(t[0], t[5]) for t in scan.tags] == [("A", 9), ("B", None), ("C", 19), ("D", None)]
