"""Scans and edits pass between Arrow and Python as tuples, field by field."""

import pyarrow as pa

from tagloom.functions import rewriting, scanner
from tagloom.operators import extract

EDIT = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("text", pa.string()), ("close_start", pa.int32()), ("close_stop", pa.int32()), ("closing", pa.string())])
EDITS = [[{"start": i, "stop": i + 3, "text": None if i % 2 else f"t{i}", "close_start": -1, "close_stop": -1, "closing": None if i % 3 else "</T>"} for i in range(n)] for n in (2, 0, 5, 1)]


def test_edits_are_read_whole_also_from_a_slice():
    edits = pa.array(EDITS, pa.list_(EDIT))
    want = [[tuple(e.values()) for e in row] for row in EDITS]
    assert list(rewriting._edit_rows(edits)) == want
    assert list(rewriting._edit_rows(edits.slice(1, 2))) == want[1:3]
    assert list(rewriting._edit_rows(edits.slice(0, 0))) == [] and list(rewriting._edit_rows(edits[1:2])) == [[]]
    assert type(want[0][0][0]) is type(next(rewriting._edit_rows(edits))[0][0]) is int


def test_a_replacement_without_edits_inside_shows_the_text():
    code = '<A b="1" c={<A d="2"/>}/>'
    tag, inner = (0, len(code)), (code.index("<A d"), code.index("}/>"))
    plain = (inner[0], inner[1], f"<Z {scanner.MARK}{inner[0] + 3}:{inner[1] - 2}{scanner.MARK} x/>")
    assert scanner.spliced(code, [plain]) == '<A b="1" c={<Z d="2" x/>}/>'
    outer = (*tag, f"<Y {scanner.MARK}{code.index('c=')}:{len(code) - 2}{scanner.MARK}/>")
    assert scanner.spliced(code, [plain, outer]) == '<Y c={<Z d="2" x/>}/>'
    assert scanner.spliced(code, [(0, 2, "<B"), (3, 3, "")]) == '<B b="1" c={<A d="2"/>}/>'


def test_scans_are_tuples_in_the_order_of_their_fields():
    code = 'import N, { Text as T } from "p";\n<Text a="1" {...r}>x</Text>\n'
    imports, tags, unread, statements = extract._scan_row(code, "Text", True, True, True)
    assert imports[1] == ("p", 1, "ImportSpecifier", "named", 'import N, { Text as T } from "p";', "T", "Text")
    assert tags == [("Text", 0, "open", 2, 0, 34, 53, 54, 61, "x", [("a", "1", "text", 'a="1"', 40, 45), ("", "true", "spread", "{...r}", 46, 52)])]
    assert unread == [] and statements[0][2:] == ("p", "N", "", ["Text as T"], False)
