"""A batch of texts is read and rewritten a stretch at a time."""

import pyarrow as pa

from tagloom.catalog.demo_rules import demo_rules
from tagloom.functions.batches import stretches
from tagloom.operators import changes, extract, rewrite


def test_stretches_hold_every_row_once():
    texts = pa.array(["a" * 5, None, "", "b" * 5, "c" * 50, "d", "e" * 10])
    assert list(stretches(texts, 10)) == [(0, 4), (4, 1), (5, 1), (6, 1)]
    assert list(stretches(texts, 10**6)) == [(0, 7)]
    assert list(stretches(texts[:0], 10)) == []


def test_a_large_batch_is_answered_in_parts(spark, monkeypatch):
    """The reading function gives several arrays for one batch, so the rows of all its tags never stand in memory together."""
    given = []
    monkeypatch.setattr(extract.F, "arrow_udf", lambda kind: lambda read: given.append(read) or (lambda column: column))
    extract.scanned("code", "Text")
    code = 'import { Text } from "@acme/ui";\n' + '<Text a="1"></Text>\n' * 20_000
    parts = list(given[0](iter([pa.array([code, None, code, code, "<Text b />"])])))
    assert [len(part) for part in parts] == [3, 2]
    assert [len(row["tags"]) for part in parts for row in part.to_pylist()] == [20_000, 0, 20_000, 20_000, 1]


def test_texts_of_many_stretches_are_rewritten_whole(spark):
    head = 'import { Text } from "@acme/ui";\n'
    rows = [(f"src/{i}.tsx", None if i % 7 == 3 else head + "// " + "x" * (600_000 if i % 5 == 0 else 1) + f'\n<Text size="old" n="{i}"></Text>\n') for i in range(20)]
    files = spark.createDataFrame(rows, "file_path string, code string").coalesce(1)
    done = rewrite.rewrite_files(files, ["@acme/ui"], demo_rules(spark), "Text", compiled=True).collect()
    texts = dict(rows)
    assert sorted(r.file_path for r in done) == sorted(p for p, t in rows if t is not None)
    for r in done:
        assert r.code_before == texts[r.file_path] and r.n_elements == texts[r.file_path].count("<Text")
        assert r.code_after.count("<Text") == r.n_elements and f'n="{r.file_path[4:-4]}"' in r.code_after


def test_rows_that_wait_for_their_text_hold_no_scan(spark, capsys):
    """What a rewrite holds beside the writing function is the text and its edits, not all tags of the file once more."""
    files = spark.createDataFrame([("src/a.tsx", 'import { Text } from "@acme/ui";\n<Text size="old" />\n')], "file_path string, code string")
    done = rewrite.rewrite_files(files, ["@acme/ui"], demo_rules(spark), "Text", compiled=True)
    for rows in (done, changes.changed_files(done)):
        rows.explain("formatted")
        nodes = [node.split("\n") for node in capsys.readouterr().out.split("\n\n") if ") ArrowEvalPython\n" in node]
        held = {"write" if "[write(" in "".join(node) else "read": next(line for line in node if line.startswith("Input")) for node in nodes}
        assert set(held) == {"read", "write"} and "code#" in held["write"]
        assert "scan#" not in held["write"] and " e#" not in held["write"]
    assert [r.n_elements for r in done.collect()] == [1]
