"""A rewrite by join reads every text once and keeps tags, edits and text of a file together."""

from tagloom.operators import aggregates, extract, match, rewrite
from tagloom.sources.rules import rules_from_document

RULES = {"old": {"Text": [
    {"match": [{"a": "1"}], "set": {"z": True}, "importFrom": "old", "importTo": "new"},
    {"match": [{"b": True}], "replaceWith": {"code": "<W {...OUTER_PROPS}>{CHILDREN}</W>"}, "importFrom": "old", "importTo": "other"},
    {"match": [{"!c": True}], "remove": ["a"]},
]}}
TEXTS = {
    "a": 'import { Text, Box } from "old";\n<Text a="1"><Text a={<Text b/>}/></Text>',
    "b": 'import Text from "old";\nimport { X } from "new";\n<Text b>x</Text><Text c="2"/>',
    "c": 'import { Text } from "old";\n<Text a="1" bad={1} =><Text a="1"/>',
    "d": 'import { Title as Text } from "old";\n<Text a="1"/>',
    "e": "<Text a='1'/>", "f": 'import { Text } from "old";\n', "g": None, None: 'import { Text } from "old";\n<Text a="1"/>',
}


def shown(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_not_shuffled_after_they_are_read(spark, files_of):
    rules, files = rules_from_document(spark, RULES), files_of(TEXTS)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = rewrite.rewrite_files(files, ["old"], rules, "Text")
        plan = shown(joined)
        assert "hashpartitioning(file_path" not in plan and "hashpartitioning(full_key" not in plan
        assert plan.count("ArrowEvalPython [") == 1  # the texts are put together; nothing is read a second time
        rows = joined.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    inside = rewrite.rewrite_files(files.filter("file_path IS NOT NULL"), ["old"], rules, "Text", compiled=True).collect()
    assert sorted(map(str, rows)) == sorted(map(str, inside)) and {r.file_path for r in rows} == {"a", "b", "c"}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("once_")]


def test_scanned_files_give_the_same_usages_and_texts(spark, files_of):
    rules, files = rules_from_document(spark, RULES), files_of({k: v for k, v in TEXTS.items() if k})
    stored = extract.scanned_once(files, ["old"], "Text")
    assert extract.scanned_once(stored, ["old"], "Text") is stored
    assert sorted(map(str, stored.select("file_path", "code").collect())) == sorted(map(str, files.collect()))
    used, again = (extract.usages(f, ["old"], "Text", spans=True) for f in (files, stored))
    assert sorted(map(str, again.collect())) == sorted(map(str, used.collect()))
    combos = [sorted(map(str, aggregates.combinations(u).collect())) for u in (used, again)]
    assert combos[0] == combos[1] and len(combos[0]) > 3
    done = [sorted(map(str, rewrite.rewrite_files(f, ["old"], rules, "Text", "most_specific").collect())) for f in (files, stored)]
    assert done[0] == done[1] and len(done[0]) == 3


def test_many_sets_are_matched_without_a_broadcast_alike(spark, files_of, monkeypatch):
    rules, files = rules_from_document(spark, RULES), files_of(TEXTS)
    few = rewrite.rewrite_files(files, ["old"], rules, "Text").collect()
    monkeypatch.setattr(match, "FEW_SETS", 0)
    assert sorted(map(str, rewrite.rewrite_files(files, ["old"], rules, "Text").collect())) == sorted(map(str, few))


def test_no_usage_carries_all_tags_of_its_file(spark, files_of):
    used = extract.usages(files_of(TEXTS), ["old"], "Text", spans=True)
    generates = [line for line in shown(used).split("\n") if "Generate explode" in line]
    assert generates and all("scan#" not in line.split("), [", 1)[-1] for line in generates)
