import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tagloom.operators import match
from tagloom.operators import rules as r
from tagloom.sources.rules import parse_rules, read_rule_lines, read_rules, rule_documents, rules_from_document, write_rules


def used_table(spark, sets):
    rows = [(f"f{i}", "p", "C", s) for i, s in enumerate(sets)]
    return spark.createDataFrame(rows, "file_path string, package string, component string, props map<string,string>")


def plans(spark, rules, sets, mode="first_match"):
    """Rule position per file, by all three plans."""
    used = used_table(spark, sets)
    inline = match.match_rules(used, rules, mode, compiled=True).select("file_path", "rule.rule_pos")
    anchored = match.match_by_anchor(used, rules, mode).select("file_path", "rule.rule_pos")
    divided = match.match_by_division(used, rules, mode)
    text = F.to_json(F.map_from_entries(F.sort_array(F.map_entries("props"))))
    by_props = divided.select(text.alias("t"), "rule_pos")
    divided = used.select("file_path", text.alias("t")).join(by_props, "t").select("file_path", "rule_pos")
    return [dict(map(tuple, d.collect())) for d in (inline, anchored, divided)]


CASES = [
    ([{"onClick": True}], {"onClick": "go"}, True),
    ([{"bold": "true"}], {"bold": "false"}, False),
    ([{"bold": "true"}], {"bold": "true"}, True),
    ([{"bold": False}], {"bold": "false"}, True),
    ([{"!tag": True}], {"tag": "a"}, False),
    ([{"!tag": True}], {"size": "s"}, True),
    ([{"!tag": "a"}], {"tag": "b"}, True),
    ([{"!tag": "a", "!size": True}], {"size": "s"}, False),
    ([{}], {}, True),
    ([], {"a": "b"}, True),
    ([{"a": "1", "b": "2"}], {"a": "1"}, False),
    ([{"a": "1", "b": "2"}, {"c": True}], {"c": "x", "id": "i"}, True),
    ([{"id": "i"}], {"id": "i", "z": "1"}, True),
    ([{"a": "1"}, {"!b": True}], {"a": "1", "b": "2"}, False),
    ([{"a": "1"}, {"!b": True}], {"b": "2"}, False),
    ([{"a": "1"}, {"!b": True}], {"a": "1"}, True),
    ([{"!a": True}, {"!b": "2"}], {"b": "3"}, True),
    ([{"!a": True}, {"!b": "2"}], {"b": "2"}, False),
    ([{"!a": True}, {"!b": "2"}], {"a": "", "b": "3"}, False),
    ([{}, {"!b": True}], {"a": "1"}, True),
    ([{}, {"!b": True}], {"b": "1"}, False),
    ([{"n": 5}], {"n": "5"}, True),
    ([{"n": 5}], {"n": "5.0"}, False),
    ([{"n": None}], {"n": "null"}, True),
    ([{"bold": True}], {"bold": "false"}, True),
    ([{"bold": False}], {"bold": "true"}, False),
    ([{"bold": False}], {}, False),
    ([{"a": "1"}, {"a": "2"}, {"a": "3"}], {"a": "3"}, True),
    ([{"a": "1"}, {"a": "2"}, {"a": "3"}], {"a": "4"}, False),
    ([{"a": "x,y=z"}], {"a": "x,y=z"}, True),
    ([{"!a": "x"}], {}, True),
]


def test_truth_table(spark):
    document = {"p": {f"C{i}": [{"order": 1, "match": c}] for i, (c, _, _) in enumerate(CASES)}}
    rules = rules_from_document(spark, document)
    rows = [(f"f{i}", "p", f"C{i}", p) for i, (_, p, _) in enumerate(CASES)]
    used = spark.createDataFrame(rows, "file_path string, package string, component string, props map<string,string>")
    want = {f"f{i}" for i, c in enumerate(CASES) if c[2]}
    for compiled in (True, False):
        assert {x.file_path for x in match.match_rules(used, rules, compiled=compiled).collect()} == want


@pytest.mark.parametrize("mode", ["first_match", "most_specific"])
@pytest.mark.parametrize("seed", [7, 8, 9])
def test_three_plans_agree(spark, mode, seed):
    rnd = random.Random(seed)
    keys, values = "abcd", ["1", "2", "true"]

    def clause():
        names = rnd.sample(keys, rnd.randint(0, 3))
        mark = "!" if rnd.random() < 0.3 else ""
        return {mark + k: True if rnd.random() < 0.4 else rnd.choice(values) for k in names}

    listed = [{"order": 0, "match": [clause() for _ in range(rnd.randint(0, 3))]} for _ in range(12)]
    listed = [x for x in listed if x["match"] and {} not in x["match"]] + [{"order": 9, "match": [{"a": "1"}, {}, {"!d": True}]}]
    sets = [{k: rnd.choice(values) for k in keys if rnd.random() < 0.5} for _ in range(60)]
    rules = rules_from_document(spark, {"p": {"C": listed}})
    compiled, anchored, divided = plans(spark, rules, sets, mode)
    assert compiled == anchored == divided and compiled


def test_documents_of_one_component_follow_each_other(spark, tmp_path):
    for name, value in (("b.json", "2"), ("a.json", "1")):
        (tmp_path / name).write_text(json.dumps({"p": {"C": [{"match": [{"a": value}]}, {"match": [{"a": True}], "order": int(value)}]}}))
    rules = read_rules(spark, str(tmp_path))
    assert sorted((x.rule_pos, x.rule_order) for x in rules.collect()) == [(0, 0), (1, 1), (2, 0), (3, 2)]
    used = used_table(spark, [{"a": "1"}, {"a": "2"}])
    for compiled in (True, False):
        rows = match.match_rules(used, rules, compiled=compiled).collect()
        assert sorted((x.file_path, x.rule.rule_pos) for x in rows) == [("f0", 0), ("f1", 1)]


def test_unmatched_are_kept_on_request(spark):
    rules = rules_from_document(spark, {"p": {"C": [{"order": 1, "match": [{"a": "1"}]}]}})
    used = used_table(spark, [{"a": "1"}, {"a": "2"}])
    for compiled in (True, False):
        rows = match.match_rules(used, rules, keep_unmatched=True, compiled=compiled).collect()
        assert sorted((x.file_path, x.rule is None) for x in rows) == [("f0", False), ("f1", True)]


def test_mixed_clause_is_rejected(spark):
    with pytest.raises(PySparkException, match="mixes plain and negated"):
        rules_from_document(spark, {"p": {"C": [{"match": [{"a": "1", "!b": True}]}]}}).collect()


def test_mapping_invariants(spark):
    cases = r.scenarios(spark)
    clauses = r.variant_clauses(cases, r.variant_table(spark))
    assert (cases.count(), clauses.count(), clauses.select("variant").distinct().count()) == (41, 30, 15)
    rules = r.variant_rules(clauses, ["p", "q"], "Text", ["type"], 1, "new")
    assert rules.count() == 30 and rules.filter("package = 'p'").agg(F.sum(F.size("any_of"))).first()[0] == 30
    assert sorted(x.rule_order for x in rules.collect()) == list(range(1, 31))
    # the order of the document decides: large headings fall to the first rule that names "large"
    used = spark.createDataFrame([("f", "p", "Text", {"type": "heading", "size": "large"})],
                                 "file_path string, package string, component string, props map<string,string>")
    assert match.match_rules(used, rules).collect()[0].rule.set[0].value == "headingSmall"
    special = match.match_rules(used, r.mapping_rules(clauses, ["p"], "Text"))
    assert special.collect()[0].rule.set[0].value == "headingLarge"


def test_rules_survive_writing(spark, tmp_path):
    document = {
        "p": {
            "C": [
                {"order": 3, "match": [{"a": True, "b": "x\"y"}, {"!c": "1"}], "set": {"v": "t", "w": True, "n": 5},
                 "remove": ["a"], "rename": {"b": "d", "e": "f"}, "importFrom": "p", "importTo": "q", "newCompName": "N",
                 "files": ["f1"], "replaceWith": {"code": "<C {...OUTER_PROPS}>{CHILDREN}</C>", "INNER_PROPS": ["h"]}},
                {"order": 4, "match": [{}]},
            ]
        }
    }
    rules = rules_from_document(spark, document)
    want = sorted(map(str, rules.collect()))
    again = read_rule_lines(spark, write_rules(rules, str(tmp_path), "C", "N"))
    assert sorted(map(str, again.collect())) == want
    assert sorted(map(str, parse_rules(rule_documents(rules)).collect())) == want


def test_rebinding_and_order(spark):
    rules = rules_from_document(spark, {"p": {"C": [{"order": 1, "match": [{}], "importFrom": "p"}, {"order": 2, "match": [{"a": "1", "b": "2"}]}]}})
    bound = r.bind_to_packages(rules, ["x", "y"]).collect()
    assert sorted((b.package, b.rule_pos, b.import_from) for b in bound) == [
        ("x", 0, "x"), ("x", 1, None), ("y", 0, "y"), ("y", 1, None)]
    assert {x.rule_order: x.rule_pos for x in r.by_specificity(rules).collect()} == {2: 0, 1: 1}
    both = r.append_rules(rules, rules)
    assert sorted(x.rule_pos for x in both.collect()) == [0, 1, 2, 3]


def test_many_rules_that_only_exclude(spark):
    """The least missing number gives what testing each rule gives, and no set meets a rule it does not violate."""
    rnd = random.Random(3)
    keys, values = "abcdef", ["1", "2", "3"]
    excluded = [{f"!{k}": True if rnd.random() < 0.2 else rnd.choice(values) for k in rnd.sample(keys, rnd.randint(1, 3))} for _ in range(50)]
    rules = rules_from_document(spark, {"p": {"C": [{"order": i, "match": [c]} for i, c in enumerate(excluded)]}})
    sets = [{k: rnd.choice(values) for k in keys if rnd.random() < 0.8} for _ in range(150)] + [{}, {k: "9" for k in keys}]

    def violates(clause, props):
        return any(k[1:] in props and (v is True or props[k[1:]] == v) for k, v in clause.items())

    want = {f"f{i}": next((n for n, c in enumerate(excluded) if not violates(c, s)), None) for i, s in enumerate(sets)}
    assert len(set(want.values())) > 5
    used = used_table(spark, sets)
    rows = match.match_by_anchor(used, rules, keep_unmatched=True).select("file_path", "rule.rule_pos").collect()
    assert dict(map(tuple, rows)) == want
    anchored = match._set_anchors(match.numbered_sets(match.distinct_prop_sets(used)))
    index = match.excluded_terms(match._clauses(rules, "first_match"))
    met = anchored.join(index, match._TERM_KEYS).select("full_key", "rule_pos").distinct().collect()
    assert met and all(violates(excluded[r.rule_pos], {e.key: e.value for e in r.full_key}) for r in met)


def test_a_hot_set_is_dealt_over_tasks(spark):
    sets = [{"a": "hot"}] * 4000 + [{"a": str(i % 800), "b": "x"} for i in range(8000)]
    rules = rules_from_document(spark, {"p": {"C": [{"order": 1, "match": [{"a": "hot"}]}, {"order": 2, "match": [{"b": True}]}]}})
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = match.match_by_anchor(used_table(spark, sets), rules)
        assert rows.groupBy("rule.rule_pos").count().orderBy("rule_pos").collect() == [(0, 4000), (1, 8000)]
        sizes = sorted(n for _, n in rows.groupBy(F.spark_partition_id()).count().collect())
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
