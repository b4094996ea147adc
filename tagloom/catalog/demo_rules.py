"""The rule table the queries run with: hand-written rules around mapped ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.catalog.bindings import NEW_PACKAGE, PACKAGES, TARGET
from tagloom.operators import rules as r
from tagloom.sources.rules import rules_from_rows

_MOVE = {"importFrom": "-", "importTo": NEW_PACKAGE}

CARD_TEMPLATE = """
<Card {...OUTER_PROPS}>
    <Card.Link kind="jump" {...INNER_PROPS}>{CHILDREN}</Card.Link>
</Card>
"""

BEFORE_MAPPED = [
    {
        "order": 210,
        "match": [{"href": True, "bold": True}],
        "remove": ["bold", "color", "size"],
        "set": {"tone": "quiet"},
        "replaceWith": {"INNER_PROPS": ["n", "href"], "code": CARD_TEMPLATE},
        **_MOVE,
    },
    {
        "order": 220,
        "match": [{"href": "url"}],
        "remove": ["tag"],
        "rename": {"href": "goto"},
        "set": {"plain": True, "tone": "loud"},
        **_MOVE,
    },
    {
        "order": 230,
        "match": [{"className": "x", "type": "mono"}, {"className": True, "type": "label"}],
        "remove": ["className"],
        "set": {"box": "tight"},
        **_MOVE,
    },
    {
        "order": 240,
        "match": [{"!type": True, "!onClick": True, "!color": "CallExpression"}],
        "set": {"level": "base"},
        **_MOVE,
    },
    {"order": 250, "match": [{"color": "theme.primary"}], "set": {}, "remove": []},
]
AFTER_MAPPED = [{"order": 880, "match": [{}], "remove": ["nowhere"], **_MOVE}]
MAPPED_FROM = 300

_built: dict[str, tuple] = {}


def demo_rules(spark: SparkSession) -> DataFrame:
    """15 mapped rules for the first package; 5 + 15 + 1 for the second.

    Built once per application and kept as a local table: a rule table is
    configuration, not data.
    """
    app = spark.sparkContext.applicationId
    if app not in _built:
        table = build_rules(spark)
        _built[app] = (table.collect(), table.schema)
    return spark.createDataFrame(*_built[app])


def build_rules(spark: SparkSession) -> DataFrame:
    clauses = r.variant_clauses(r.scenarios(spark), r.variant_table(spark))
    mapped = r.variant_rules(clauses, PACKAGES, TARGET, ["type", "size"], MAPPED_FROM, NEW_PACKAGE)
    mapped = spark.createDataFrame(mapped.collect(), mapped.schema)
    first, second = (mapped.filter(mapped.package == package) for package in PACKAGES)
    before = rules_from_rows(spark, PACKAGES[1:], TARGET, BEFORE_MAPPED)
    after = rules_from_rows(spark, PACKAGES[1:], TARGET, AFTER_MAPPED)
    return first.unionByName(r.append_rules(r.append_rules(before, second), after))
