from tagloom.operators import extract, match
from tagloom.sources.rules import rules_from_document


def test_extraction_and_matching_run_on_a_stream(spark, files_of, tmp_path):
    files = files_of({"f": 'import { Text } from "p";\n<Text a="1"/><Text/>'})
    files.write.parquet(str(tmp_path / "in"))
    rules = rules_from_document(spark, {"p": {"Text": [{"match": [{"a": "1"}]}, {"match": [{}]}]}})
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    matched = match.match_rules(extract.usages(stream, ["p"], "Text"), rules, compiled=True).select("pos", "rule.rule_pos")
    query = (
        matched.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(0, 0), (1, 1)]
