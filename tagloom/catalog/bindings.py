"""The library's inputs, derived from the standard test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGES = ["@acme/ui/Text", "@acme/ui"]
TARGET = "Text"
NEW_PACKAGE = "@nova/text"
ROOT = "src"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_files(spark: SparkSession, sf_dir: str, typed: bool = False) -> DataFrame:
    """One source file per part that has line items.

    A line item becomes an element whose name and attributes come from a few
    small-domain columns.  Equal elements of a part are written once with their
    number as attribute ``n``; they are counted before anything is put
    together, so a file has at most as many elements as there are different
    ones (under 9,000), even if one part holds most line items.  Elements of
    quantities that are a multiple of seven have no type, unless ``typed``.
    """
    qty = (F.col("l_quantity").cast("bigint") % 7).alias("q")
    shape = table(spark, sf_dir, "lineitem").groupBy(
        "l_partkey", qty, F.col("l_linenumber").alias("ln"), F.col("l_returnflag").alias("rf"),
        F.col("l_linestatus").alias("ls"), (F.col("l_suppkey") % 11 == 0).alias("dotted"),
        (F.col("l_suppkey") % 5 == 0).alias("bold"), (F.col("l_suppkey") % 6).alias("extra"),
    ).agg(F.count("*").alias("n"))
    name = F.when(F.col("ln") == 7, "Box").when(F.col("dotted"), "Text.Bold").otherwise("Text")
    size = F.get(F.array(*[F.lit(s) for s in [None, "huge", "large", "medium", "small", "tiny", None]]), F.col("q").cast("int"))
    kind = F.get(F.array(*[F.lit(s) for s in [None, "body", "heading", "label", "link", "metric", "mono"]]), F.col("ln") % 7)
    kind = kind if typed else F.when(F.col("q") != 0, kind)
    none = F.lit("")
    element = F.concat(
        F.lit("    <"), name,
        F.when(F.col("extra") == 4, ' size="old"').otherwise(""),
        F.coalesce(F.concat(F.lit(' size="'), size, F.lit('"')), none),
        F.coalesce(F.concat(F.lit(' type="'), kind, F.lit('"')), none),
        F.when(F.col("rf") == "R", ' tag="a" href={url}').when(F.col("rf") == "A", ' className="x"').otherwise(""),
        F.when(F.col("ls") == "F", " onClick={() => go(1)}").otherwise(""),
        F.when(F.col("bold"), " bold").otherwise(""),
        F.when(F.col("extra") == 0, " {...rest}").when(F.col("extra") == 1, ' id=""')
        .when(F.col("extra") == 2, " color={theme.primary}").when(F.col("extra") == 3, " color={pick(theme)}").otherwise(""),
        F.lit(" n={"), F.col("n").cast("string"), F.lit("}>"), F.col("rf"), F.lit("</"), name, F.lit(">"),
    )
    bodies = shape.select("l_partkey", element.alias("el")).groupBy("l_partkey").agg(
        F.array_join(F.sort_array(F.collect_list("el")), "\n").alias("body")
    )
    size10 = F.col("p_size") % 10
    size3 = F.col("p_size") % 3
    header = (
        F.when(size10 == 9, 'import { Text as T } from "@acme/ui";\n')
        .when(size10 == 8, 'import { Text } from "@acme/ui";\nimport Text from "@acme/ui/Text";\n')
        .when(size10 == 7, 'import {\n  Text,\n  Box,\n} from "@acme/ui";\n')
        .when(size10 == 6, 'import * as UI from "@acme/kit";\nimport { Title as Text } from "@acme/ui";\n')
        .when(size3 == 0, 'import { Text, Box } from "@acme/ui";\n')
        .when(size3 == 1, 'import Text from "@acme/ui/Text";\n')
        .otherwise("")
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return part.join(bodies, F.col("p_partkey") == F.col("l_partkey")).select(
        F.concat(F.lit("src/"), F.col("p_brand"), F.lit("/"), F.col("p_type"), F.lit("/C"),
                 F.col("p_partkey").cast("string"), F.lit(".tsx")).alias("file_path"),
        F.concat(F.lit('import React from "react";\n'), header, F.lit("// <Text old />\n\nexport const View = () => (\n  <Box>\n"),
                 F.col("body"), F.lit("\n  </Box>\n);\n")).alias("code"),
    )


def tree_path(rel_path: Column) -> Column:
    """A path of two, three or five parts, by the number in the file's name."""
    number = F.regexp_extract(rel_path, r"C(\d+)\.tsx$", 1).cast("bigint")
    parts = F.split(rel_path, "/")
    deep = F.concat(F.lit("deep/x"), (number % 5).cast("string"))
    return F.when(number % 3 == 0, rel_path).when(number % 3 == 1, F.array_join(F.slice(parts, 2, 2), "/")).otherwise(
        F.concat_ws("/", F.slice(parts, 1, 2), deep, F.slice(parts, 3, 1))
    )


def nested_reports(used: DataFrame) -> DataFrame:
    """One nested usage report for each package and file: package -> directories -> file -> [usage], column ``value``."""
    usage = F.struct(F.col("component").alias("name"), F.col("file_path").alias("filePath"), "props")
    per_file = used.groupBy("package", tree_path(F.col("rel_path")).alias("path")).agg(F.to_json(F.collect_list(usage)).alias("list"))

    def inside(name: Column, value: Column) -> Column:
        return F.concat(F.lit('{"'), name, F.lit('":'), value, F.lit("}"))

    tree = F.aggregate(F.reverse(F.split("path", "/")), F.col("list"), lambda below, part: inside(part, below))
    with_imports = F.concat(F.lit('{"_imports":{"x":[]},'), F.substring(tree, 2, 1 << 30))
    return per_file.select(inside(F.col("package"), with_imports).alias("value"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages: the host is the package."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("file_path"), host.alias("package"), "html"
    )


def kit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per supplier, each with one of eight shapes that need more than a pattern to be read."""
    head = 'import { Text } from "@acme/ui";\n'
    shapes = [
        head + '<Box n="outer" icon={<Text n="inner" />} />',
        head + '<Text n="deep" a={{b: {c: {d: {e: {f: {g: {h: "}"}}}}}}}} />',
        head + "const s = '<Text n=\"no\">'; go(`<Text n=\"no\" />`); // <Text n=\"no\" />\n<Text n=\"real\" />",
        head + 'useState<Text>(1); a <Text && b; <Text<Row> n="typed" />;',
        'import A from "x"; import { Text /* c */ } from "@acme/ui";\n/* import { Text } from "@acme/xy"; */\n<Text n="after" />',
        head + '<Text n="a" x={() => <Text n="b">{ok ? `${<Text n="c" />}` : null}</Text>}>it\'s</Text>',
        head + "<p>don't {say(\"<Text n='no' />\")} it's <Text n=\"said\">{/* <Text n=\"no\" /> */}</Text></p>",
        head + '<Text n="out" bad={1} =><Text n="in" /></Text>',
    ]
    texts = F.array(*[F.lit(x) for x in shapes])
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey")
    return suppliers.select(
        F.concat(F.lit("kit/S"), F.col("s_suppkey").cast("string"), F.lit(".tsx")).alias("file_path"),
        F.get(texts, (F.col("s_suppkey") % len(shapes)).cast("int")).alias("code"),
    )
