"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes the documents its predecessor kept, is written as Parquet and
read again.  All stages but the last return the columns of ``documents``; the
last adds n_tokens, domain, chances and rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import decontaminate, line_dedup, mixing, quality_rules, simhash_dedup
from tagloom.llm.shared import shared_folder, table

#: Differing bits of the five-word fingerprints of near copies.
NEAR_BITS = 4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    rules = quality_rules.learn(quality_rules.labelled_sample(docs, table(spark, sf_dir, "labels")))
    return quality_rules.keep(docs, rules)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in the largest document; n_chars follows the text."""
    cleaned = line_dedup.dedup_lines(docs)
    lengths = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return cleaned.withColumns(lengths).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose SimHash fingerprints link the smallest doc_id stays."""
    return simhash_dedup.keep_one(docs, budget=NEAR_BITS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_rates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its rate."""
    return mixing.mix_documents(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_rates),
]

#: SQL has no form for what the stages learn and search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
