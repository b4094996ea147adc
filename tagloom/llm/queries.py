"""One query for each operator, over the whole standard tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import chat_format, collocations, conversation_repair, decontaminate, language_id, line_dedup, mixing, quality_rules, simhash_dedup, substring_dedup, token_counts, toxicity, warc
from tagloom.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op10_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that three or more documents share stay in the largest document only."""
    cleaned = line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Base counts and verdict of each document, by a decision list learned from the quality labels."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rules = quality_rules.learn(quality_rules.labelled_sample(docs, table(spark, sf, "labels")))
    judged = quality_rules.judge(docs, rules)
    return judged.select("doc_id", *[F.col(f"_stats.{name}").alias(name) for name in quality_rules.BASE], "base_failed", "kept", "rule")


@query
def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of each document by the byte-level vocabulary of 50,257 tokens."""
    import public_tokenizers

    counted = token_counts.count_tokens(table(spark, sf, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op3_simhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and component of each document, fingerprints linked within three bits."""
    found = simhash_dedup.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Language of each document; one in four is never learned from."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    apart = toxicity.held_out("doc_id", 4, 2)
    model = language_id.learn(docs.filter(~apart))
    return language_id.predict(docs.select("doc_id", "text", apart.alias("held_out")), model).drop("text")


@query
def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of each document; one in five is never learned from."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.learn(toxicity.training_rows(docs, table(spark, sf, "labels")))
    scored = toxicity.score(docs.withColumn("held_out", toxicity.held_out("doc_id", 5, 0)), model).drop("text")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


@query
def op7_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Pages written as whole-stream archives, normalised, and read back by offset."""
    return warc.archive_pages(table(spark, sf, "pages").select("page_id", "url", "html"))


@query
def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the benchmark items that stand in them within the edit budget."""
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Rate of each document, so that expected tokens of the domains meet their targets."""
    mixed = mixing.mix_documents(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), table(spark, sf, "labels"))
    return mixed.select("doc_id", "source", "n_tokens", "domain", "rate")


@query
def op6_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """Preference pairs of conversations and the answers donated by their neighbours."""
    found = chat_format.format_preferences(*chat_format.donated_pairs(table(spark, sf, "conversations")))
    masks = [chat_format.mask_text(f"{side}_mask").alias(f"{side}_mask") for side in ("chosen", "rejected")]
    return found.select("pair_id", F.col("prompt_turns").cast("bigint").alias("prompt_turns"), "prompt", "chosen", "rejected", *masks)


@query
def op13_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without the words of 13-word passages that a document of smaller id holds too."""
    cleaned = substring_dedup.dedup_passages(table(spark, sf, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """The 2,000 best phrases of two and three words of each language."""
    return collocations.collocations(table(spark, sf, "documents").select("lang", "text"))


@query
def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Damaged conversations, their faults, and the cheapest edits that make them legal."""
    talks = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.repair_report(talks, conversation_repair.damaged(talks))
