"""Mixing to target weights with soft membership.

A softmax classifier, fitted in numpy on a bounded sample of labelled rows, gives
every document chances of belonging to each domain.  A document gets a rate (how
often it is to be used, 0 or more) such that the expected tokens of the domains,

    S_k = sum over documents of rate * tokens * chance_k,

come as near to their targets as least squares weighted by the domains' present
sizes allows, starting from rate 1.  Projected gradient steps, in the metric of
the documents' tokens, are

    rate <- max(0, rate - sum over k of chance_k * (S_k - T_k) / W_k),

a step of length one, which never overshoots because each row of the normal
matrix sums to one.  A document's rate follows from its chances alone, so chances
are rounded to 1/128, documents with equal chances are counted together once
(tokens summed in Spark), and the steps run over those cells: each step is one
Spark aggregate whose K sums go to the driver, and the list of K-vectors is the
whole model.  Rates are then one narrow pass.

Tokens are words between ASCII white space unless a column of counts is named.

Defined cases: null and empty texts have 0 tokens and chances like any other
text; a domain with no tokens can't be met and is left out; with nothing labelled
all rates are 1; targets need not sum to 1 (they are scaled to all tokens).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.ngrams import buckets, code_points
from tagloom.llm.shared import slices, stored

BITS = 11
ORDERS = (1, 2, 3)
SAMPLE_ROWS = 4_000
GRAIN = 128


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of hashed character 1- to 3-grams."""
    codes = code_points(text or "")
    counts = np.bincount(np.concatenate([buckets(codes, n, BITS) for n in ORDERS]), minlength=1 << BITS)
    return np.sqrt(counts / counts.sum())


@dataclass(frozen=True)
class DomainModel:
    domains: list[str]
    weights: np.ndarray = field(repr=False)  # features and intercept x domains

    def chances(self, texts: list[str | None]) -> np.ndarray:
        """Rounded to 1/GRAIN, summing to one."""
        logits = np.array([features(t) @ self.weights[:-1] for t in texts]).reshape(len(texts), -1) + self.weights[-1]
        grown = np.exp(logits - logits.max(axis=1, keepdims=True))
        units = GRAIN * grown / grown.sum(axis=1, keepdims=True)
        whole = np.floor(units).astype(np.int64)
        rest = np.argsort(np.argsort(-(units - whole), axis=1, kind="stable"), axis=1, kind="stable")
        return whole + (rest < (GRAIN - whole.sum(axis=1))[:, None])


def labelled_rows(docs: DataFrame, domains: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text, domain of at most ``rows`` labelled documents, chosen by a hash; ``domains`` has doc_id, domain."""
    known = domains.filter("doc_id IS NOT NULL AND domain IS NOT NULL").select(F.col("doc_id").alias("_id"), "domain")
    chosen = known.orderBy(F.xxhash64("_id", F.lit("mix")), "_id", "domain").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "domain")


def learn(rows: DataFrame, steps: int = 300, penalty: float = 1e-4) -> DomainModel:
    """Softmax regression by Adam on the whole sample, in one task: the sample is bounded, and only weights reach the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            found = [features(t).astype(np.float32).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["x", "domain"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, domains = [], []
        for batch in batches:
            parts += [np.frombuffer(x, np.float32) for x in batch.column(0).to_pylist()]
            domains += batch.column(1).to_pylist()
        if domains:
            names, weights = _fit(parts, domains, steps, penalty)
            yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string())), pa.array([weights.tobytes()], pa.binary())], ["domains", "weights"])

    sample = rows.mapInArrow(each, "x binary, domain string").repartition(1)
    found = sample.mapInArrow(fit, "domains array<string>, weights binary").collect()
    if not found:
        return DomainModel([], np.zeros(((1 << BITS) + 1, 0)))
    names = list(found[0]["domains"])
    return DomainModel(names, np.frombuffer(bytes(found[0]["weights"]), np.float32).reshape(-1, len(names)).astype(np.float64))


def _fit(parts: list[np.ndarray], domains: list[str], steps: int, penalty: float) -> tuple[list[str], np.ndarray]:
    names = sorted(set(domains))
    x = np.ones((len(parts), (1 << BITS) + 1), np.float32)
    for row, part in zip(x, parts, strict=True):
        row[:-1] = 20 * part
    truth = np.eye(len(names), dtype=np.float32)[[names.index(d) for d in domains]]
    w = np.zeros((x.shape[1], len(names)), np.float32)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        logits = x @ w
        grown = np.exp(logits - logits.max(axis=1, keepdims=True))
        g = x.T @ (grown / grown.sum(axis=1, keepdims=True) - truth) / len(x) + penalty * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w -= 0.02 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    w[:-1] *= 20
    return names, w.astype(np.float32)


def with_chances(docs: DataFrame, model: DomainModel, tokens: str | None = None) -> DataFrame:
    """All columns of ``docs`` with ``_tokens`` and ``_units`` (chances in 1/GRAIN)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("words bigint, units array<int>")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = sent.value
        for texts in batches:
            words = [len(t.encode("utf-8", "surrogatepass").split()) if t else 0 for t in texts]
            yield pd.DataFrame({"words": words, "units": list(held.chances(list(texts)).astype(np.int32))}, columns=["words", "units"])

    done = docs.withColumn("_placed", placed("text"))
    count = F.col("_placed.words") if tokens is None else F.coalesce(F.col(tokens).cast("bigint"), F.lit(0))
    return done.select(*docs.columns, count.alias("_tokens"), F.col("_placed.units").alias("_units"))


def rates(units: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """Rates after the steps so far, from chances in 1/GRAIN."""
    rate = np.ones(len(units))
    for push in history:
        rate = np.maximum(0.0, rate - units @ (push / GRAIN))
    return rate


def fit_rates(cells: DataFrame, targets: np.ndarray, steps: int = 60, tolerance: float = 1e-4) -> list[np.ndarray]:
    """The steps' K-vectors; ``cells`` has units and tokens, ``targets`` the wanted shares."""
    width = len(targets)

    def sums(history: list[np.ndarray]) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in batches:
                units = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, width)
                total += (rates(units, history) * batch.column(1).to_numpy()) @ units / GRAIN
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], ["k", "s"])

        found = cells.select("units", "tokens").mapInArrow(add, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
        result = np.zeros(width)
        for r in found:
            result[r["k"]] = r["s"]
        return result

    present = sums([])
    total, there = present.sum(), present > 0
    if not total or not targets[there].sum():
        return []
    wanted = np.where(there, targets, 0) / targets[there].sum() * total
    history: list[np.ndarray] = []
    now = present
    for _ in range(steps):
        push = np.where(there, (now - wanted) / np.where(there, present, 1), 0.0)
        history.append(push)
        before, now = now, sums(history)
        if np.abs(now - before).max() <= tolerance * total:
            break
    return history


def mix(docs: DataFrame, model: DomainModel, targets: dict[str, float], tokens: str | None = None) -> DataFrame:
    """All columns of ``docs`` with n_tokens, domain (the likeliest), chances and rate (replaced if they exist)."""
    names = [c for c in docs.columns if c not in ("n_tokens", "domain", "chances", "rate") or c == tokens]
    if not model.domains:
        plain = docs.withColumn("_w", F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("bigint"))
        return plain.select(*names, F.col("_w").alias("n_tokens"), F.lit(None).cast("string").alias("domain"), F.array().cast("array<double>").alias("chances"), F.lit(1.0).alias("rate"))
    placed = with_chances(docs.select(*names), model, tokens)
    cells = stored(placed.groupBy(F.col("_units").alias("units")).agg(F.sum("_tokens").alias("tokens")), "mixing-cells")
    history = fit_rates(cells, np.array([targets.get(d, 0.0) for d in model.domains]))
    sent = docs.sparkSession.sparkContext.broadcast(history)

    @F.pandas_udf("double")
    def rated(units: pd.Series) -> pd.Series:
        return pd.Series(rates(np.stack(units.to_list()).astype(np.float64), sent.value) if len(units) else [], dtype="float64")

    best = F.get(F.lit(model.domains), F.array_position("_units", F.array_max("_units")).cast("int") - 1)
    keep = [c for c in names if c != "n_tokens"]
    return placed.select(*keep, F.col("_tokens").alias("n_tokens"), best.alias("domain"), F.transform("_units", lambda u: u / GRAIN).alias("chances"), rated("_units").alias("rate"))


def label_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, domain of the labelled documents: ``toxic``, ``low_quality``, or else the language."""
    bad = F.when(F.col("toxic") == 1, F.lit("toxic")).when(F.col("quality") == 0, F.lit("low_quality"))
    known = labels.select(F.col("doc_id").alias("_id"), bad.alias("_bad"))
    joined = docs.select("doc_id", "lang").join(known, F.col("doc_id") == F.col("_id"))
    return joined.select("doc_id", F.coalesce("_bad", "lang").alias("domain"))


def default_targets(domains: list[str]) -> dict[str, float]:
    """Nine tenths shared evenly by the languages, 0.08 low quality, 0.02 toxic."""
    languages = [d for d in domains if d not in ("toxic", "low_quality")]
    return {"low_quality": 0.08, "toxic": 0.02} | {d: 0.9 / len(languages) for d in languages}


def mix_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The standard tables mixed to the default targets."""
    model = learn(labelled_rows(docs, label_domains(docs, labels)))
    return mix(docs, model, default_targets(model.domains))
