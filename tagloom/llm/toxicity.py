"""Toxicity scores by non-negative positive-unlabelled learning.

Positives are documents labelled toxic, everything else is unlabelled text; the
negative labels serve only to estimate the class prior.  The model is linear in
the presence of hashed character 5-grams.  Which 5-grams it may use follows from
their document counts among all positives and all unlabelled rows outside the
held-out part, counted in one pass over whole texts; weights minimise, by full-batch Adam in numpy, the risk

    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))

whose second term is kept from going below zero by stepping back along its
gradient when it does.  The fit takes at most ``POSITIVES`` + ``UNLABELLED``
texts, chosen by a hash of doc_id, and the ``MAX_FEATURES`` 5-grams that set
positives apart best; scoring is one narrow pass over whole texts.

Defined cases: null and empty texts have no 5-gram and get the score of the
intercept; null labels are unlabelled; without any positive every score is 0;
a doc_id labelled more than once is positive if any label says so; repeated rows
count as often as they stand and get equal scores; a row without a doc_id is
unlabelled text; an own column ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.ngrams import buckets, code_points
from tagloom.llm.shared import slices, stored

POSITIVES = 3_000
UNLABELLED = 9_000
MAX_FEATURES = 4_096
BITS = 18
SIZE = 5
#: Toxic doc_ids that are broadcast, at most; more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether crc32 of doc_id as text leaves this remainder; a null doc_id counts as the empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % parts == part


@dataclass(frozen=True)
class ToxicModel:
    features: np.ndarray  # bucket -> 0 for none, else number of the feature
    weights: np.ndarray  # weights[0] is 0
    bias: float

    def score(self, text: str | None) -> float:
        found = self.features[buckets(code_points(text or ""), SIZE, BITS)]
        found = found[found > 0]
        if len(found) > 1:
            found = np.unique(found)
        return float(1 / (1 + np.exp(-np.clip(self.weights[found].sum() + self.bias, -30, 30))))


@dataclass(frozen=True)
class TrainingRows:
    texts: DataFrame  # text, positive: what the fit reads
    prior: float  # share of toxic labels
    positives: np.ndarray  # for each bucket the positive rows that have it; last their number
    unlabelled: np.ndarray  # the same of all rows


def _toxic_ids(labels: DataFrame, most: int = BROADCAST_IDS) -> tuple[DataFrame, float]:
    """doc_id of the toxic labels outside the held-out part, broadcast if there are at most ``most``, and their share of the labels."""
    known = labels.filter(F.col("toxic").isNotNull() & ~held_out("doc_id", 5, 0))
    counted = known.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("p")).first()
    ids = known.filter("toxic = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    return F.broadcast(ids) if counted["p"] <= most else ids, counted["p"] / counted["n"] if counted["n"] else 0.0


def presence(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the number of positive rows, and of all rows, of (text, positive) that have it; last the number of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in slices(batches, 0):
            for text, positive in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.append(np.unique(buckets(code_points(text or ""), SIZE, BITS)), 1 << BITS)
                total[1, found] += 1
                if positive:
                    total[0, found] += 1
        held = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[0, held]), pa.array(total[1, held])], ["bucket", "p", "u"])

    found = rows.mapInArrow(count, "bucket bigint, p bigint, u bigint").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toPandas()
    result = np.zeros((2, (1 << BITS) + 1), np.int64)  # what reaches the driver has a row for each bucket at most
    result[:, found["bucket"].to_numpy(np.int64)] = found[["p", "u"]].to_numpy(np.int64).T
    return result[0], result[1]


def training_rows(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> TrainingRows:
    """Texts to learn from, the share of toxic labels and the counts of all rows, outside the held-out part."""
    ids, prior = _toxic_ids(labels)
    open_ = docs.filter(~held_out("doc_id", 5, 0)).select("doc_id", "text")
    marked = open_.join(ids, F.col("doc_id") == F.col("_id"), "left").select("text", F.col("_id").isNotNull().alias("positive"))
    counts = presence(marked)
    order = [F.xxhash64("_id", F.lit("toxic")), F.col("_id")]
    toxic = ids.orderBy(*order).limit(positives)
    others = open_.select(F.col("doc_id").alias("_id")).filter("_id IS NOT NULL").orderBy(*order).limit(unlabelled).distinct()
    chosen = toxic.withColumn("positive", F.lit(True)).unionByName(others.withColumn("positive", F.lit(False)))
    rows = open_.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "positive")
    return TrainingRows(stored(rows, "toxic-sample"), prior, *counts)


def _grams(rows: DataFrame) -> DataFrame:
    """The distinct buckets of each text of the sample."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            found = [np.unique(buckets(code_points(t or ""), SIZE, BITS)).astype(np.int32) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], ["grams", "positive"])

    return rows.mapInArrow(each, "grams array<int>, positive boolean")


def chosen_features(positives: np.ndarray, unlabelled: np.ndarray, most: int = MAX_FEATURES) -> list[int]:
    """Buckets that at least three positives and clearly more of them than of all rows have, the clearest first."""
    n_p, n_u = positives[-1], unlabelled[-1]
    if not n_p or not n_u:
        return []
    p, u = positives[:-1] / n_p, (unlabelled[:-1] + 1) / (n_u + 2)
    z = (p - u) / np.sqrt(u * (1 - u) / n_p)  # how many standard errors more positives have the 5-gram
    held = np.flatnonzero((positives[:-1] >= 3) & (z >= 5) & (p >= 2 * u))
    return held[np.lexsort((held, -z[held]))][:most].tolist()


def learn(given: TrainingRows, steps: int = 400) -> ToxicModel:
    none = ToxicModel(np.zeros(1 << BITS, np.int32), np.zeros(1), -30.0)
    rows, prior = given.texts, given.prior
    sizes = rows.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).first()
    if not sizes["p"] or not sizes["u"] or not prior:
        return none
    chosen = chosen_features(given.positives, given.unlabelled)
    if not chosen:
        return none
    grams = stored(_grams(rows), "toxic-grams")
    features = np.zeros(1 << BITS, np.int32)
    features[chosen] = np.arange(1, len(chosen) + 1)
    used = F.filter("grams", lambda g: F.array_contains(F.lit(sorted(chosen)), g)) if len(chosen) <= 16 else F.array_intersect("grams", F.lit(sorted(chosen)))
    table = grams.select(used.alias("grams"), "positive").toPandas()  # at most POSITIVES + UNLABELLED rows of chosen features
    lengths = table["grams"].map(len).to_numpy()
    columns = features[np.concatenate([np.asarray(g, np.int64) for g in table["grams"]])] if lengths.sum() else np.zeros(0, np.int64)
    owners = np.repeat(np.arange(len(table)), lengths)
    return _fit(columns, owners, table["positive"].to_numpy(bool), prior, features, len(chosen), steps)


def risk_slope(margin: np.ndarray, share_p: np.ndarray, share_u: np.ndarray, prior: float) -> tuple[np.ndarray, bool]:
    """The slope of the risk by each row's margin, and whether its negative part is not below zero; else the step goes back along that part."""
    sure = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
    loss_minus = np.logaddexp(0, margin)
    fine = bool(share_u @ loss_minus - prior * (share_p @ loss_minus) >= 0)
    slope_negative = share_u * sure - prior * share_p * sure
    return prior * share_p * (sure - 1) + slope_negative if fine else -slope_negative, fine


def _fit(columns, owners, positive, prior, features, width, steps) -> ToxicModel:
    """Adam on the non-negative risk with the logistic loss."""
    rows = len(positive)
    weights = np.zeros(width + 2)  # 0 unused, last the intercept
    weights[-1] = np.log(prior / (1 - prior)) if prior < 1 else 0.0
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    share_p, share_u = positive / positive.sum(), ~positive / (~positive).sum()

    def gradient(at: np.ndarray) -> np.ndarray:
        out = np.bincount(columns, at[owners], width + 2).astype(float)
        out[-1] = at.sum()
        return out

    for step in range(1, steps + 1):
        margin = np.bincount(owners, weights[columns], rows) + weights[-1]
        slope, _ = risk_slope(margin, share_p, share_u, prior)
        g = gradient(slope) + 1e-4 * np.append(weights[:-1], 0)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        weights -= 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights[0] = 0
    return ToxicModel(features, weights[:-1], float(weights[-1]))


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """All columns of ``docs`` with ``score``, the chance that label 1 applies (replaced if it exists)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers, whatever the data

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = sent.value
        for texts in batches:
            yield pd.Series([held.score(t) for t in texts], dtype="float64")

    return docs.withColumn("score", scored("text"))
