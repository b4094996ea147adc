"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams.  A text's term frequencies are shares of all
its n-grams, so its logits are means of rows of a weight table, and scoring is a
gather.  Inverse document frequencies come from every training document.  The
weights are fitted by follow-the-regularised-leader (proximal, per coordinate)
with elastic-net penalties, which leaves most of them exactly zero, on at most
``SAMPLE_ROWS`` training texts shared out evenly over the languages; a fifth of
these is kept back to fit one temperature for the probabilities.

Defined cases: ``und`` with score 0 for null, for texts without a letter, and
when nothing could be learned; rows without a language teach nothing; equal
probabilities are settled by the language's name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.ngrams import buckets, code_points
from tagloom.llm.shared import slices, stored

BITS = 15
ORDERS = (1, 2, 3)
SAMPLE_ROWS = 6_000
SCALE = 50.0


def grams(text: str) -> np.ndarray:
    codes = code_points(text)
    return np.concatenate([buckets(codes, n, BITS) for n in ORDERS])


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket x language: scaled idf times weight
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        found = grams(text)
        return self.table[found].mean(axis=0, dtype=np.float64) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        chances = softmax(self.logits(text) / self.temperature)
        best = int(chances.argmax())
        return self.languages[best], float(chances[best])


def softmax(logits: np.ndarray) -> np.ndarray:
    grown = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return grown / grown.sum(axis=-1, keepdims=True)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Number of documents that have each bucket; the last entry is the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) + 1, np.int64)
        seen = np.zeros(1 << BITS, bool)
        for batch in slices(batches, 0):
            for text in batch.column(0).to_pylist():
                seen[:] = False
                seen[grams(text or "")] = True
                total[:-1] += seen
                total[-1] += 1
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], ["bucket", "n"])

    counts = docs.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    result = np.zeros((1 << BITS) + 1, np.int64)  # what reaches the driver has a row for each bucket at most
    result[counts["bucket"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return result


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> pd.DataFrame:
    """lang, gram buckets and their counts of at most ``rows`` labelled texts, the same number of each language where there are enough."""
    order = [F.xxhash64("doc_id", F.lit("lang")), F.col("doc_id")]
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL")
    names = known.groupBy("lang").agg(F.count("*").alias("n"))
    named = names.orderBy(F.desc("n"), "lang").limit(rows).select("lang").collect()
    each = max(1, rows // max(1, len(named)))
    chosen = None
    for r in sorted(x["lang"] for x in named):
        part = known.filter(F.col("lang") == r).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).orderBy(F.xxhash64("_id", F.lit("lang")), "_id").limit(each)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return pd.DataFrame({"lang": [], "held": [], "bucket": [], "n": []})
    rows_of = known.join(F.broadcast(chosen.distinct()), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")))
    kept_back = F.pmod(order[0], F.lit(5)) == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            held, n = [], []
            for text in batch.column(2).to_pylist():
                found, times = np.unique(grams(text), return_counts=True)
                held.append(found.astype(np.int32))
                n.append(times.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], ["lang", "held", "bucket", "n"])

    counted = rows_of.select("lang", kept_back.alias("held"), "text").mapInArrow(count, "lang string, held boolean, bucket array<int>, n array<int>")
    return stored(counted, "language-sample").toPandas()


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, epochs: int = 2, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> LanguageModel:
    """A model from the rows of ``docs`` (doc_id, text, lang) that have a text and a language."""
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sample = training_sample(known, rows)
    names = sorted(set(sample["lang"]))
    if not names:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    frequencies = document_frequencies(known)
    idf = np.log((1 + frequencies[-1]) / (1 + frequencies[:-1])) + 1
    number = {name: k for k, name in enumerate(names)}
    examples = []
    for lang, held, found, n in sample.itertuples(index=False):
        found = np.asarray(found, np.int64)
        times = np.asarray(n, np.float64)
        examples.append((number[lang], bool(held), np.append(found, 1 << BITS), np.append(SCALE * idf[found] * times / times.sum(), 1.0)))
    width = (1 << BITS) + 1  # the last coordinate is the intercept
    z, squares = np.zeros((width, len(names))), np.zeros((width, len(names)))

    def weights(rows_: np.ndarray | slice) -> np.ndarray:
        zs = z[rows_]
        return -np.sign(zs) * np.maximum(np.abs(zs) - l1, 0) / ((beta + np.sqrt(squares[rows_])) / alpha + l2)

    order = np.random.default_rng(7)
    train = [e for e in examples if not e[1]] or examples
    for _ in range(epochs):
        for k in order.permutation(len(train)):
            truth, _, found, values = train[k]
            w = weights(found)
            error = softmax(values @ w)
            error[truth] -= 1
            g = values[:, None] * error[None, :]
            new = squares[found] + g * g
            z[found] += g - (np.sqrt(new) - np.sqrt(squares[found])) / alpha * w
            squares[found] = new
    final = weights(slice(None))
    kept = [e for e in examples if e[1]] or examples
    logits = np.array([values @ final[found] for _, _, found, values in kept])
    table = (SCALE * idf[:, None] * final[:-1]).astype(np.float32)
    return LanguageModel(names, table, final[-1], _temperature(logits, np.array([e[0] for e in kept])))


def _temperature(logits: np.ndarray, truth: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm.

    The wanted chances are smoothed by one row in n + 2, so texts that are all
    told apart do not ask for endless certainty.
    """
    wanted = np.full(logits.shape, 1 / (len(truth) + 2) / max(1, logits.shape[1] - 1))
    wanted[np.arange(len(truth)), truth] = 1 - 1 / (len(truth) + 2)

    def loss(log_t: float) -> float:
        chances = softmax(logits / np.exp(log_t))
        return -(wanted * np.log(np.maximum(chances, 1e-12))).sum(axis=1).mean()

    low, high, golden = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    while high - low > 1e-3:
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (replaced if they exist); one narrow pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the data

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = sent.value
        for texts in batches:
            yield pd.DataFrame([held.predict(t) for t in texts], columns=["lang_pred", "score"])

    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*names, predicted("text").alias("_language")).select(*names, "_language.lang_pred", "_language.score")
