"""Language, toxicity and mixing: held-out accuracy and targets met."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import language_id, mixing, toxicity


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    kinds = {"aa": "abcdeee", "bb": "efghaaa", "cc": "eäöüabc"}
    rows = []
    for i in range(400):
        lang = rng.choice(list(kinds))
        text = words(rng, kinds[lang], rng.randint(5, 60))
        toxic = i % 5 == 0
        if toxic:
            text += " horrid nasty " + words(rng, kinds[lang], 4)
        rows.append((i, text, lang, "s", len(text), int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, toxic int")


def test_language_of_held_out_texts(texts, odd_docs, no_docs):
    apart = toxicity.held_out("doc_id", 4, 2)
    model = language_id.learn(texts.filter(~apart), rows=150)
    assert model.languages == ["aa", "bb", "cc"] and 0.05 <= model.temperature <= 20
    assert (model.table == 0).mean() > 0.5  # the penalties leave few weights
    got = language_id.predict(texts.filter(apart), model).collect()
    assert got and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    odd = language_id.predict(odd_docs, model)
    assert odd.columns == [*[c for c in odd_docs.columns if c != "score"], "lang_pred", "score"]
    for r in odd.collect():
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or "")))
    assert language_id.predict(no_docs, model).count() == 0


def test_language_without_labels(texts, no_docs):
    model = language_id.learn(no_docs)
    assert {(r["lang_pred"], r["score"]) for r in language_id.predict(texts, model).collect()} == {("und", 0.0)}
    unknown = texts.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.learn(unknown).languages == []


def test_document_frequencies_count_all_documents(texts):
    counts = language_id.document_frequencies(texts)
    want = np.zeros_like(counts)
    for r in texts.collect():
        want[np.unique(language_id.grams(r["text"]))] += 1
        want[-1] += 1
    assert (counts == want).all()


def test_toxicity_of_held_out_texts(spark, texts, odd_docs):
    labels = texts.filter("doc_id % 3 <> 1").select("doc_id", "toxic", F.lit(1).alias("quality"))
    model = toxicity.learn(toxicity.training_rows(texts, labels))
    got = toxicity.score(texts, model).filter(toxicity.held_out("doc_id", 5, 0)).collect()
    assert got and np.mean([(r["score"] >= 0.5) == r["toxic"] for r in got]) > 0.95
    odd = toxicity.score(odd_docs, model).collect()
    empty = {r["score"] for r in odd if not (r["text"] or "").strip()}
    assert len(empty) == 1 and all(0 <= r["score"] <= 1 for r in odd)


def test_held_out_labels_are_not_read(spark, texts):
    labels = texts.select("doc_id", "toxic", F.lit(1).alias("quality"))
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id", 5, 0), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = (toxicity.learn(toxicity.training_rows(texts, x)) for x in (labels, flipped))
    assert np.allclose(one.weights, other.weights) and one.bias == other.bias


def test_five_grams_of_all_rows_are_counted(texts, odd_docs):
    """Counts of every text, whatever the size of the fitting sample, equal a plain count."""
    labels = texts.select("doc_id", "toxic", F.lit(1).alias("quality"))
    given = toxicity.training_rows(texts, labels, positives=2, unlabelled=3)
    apart = {r["doc_id"] for r in texts.filter(toxicity.held_out("doc_id", 5, 0)).collect()}
    positives, everything = np.zeros((1 << toxicity.BITS) + 1), np.zeros((1 << toxicity.BITS) + 1)
    for r in texts.collect():
        if r["doc_id"] not in apart:
            found = [*np.unique(toxicity.buckets(toxicity.code_points(r["text"]), toxicity.SIZE, toxicity.BITS)), -1]
            everything[found] += 1
            positives[found] += r["toxic"]
    assert (given.positives == positives).all() and (given.unlabelled == everything).all()
    assert given.texts.count() <= 5
    assert toxicity.presence(odd_docs.select("text", F.lit(False).alias("positive")))[1][-1] == odd_docs.count()


def test_a_rare_toxic_word_outside_the_sample_is_chosen(spark):
    """Seven texts in 600 hold the word; the fit may read one of them."""
    rng = random.Random(9)
    rows = [(i, words(rng, "abcdeee", 20) + (" zyxwvut" if i in (7, 8, 11, 13, 17, 19, 23) else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.select("doc_id", F.col("text").contains("zyxwvut").cast("int").alias("toxic"))
    given = toxicity.training_rows(docs, labels, positives=1, unlabelled=20)
    chosen = set(toxicity.chosen_features(given.positives, given.unlabelled))
    assert chosen >= set(toxicity.buckets(np.frombuffer("zyxwvut".encode("utf-32-le"), np.uint32), toxicity.SIZE, toxicity.BITS).tolist())


def test_slope_of_the_risk_is_its_numeric_gradient():
    """The slope that a step follows against differences of the risk itself."""
    rng = np.random.default_rng(4)
    positive = np.array([True] * 4 + [False] * 6)
    grid = rng.integers(0, 2, (10, 3))
    owners, columns = np.nonzero(grid)
    share_p, share_u, prior = positive / 4, ~positive / 6, 0.3

    def risk(w):
        margin = grid @ w[:3] + w[3]
        negative = share_u @ np.logaddexp(0, margin) - prior * (share_p @ np.logaddexp(0, margin))
        return prior * (share_p @ np.logaddexp(0, -margin)) + negative if negative >= 0 else -negative

    for scale in (0.3, 4.0):
        for _ in range(5):
            w = rng.normal(0, scale, 4)
            margin = grid @ w[:3] + w[3]
            slope, _ = toxicity.risk_slope(margin, share_p, share_u, prior)
            got = np.append(np.bincount(columns, slope[owners], 3), slope.sum())
            want = [(risk(w + d) - risk(w - d)) / 2e-5 for d in np.eye(4) * 1e-5]
            assert np.allclose(got, want, atol=1e-6)


def test_toxicity_without_positives(spark, texts, no_docs):
    labels = texts.select("doc_id", F.lit(0).alias("toxic"), F.lit(1).alias("quality"))
    model = toxicity.learn(toxicity.training_rows(texts, labels))
    assert toxicity.score(texts, model).filter("score > 0.01").count() == 0
    empty = labels.limit(0)
    assert toxicity.score(no_docs, toxicity.learn(toxicity.training_rows(no_docs, empty))).count() == 0


def test_held_out_is_crc32_of_the_text(spark):
    import zlib

    rows = spark.range(50).withColumn("h", toxicity.held_out("id", 5, 0)).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_mixing_meets_its_targets(texts, odd_docs, no_docs):
    domains = texts.select("doc_id", F.col("lang").alias("domain"))
    model = mixing.learn(mixing.labelled_rows(texts, domains, 200))
    targets = {"aa": 0.6, "bb": 0.3, "cc": 0.1}
    mixed = mixing.mix(texts, model, targets)
    rows = mixed.collect()
    sums = np.sum([np.array(r["chances"]) * r["rate"] * r["n_tokens"] for r in rows], axis=0)
    total = sum(r["n_tokens"] for r in rows)
    assert np.allclose(sums / total, [0.6, 0.3, 0.1], atol=0.005)
    assert all(r["rate"] >= 0 and abs(sum(r["chances"]) - 1) < 1e-9 for r in rows)
    assert all(r["n_tokens"] == len(r["text"].split()) for r in rows)
    assert np.mean([r["domain"] == r["lang"] for r in rows]) > 0.9
    odd = mixing.mix(odd_docs, model, targets)
    assert odd.count() == odd_docs.count() and odd.columns == [*[c for c in odd_docs.columns if c not in ("rate", "domain")], "n_tokens", "domain", "chances", "rate"]
    assert mixing.mix(no_docs, model, targets).count() == 0
    assert {r["rate"] for r in mixing.mix(odd_docs, mixing.DomainModel([], np.zeros((2, 0))), {}).collect()} == {1.0}


def test_steps_equal_plain_projected_gradient(spark):
    rng = np.random.default_rng(0)
    units = rng.multinomial(mixing.GRAIN, [0.5, 0.3, 0.2], 30)
    tokens = rng.integers(1, 50, 30)
    cells = spark.createDataFrame([(u.tolist(), int(t)) for u, t in zip(units, tokens, strict=True)], "units array<int>, tokens bigint")
    history = mixing.fit_rates(cells, np.array([0.45, 0.3, 0.25]), steps=25, tolerance=0)
    p, rate = units / mixing.GRAIN, np.ones(30)
    present = tokens @ p
    for _ in range(25):
        rate = np.maximum(0, rate - p @ (((rate * tokens) @ p - np.array([0.45, 0.3, 0.25]) * tokens.sum()) / present))
    assert len(history) == 25 and np.allclose(mixing.rates(units, history), rate)
