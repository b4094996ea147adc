import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, doc bigint, fp string, matches string, rate string, score string, shard string, domain string"


def sentence(rng, words):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """doc_id, text: nulls, empty and long texts, copies, near copies, shared lines, repeated rows."""
    rng = random.Random(11)
    shared, common = sentence(rng, 9), "  The Same LINE in every document \t"
    base = sentence(rng, 120)
    near = base.replace(base.split()[60], "Changed", 1)
    long = "\n".join(sentence(rng, 12) for _ in range(400))
    texts = [None, "", " \n\t", "one", "two words", base, base, near, base.upper(), long, f"{common}\n{shared}\n{sentence(rng, 30)}"]
    texts += [f"{sentence(rng, 25)}\n{common}\nshort\n\n{shared}" for _ in range(4)] + [f"{common}\n{common.lower()}\nshort"]
    texts += ["über Straße ÄÖÜ " * 6, "<|endoftext|> it's 12,345 $$$ ### !!\r\n\x0b\x0c", "x" * 5000, (shared + "\n") * 12]
    rows = list(enumerate(texts))
    return [*rows, rows[5], rows[12], (None, base), (None, None), (100, base[:-1] + "~")]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    rows = [(i, t, "en", "s", len(t or ""), *["own"] * 1, 7, *["own"] * 6) for i, t in odd_rows]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
