"""Quality rules, line dedup, SimHash, token counts and decontamination against plain versions."""

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tagloom.llm import decontaminate, line_dedup, quality_rules, similar_sets, simhash_dedup, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_base_counts(odd_docs, odd_rows):
    got = quality_rules.judge(odd_docs, quality_rules.DecisionList()).select("doc_id", "text", "_stats", "base_failed", "kept").collect()
    assert len(got) == len(odd_rows)
    for r in got:
        counts = base_counts(r["text"])
        assert tuple(r["_stats"][name] for name in quality_rules.BASE) == counts
        assert r["base_failed"] == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert r["kept"] == (not r["base_failed"])


def labelled(spark, n, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 9))) for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            words = [w + "$$$" for w in words]
        rows.append((i, " ".join(words), bad))
    return spark.createDataFrame(rows, "doc_id bigint, text string, reject boolean")


def test_rules_are_learned_and_native(spark):
    rows = labelled(spark, 240)
    rules = quality_rules.learn(rows)
    assert rules.rules and all(len(rule) <= 3 for rule in rules.rules)
    judged = quality_rules.judge(rows, rules)
    assert judged.filter(F.col("kept") == F.col("reject")).count() == 0
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_own_columns_named_like_the_verdict(spark, odd_docs):
    own = ["kept", "rule", "base_failed", "_stats", "_words", "_own_0", "n_words"]
    docs = odd_docs.withColumns({c: F.lit(f"own {c}") for c in own})
    rules = quality_rules.DecisionList()
    judged = quality_rules.judge(docs, rules)
    assert judged.columns == [*[c for c in docs.columns if c not in quality_rules.VERDICT], *quality_rules.VERDICT]
    kept = quality_rules.keep(docs, rules)
    assert kept.columns == docs.columns and kept.count() == judged.filter("kept").count() > 0
    assert kept.filter(" OR ".join(f"`{c}` <> 'own {c}'" for c in own)).count() == 0


def test_rules_without_labels(spark, no_docs):
    assert quality_rules.learn(labelled(spark, 240).limit(0)).rules == []
    assert quality_rules.learn(labelled(spark, 240).filter("NOT reject")).rules == []
    assert quality_rules.judge(no_docs, quality_rules.DecisionList()).count() == 0
    sample = quality_rules.labelled_sample(labelled(spark, 50), spark.createDataFrame([(1, 0), (1, 0), (2, None), (None, 1), (999, 1)], "doc_id bigint, quality int"))
    assert sorted(tuple(r) for r in sample.select("doc_id", "reject").collect()) == [(1, True), (1, True)]


def cleaned(rows, min_docs=3):
    strip, holders = " \t\n\x0b\x0c\r", defaultdict(set)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(strip))
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    gone = {k: max(x for x in ids if x is not None) for k, ids in holders.items() if len(ids - {None}) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def as_cleaned(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str)


def test_lines_are_dropped(odd_docs, odd_rows, no_docs):
    got = line_dedup.dedup_lines(odd_docs, shards=3)
    assert as_cleaned(got) == cleaned(odd_rows)
    assert any(r[3] for r in cleaned(odd_rows))
    assert got.columns == [*odd_docs.columns, "n_lines", "n_dropped"]
    assert line_dedup.dedup_lines(no_docs, shards=3).count() == 0


def state(index):
    refs = sorted((bytes(r["key"]), r["doc"] is None, r["doc"] or 0) for r in index.refs().collect())
    repeated = sorted((bytes(r["key"]), r["n_docs"], r["last"]) for r in index.repeated().collect())
    return refs, repeated


def test_insertions_and_deletions_can_be_undone(spark, odd_docs, odd_rows):
    first, second = odd_docs.filter("doc_id < 12"), odd_docs.filter("doc_id >= 12")
    rows = [r for r in odd_rows if r[0] is not None]
    known = first.unionByName(second)
    index = line_dedup.LineIndex(spark, shards=3)
    index.insert(first)
    before = state(index)
    index.insert(second)
    assert as_cleaned(index.clean(known)) == cleaned(rows)
    index.insert(second)  # again: nothing counts twice
    assert as_cleaned(index.clean(known)) == cleaned(rows)
    index.delete(second.select("doc_id"))
    assert state(index) == before
    assert as_cleaned(index.clean(first)) == cleaned([r for r in rows if r[0] < 12])
    # the filters hold exactly the repeated keys: all of them are affirmed, deleted ones are not kept
    assert index.probe(index.refs()).select("key").distinct().count() >= index.repeated().count()
    index.insert(second)
    assert as_cleaned(index.clean(known)) == cleaned(rows)


def test_rounds_of_insertions_and_deletions_equal_a_fresh_index(spark, monkeypatch):
    """Documents come and go at random, filters grow from two keys each; the state is that of the documents left."""
    monkeypatch.setattr(line_dedup, "KEYS_A_SHARD", 2)
    rng = random.Random(21)
    pool = [f"a line of the common pool, number {i}" for i in range(90)]
    texts = {i: "\n".join(rng.sample(pool, rng.randint(1, 12))) for i in range(60)}
    index, inside = line_dedup.LineIndex(spark), set()
    schema = "doc_id bigint, text string"
    for turn in range(5):
        chosen = rng.sample(sorted(texts), 25)
        come, go = [i for i in chosen if i not in inside], [i for i in chosen if i in inside]
        if come:
            index.insert(spark.createDataFrame([(i, texts[i]) for i in come], schema).coalesce(1))
        if go:
            index.delete(spark.createDataFrame([(i,) for i in go], "doc_id bigint").coalesce(1))
        inside = (inside | set(come)) - set(go)
        if turn == 3:
            index.compact()
            assert not index.gone_steps and len(index.ref_steps) == 1
        if turn in (1, 3, 4):
            rows = [(i, texts[i]) for i in sorted(inside)]
            assert as_cleaned(index.clean(spark.createDataFrame(rows, schema))) == cleaned(rows)
            held = {bytes(r["key"]) for r in index.repeated().collect()}
            assert {bytes(r["key"]) for r in index.probe(index.refs()).select("key").distinct().collect()} >= held
    assert index.shards > line_dedup.LEAST_SHARDS


def test_rows_without_an_id_are_told_apart(spark):
    line = "a line that three documents share"
    rows = [(1, line), (2, line), (3, line), (None, f"{line}\nmine"), (None, "yours alone, nobody else's line"), (None, f"{line}\nmine")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert as_cleaned(got) == cleaned(rows)
    assert line_dedup.LineIndex(spark).refs().count() == 0


def plain_fingerprint(text, n=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, budget=3):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= budget and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    names = {}
    for (i, _), x in zip(prints, label, strict=True):
        if i is not None:
            names[x] = min(names.get(x, i), i)
    return sorted(((i, f, names.get(x)) for (i, f), x in zip(prints, label, strict=True)), key=str)


@pytest.mark.parametrize("room", [2, 4096])
def test_near_duplicates(odd_docs, odd_rows, room):
    got = simhash_dedup.near_duplicates(odd_docs, room=room).collect()
    assert sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got), key=str) == plain_components(odd_rows)


def test_chains_of_near_duplicates(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(60):  # each changes one more word of the one before
        words = list(words)
        words[rng.randrange(400)] = f"n{i}"
        rows.append((1000 - i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = simhash_dedup.near_duplicates(docs, room=4).collect()
    assert sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got), key=str) == plain_components(rows)


def test_one_copy_stays(odd_docs, no_docs):
    kept = sorted(r["doc_id"] for r in simhash_dedup.keep_one(odd_docs).select("doc_id").collect() if r["doc_id"] is not None)
    assert 5 in kept and 6 not in kept and 8 not in kept and 0 in kept and 1 not in kept
    assert simhash_dedup.keep_one(no_docs).count() == 0
    assert simhash_dedup.near_duplicates(no_docs).count() == 0


def plain_kept(rows, n, budget):
    """Documents that are the smallest of those their fingerprints reach within the budget."""
    prints = [(i, simhash_dedup.fingerprint(t, n)) for i, t in rows if i is not None]
    reach = {}
    for i, fp in prints:
        group, todo = {fp}, [fp]
        while todo:
            at = todo.pop()
            near = {f for _, f in prints if f not in group and (f ^ at).bit_count() <= budget}
            group |= near
            todo += near
        reach[i] = min(j for j, f in prints if f in group)
    return {i for i, least in reach.items() if i == least}


def test_pipeline_keeps_one_by_fingerprints(spark, odd_rows, monkeypatch):
    import corpus_pipeline

    rng = random.Random(5)
    rows = [r for r in odd_rows if r[0] is not None]
    for _ in range(8):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        for _ in range(6):
            words = list(base)
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(400)] = f"n{rng.randrange(10**6)}"
            rows.append((500 + len(rows), " ".join(words)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = plain_kept(rows, 5, corpus_pipeline.NEAR_BITS)
    assert len(want) < len({i for i, _ in rows})
    monkeypatch.setattr(simhash_dedup, "similar_documents", lambda *_: pytest.fail("not by fingerprints"))
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == want


def plain_similar(rows, n=5):
    """Smallest doc_id of each document's group, by the similarity of all pairs."""
    sets, label = [], list(range(len(rows)))
    for _, t in rows:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))})
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and label[a] != label[b]:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    names = {}
    for (i, _), x in zip(rows, label, strict=True):
        names[x] = min(names.get(x, i), i)
    return sorted((i, names[x]) for (i, _), x in zip(rows, label, strict=True))


def test_near_copies_are_found_by_similarity(spark, odd_rows):
    rng = random.Random(12)
    common = [f"c{i}" for i in range(30)]
    rows = [r for r in odd_rows if r[0] is not None]
    for family in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(6, 300))]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            if family % 3 == 0:
                words += common
            rows.append((200 + len(rows), " ".join(words)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = plain_similar(rows)
    assert 20 < len({name for _, name in want}) < len(rows) - 60
    for sample in (100, 4_000_000):
        got = similar_sets.similar_documents(docs, sample=sample).collect()
        assert sorted((r["doc_id"], r["component_id"]) for r in got) == want
    kept = {r["doc_id"] for r in simhash_dedup.keep_one(docs).select("doc_id").collect()}
    assert kept == {i for i, name in want if i == name}


def test_token_counts_equal_the_library(spark, odd_docs, odd_rows):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = token_counts.count_tokens(odd_docs, path)
    assert got.columns == [*odd_docs.columns, "n_bytes", "n_tokens", "over_limit"]
    want = sorted((str(t), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 512) for _, t in odd_rows)
    assert sorted((str(r["text"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect()) == want
    with open(path, encoding="utf-8") as file:
        counter = token_counts.BpeCounter(json.load(file))
    rng = random.Random(4)
    letters = [*"abcdet  \n\t\r\x1c\x85'sSßéü漢😀12³!?.,", "<|endoftext|>", "'ll", " the", "  ", "ing"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert [counter.count(t) for t in texts] == [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(8)
    for _ in range(400):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + (pattern[rng.randint(0, len(pattern)) :] if rng.random() < 0.5 else "")
        distance, end = decontaminate.least_distance(decontaminate.letter_masks(pattern), len(pattern), text)
        assert distance == plain_distance(pattern, text)
        assert plain_distance(pattern, text[:end]) == distance


def test_items_within_their_budget(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(10, 40)))) for i in range(12)]
    items += [(50, "Tiny"), (51, None), (52, "  "), (3, items[3][1])]
    rows = [(0, None), (1, ""), (2, "a tiny part"), (3, "tinysaur"), (4, "TINY")]
    for i in range(60):
        text = items[i % 12][1]
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", "z", "zz"]) + text[at + rng.randint(0, 1) :]
        rows.append((10 + i, f"{word()} {text.upper() if i % 7 == 0 else text} {word()}"))
    docs = spark.createDataFrame([*rows, rows[-1]], "doc_id bigint, text string")
    table = spark.createDataFrame(items, "item_id bigint, text string")
    want = set()
    for i, t in rows:
        for item, text in items:
            norm, whole = decontaminate.normal(text), decontaminate.normal(t)
            if norm and whole:
                budget = int(decontaminate.RATE * len(norm))
                d = plain_distance(norm, whole)
                if (d <= budget) if budget else f" {norm} " in f" {whole} ":
                    want.add((i, item, d))
    for block in (2_000_000, 400):
        got = decontaminate.contaminated(docs, table, block_chars=block).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert len({w[2] for w in want}) > 2


def test_clean_documents_stay(spark, odd_docs, no_docs):
    table = spark.createDataFrame([(1, odd_docs.filter("doc_id = 5").first()["text"])], "item_id bigint, text string")
    kept = decontaminate.clean(odd_docs, table)
    assert kept.columns == odd_docs.columns and {r["matches"] for r in kept.collect()} == {"own"}
    assert {r["doc_id"] for r in odd_docs.collect()} - {r["doc_id"] for r in kept.collect()} == {5, 6, 7, 8, 100}
    assert decontaminate.clean(no_docs, table).count() == 0
    assert decontaminate.clean(odd_docs, table.limit(0)).count() == odd_docs.count()


def test_digest_is_of_the_stripped_lower_case_line():
    want = hashlib.blake2b("abcdefghij Äklmnopqrst".encode(), digest_size=16).digest()
    assert line_dedup.line_digest(" \tABCDEFGHIJ ÄKLMNOPQRST\r\x0b", 20) == want
    assert line_dedup.line_digest("a" * 19, 20) is None
