"""Collocations, conversation repair and passage dedup against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tagloom.llm import collocations, conversation_repair, edit_lattice, substring_dedup
from tagloom.llm.suffix_automaton import NOBODY, SuffixAutomaton

# ---- passages ----


@pytest.mark.parametrize("seed", range(5))
def test_automaton_knows_first_holders(seed):
    rng = random.Random(seed)
    texts = [[rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(30)]
    automaton = SuffixAutomaton()
    for holder, text in enumerate(texts[:20]):
        automaton.add(text, 100 - holder)
    automaton.settle()
    for text in texts:
        want = [min((100 - h for h, t in enumerate(texts[:20]) if any(t[j : j + 4] == text[i : i + 4] for j in range(len(t) - 3))), default=NOBODY) for i in range(len(text) - 3)]
        assert automaton.first_holders(text, 4) == want


def plain_passages(rows, span):
    """(n_words, n_removed, kept words) of every row."""
    first = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - span + 1):
            if doc is not None:
                window = tuple(words[i : i + span])
                first[window] = min(doc, first.get(window, doc))
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - span + 1):
            holder = first.get(tuple(words[i : i + span]))
            if holder is not None and (doc is None or holder < doc):
                gone.update(range(i, i + span))
        out.append((doc, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(map(str, out))


def with_passages(rows, span):
    """The rows and more that share passages of about a window's length, repeat words, and go across each other."""
    rng = random.Random(4)
    passages = [" ".join(f"w{rng.randrange(40)}" for _ in range(span + k)) for k in (-1, 0, 1, 9, 30)] + ["la " * 200]
    more = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(f"v{rng.randrange(9)}" for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 6))]
        more.append((1000 - i if i % 9 else None, " \n".join(parts)))
    return [*rows, *more, *more[:3]]


@pytest.mark.parametrize("span, room, shard", [(13, 20_000, 10_000), (13, 3, 20), (3, 20_000, 50)])
def test_passages_of_smaller_documents_go(spark, odd_rows, span, room, shard):
    rows = with_passages(odd_rows, span)
    docs = spark.createDataFrame([(*r, "own", "own") for r in rows], "doc_id bigint, text string, part string, own string").repartition(3)
    got = substring_dedup.dedup_passages(docs, span, room, shard)
    assert got.columns == ["doc_id", "text", "part", "own", "kept_text", "n_words", "n_removed"]
    found = got.collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_text)) for r in found) == plain_passages(rows, span)
    assert {(r.part, r.own) for r in found} == {("own", "own")} and sorted(map(str, ((r.doc_id, r.text) for r in found))) == sorted(map(str, rows))


def test_passages_of_no_documents(spark, no_docs):
    assert substring_dedup.dedup_passages(no_docs).count() == 0
    texts = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id bigint, text string")
    assert {(r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup_passages(texts).collect()} == {(0, 0, "")}


# ---- collocations ----


def plain_collocations(rows, least, top):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", text or ""):
            words = [w for w in re.split(r"[ \t]+", "".join(c.lower() if c.isascii() else c for c in piece)) if w]
            for size in (1, 2, 3):
                counts["und" if lang is None else lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        total, own = sum(n for p, n in f.items() if len(p) == 1), []
        for phrase, a in f.items():
            if len(phrase) == 1 or a < least:
                continue
            cuts = [(1_000_000 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            if len(phrase) == 2 and any(len(p) == 3 and n >= least and phrase in (p[:2], p[1:]) and 100 * n >= 50 * a for p, n in f.items()):
                continue
            own.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, total, -s) for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("budget", [2_000_000, 40, 5])
def test_collocations(spark, odd_rows, budget):
    """Small budgets extend prefixes to two and three words and spread them over groups."""
    rng = random.Random(8)
    words = [w + "é" * (i % 2) for i, w in enumerate("the of And IN a big old red dog cat".split())]
    texts = [(rng.choice(["en", "fr", None]), " ".join(rng.choice(words[: rng.randint(2, 10)]) + rng.choice(["", "", "", "", ",", ".\n", "\t"]) for _ in range(rng.randint(0, 60)))) for _ in range(80)]
    texts += [("en", t) for _, t in odd_rows] + [("zz", "only once here"), (None, None), ("", "a a a a a a a a a a a a a")]
    docs = spark.createDataFrame([(*t, 1, "own", 2) for t in texts], "lang string, text string, n bigint, phrase string, rank int").repartition(3)
    got = collocations.collocations(docs, 4, 30, budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_collocations(texts, 4, 30)


def test_collocations_of_no_documents(no_docs):
    assert collocations.collocations(no_docs).count() == 0


# ---- conversations ----


def plain_edits(initials, faults):
    """Cost and least audit by one pass from the end."""
    never = (10**9, "")
    after = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]

    def inserted(best):
        for _ in range(4):
            best = [min(best[q], *[(best[n][0] + 2, "I" + best[n][1]) for r, n in after[q].items() if r != "s"]) for q in range(4)]
        return best

    best = inserted([(0, ""), never, never, (0, "")])
    for initial, fault in list(zip(initials, faults))[::-1]:
        now = []
        for q in range(4):
            ways = [(best[q][0] + 3, "D" + best[q][1])]
            if fault not in (1, 2):
                more = int(fault == 3)
                ways += [(best[n][0] + more, "K" + best[n][1]) for r, n in after[q].items() if r == initial]
                ways += [(best[n][0] + 2 + more, "R" + best[n][1]) for r, n in after[q].items() if r != "s"]
            now.append(min(ways))
        best = inserted(now)
    return best[0]


@pytest.mark.parametrize("seed", range(4))
def test_cheapest_edits(seed):
    rng = random.Random(seed)
    for _ in range(400):
        initials = "".join(rng.choice("suaax u"[: rng.randint(3, 7)]) for _ in range(rng.randint(0, 12)))
        faults = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in initials]
        assert edit_lattice.cheapest(initials, faults) == plain_edits(initials, faults)


def plain_report(talks):
    by, out = defaultdict(list), {}
    for conv, turn, role, text in talks:
        by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    order = lambda row: (row[0] is not None, row[0] or 0, row[1], row[2])
    for conv, given in by.items():
        rows = []
        for turn, role, text in given:
            harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            rows += [(turn, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
        rows.sort(key=order)
        faults, seen = [], set()
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in rows]
        cost, audit = plain_edits(initials, faults)
        state, lines, at = 0, [], 0
        for letter in audit:
            role, text = rows[at][1:] if letter != "I" else ("", "")
            at += letter != "I"
            if letter == "D":
                continue
            initial = role[:1] if letter == "K" else "a" if state == 2 else "u"
            state = {"s": 1, "u": 2, "a": 3}[initial]
            lines.append(f"{role if letter == 'K' else {'u': 'user', 'a': 'assistant'}[initial]}:{text}")
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (gaps, *[faults.count(k) for k in (1, 2, 3)], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_conversations_are_repaired(spark, block):
    rng = random.Random(block)
    talks = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 9 if conv != 7 else 40)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            talks.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), role, rng.choice([f"Text {turn} é.", "Same?", "cut off", "", " \n", None])))
    talks += talks[:4]
    table = spark.createDataFrame([(*t, "own", 9) for t in talks], "conv_id bigint, turn int, role string, text string, key string, pos bigint").repartition(3)
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repair_report(table, conversation_repair.damaged(table), block).collect()}
    assert got == plain_report(talks)
    rows = defaultdict(list)
    for r in conversation_repair.repair(conversation_repair.damaged(table), block).orderBy("key", "turn").collect():
        rows[int(r.key[1:]) if r.key else None].append(f"{r.role}:{r.text}")
    assert all(hashlib.sha256("\n".join(rows[conv]).encode()).hexdigest() == want[-1] for conv, want in got.items())
    assert all(re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines)) for lines in rows.values())


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversation_repair.repair_report(none, none).count() == 0
    one = spark.createDataFrame([(5, 0, "user", "x")], none.schema)
    assert [tuple(r) for r in conversation_repair.repair_report(one, none).collect()] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
