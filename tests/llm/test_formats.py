"""WARC archives and preference pairs."""

import base64
import gzip
import hashlib
import io
import json
import random

import pytest

from tagloom.llm import chat_format, warc
from tagloom.llm.shared import file_system, shared_folder


@pytest.fixture(scope="module")
def page_rows():
    rng = random.Random(6)
    body = "<p>" + "".join(rng.choice("abc \r\n\r\n") for _ in range(3000)) + "</p>"
    rows = [(i, f"http://x/{i}", f"<html>{i}{rng.random()}</html>") for i in range(20)]
    rows += [(30, "http://x/a b\nc", body), (31, None, body), (29, "http://x/29", body), (32, "http://x/e", ""), (33, "http://x/n", None), (None, "http://x/null", body), (34, "http://x/ü", "ü" * 50_000), (5, rows[5][1], rows[5][2])]
    return rows


@pytest.fixture(scope="module")
def pages(spark, page_rows):
    return spark.createDataFrame(page_rows, "page_id bigint, url string, html string").repartition(3)


def expected(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        of = first.get(html or "")
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, *(("response", None) if of is None or of == i else ("revisit", of))))
    return sorted(out, key=str)


def test_archives_come_back_whole(pages, page_rows):
    assert sorted((tuple(r) for r in warc.archive_pages(pages).collect()), key=str) == expected(page_rows)


def test_no_pages(pages):
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_members_index_and_restart(spark, pages, page_rows):
    folder = shared_folder(spark, "warc-test")
    manifest = warc.write_archives(pages, folder).collect()
    assert sum(r["records"] for r in manifest) == len(page_rows)
    for r in manifest:
        files, path = file_system(r["archive"])
        with files.open_input_stream(path, compression=None) as stream:
            whole = stream.read()
        target = f"{folder}/records/{path.rsplit('/', 1)[1]}"
        runs = warc.normalise_file(r["archive"], target)
        assert warc.normalise_file("file:///nowhere", target) == runs  # finished work is found, the source is not needed
        files, path = file_system(target)
        with files.open_input_stream(path, compression=None) as stream:
            packed = stream.read()
        with files.open_input_stream(f"{path}.idx", compression=None) as stream:
            entries = [json.loads(x) for x in stream.read().splitlines()]
        assert gzip.decompress(packed) == gzip.decompress(whole)
        assert len(entries) == r["records"] and entries[-1]["offset"] + entries[-1]["length"] == len(packed)
        for e in entries:
            member = gzip.decompress(packed[e["offset"] : e["offset"] + e["length"]])
            assert member.startswith(b"WARC/1.1\r\n") and member.count(b"WARC-Record-ID") == 1 and e["id"].encode() in member


def test_members_may_already_be_apart():
    one = warc.record(1, "http://x", b"abc", hashlib.sha1(b"abc").digest(), None)
    stream = io.BytesIO(gzip.compress(one) + gzip.compress(one[:7]) + gzip.compress(one[7:]))
    assert b"".join(warc.inflated(stream)) == one + one
    with pytest.raises(ValueError):
        list(warc.inflated(io.BytesIO(gzip.compress(one)[:-9])))


TURNS = "pair_id bigint, turn bigint, role string, text string, prompt string"


def plain_pair(chosen, rejected):
    clean = lambda rows: sorted({(t if t is not None else -1, r or "", x or "") for t, r, x in rows})
    a, b = clean(chosen), clean(rejected)
    k = 0
    while k < min(len(a), len(b)) and a[k][1:] == b[k][1:]:
        k += 1
    show = lambda rows: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for _, r, x in rows)
    return k, show(a[:k]), show(a[k:]), show(b[k:]), a[k:], b[k:]


def test_preferences(spark):
    rng = random.Random(7)
    sides = {}
    for pair in range(25):
        base = [(t, "user" if t % 2 == 0 else "assistant", f"text {rng.randrange(9)} ü😀") for t in range(rng.randint(0, 6))]
        other = base[: rng.randint(0, len(base))] + [(10 + t, rng.choice(["assistant", "user", None]), rng.choice([None, "", "other"])) for t in range(rng.randint(0, 3))]
        sides[pair] = (base, other)
    frames = []
    for side in (0, 1):
        rows = [(p, *turn, "own") for p, s in sides.items() for turn in s[side]]
        frames.append(spark.createDataFrame([*rows, *rows[:3], (None, 1, "user", "x", "own")], TURNS))
    got = {r["pair_id"]: r for r in chat_format.format_preferences(*frames).collect()}
    assert set(got) == {p for p, s in sides.items() if s[0] and s[1]}
    for p, r in got.items():
        k, prompt, chosen, rejected, a, b = plain_pair(*sides[p])
        assert (r["prompt_turns"], r["prompt"], r["chosen"], r["rejected"]) == (k, prompt, chosen, rejected)
        for text, mask, turns in ((chosen, r["chosen_mask"], a), (rejected, r["rejected_mask"], b)):
            assert [text[s["start"] : s["end"]] for s in mask] == [f"{x}<|im_end|>\n" for _, role, x in turns if role == "assistant"]


def test_donated_pairs(spark):
    """A donor is the next talk with an answer, also behind a gap or a talk without one; the first is next to the last."""
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "thanks"), (70, 0, "user", "r"), (70, 1, "assistant", "b"), (3, 0, "user", "only"), (None, 0, "user", "x")]
    schema = "conv_id bigint, turn bigint, role string, text string"
    found = chat_format.format_preferences(*chat_format.donated_pairs(spark.createDataFrame(rows, schema))).orderBy("pair_id").collect()
    assert [(r["pair_id"], r["prompt_turns"]) for r in found] == [(1, 1), (70, 1)]
    assert found[0]["rejected"].startswith("<|im_start|>assistant\nb<|im_end|>")
    assert found[1]["rejected"].startswith("<|im_start|>assistant\na<|im_end|>")
    alone = chat_format.format_preferences(*chat_format.donated_pairs(spark.createDataFrame(rows[:3], schema))).collect()
    assert [(r["prompt_turns"], r["rejected"]) for r in alone] == [(2, "")]
    assert chat_format.donated_pairs(spark.createDataFrame([], schema))[1].count() == 0
