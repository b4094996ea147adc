import random
from difflib import SequenceMatcher

from tagloom.functions.hunks import diff_rows, grouped, opcodes


def patched(before, rows):
    """The new text, rebuilt from the old one and the hunks."""
    out, at = [], 0
    for _, hunk in rows.groupby("hunk"):
        start = int(hunk.header.iloc[0].split("-")[1].split(",")[0]) - 1
        out += before[at:start]
        at = start + int((hunk.op != "+").sum())
        out += list(hunk.line[hunk.op != "-"])
    return out + before[at:]


def test_hunks_turn_the_old_text_into_the_new():
    rnd = random.Random(3)
    for _ in range(300):
        old = [rnd.choice("abc") for _ in range(rnd.randint(1, 30))]
        new = [x for x in old if rnd.random() > 0.2]
        for _ in range(rnd.randint(0, 4)):
            new.insert(rnd.randint(0, len(new)), rnd.choice("abcd"))
        new = new or ["z"]
        rows = diff_rows("f", "\n".join(old), "\n".join(new), 2)
        assert patched(old, rows) == new
        assert (len(rows) == 0) == (old == new)


def test_same_hunks_as_difflib():
    old = [f"line {i}" for i in range(100)]
    new = old[:10] + ["x"] + old[11:40] + old[43:95] + ["y", "z"] + old[95:]
    want = list(SequenceMatcher(None, old, new, autojunk=False).get_grouped_opcodes(2))
    assert grouped(opcodes(old, new), 2) == want


def test_large_text_with_one_frequent_line():
    old = ["same"] * 200_000
    new = ["first", *old[:100_000], "middle", *old[100_000:]]
    rows = diff_rows("f", "\n".join(old), "\n".join(new), 2)
    assert patched(old, rows) == new
