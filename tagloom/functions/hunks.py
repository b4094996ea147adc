"""Line comparison of two texts (runs inside tasks)."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd

COLUMNS = ["file_path", "hunk", "header", "line_no", "op", "line"]


MANY_LINES = 5000


def opcodes(before: list[str], after: list[str]) -> list[tuple[str, int, int, int, int]]:
    """Edit steps between two lists of lines.

    Lines both ends share are set aside first.  In what is left, beyond a few
    thousand lines, very frequent lines do not anchor a match: the steps stay
    right, only not always the fewest, and the time stays bearable.
    """
    shorter = min(len(before), len(after))
    head = next((i for i in range(shorter) if before[i] != after[i]), shorter)
    rest = shorter - head
    tail = next((i for i in range(rest) if before[-1 - i] != after[-1 - i]), rest)
    old, new = before[head : len(before) - tail], after[head : len(after) - tail]
    inner = SequenceMatcher(None, old, new, autojunk=max(len(old), len(new)) > MANY_LINES).get_opcodes()
    steps = [(t, i1 + head, i2 + head, j1 + head, j2 + head) for t, i1, i2, j1, j2 in inner]
    ends = [("equal", 0, head, 0, head)] if head else []
    last = [("equal", len(before) - tail, len(before), len(after) - tail, len(after))] if tail else []
    return ends + steps + last


def grouped(steps: list[tuple[str, int, int, int, int]], context: int) -> list[list[tuple[str, int, int, int, int]]]:
    """Edit steps cut into hunks with ``context`` equal lines around each."""
    groups: list[list] = [[]]
    for tag, i1, i2, j1, j2 in steps:
        if tag != "equal":
            groups[-1].append((tag, i1, i2, j1, j2))
            continue
        after = min(context, i2 - i1) if groups[-1] else 0
        if groups[-1] and i2 - i1 <= 2 * context:
            groups[-1].append((tag, i1, i2, j1, j2))
            continue
        if groups[-1]:
            groups[-1].append((tag, i1, i1 + after, j1, j1 + after))
            groups.append([])
        lead = min(context, i2 - i1)
        groups[-1].append((tag, i2 - lead, i2, j2 - lead, j2))
    whole = [g for g in groups if any(step[0] != "equal" for step in g)]
    if whole and whole[-1][-1][0] == "equal":  # the last hunk ends ``context`` lines after its last change
        tag, i1, i2, j1, j2 = whole[-1][-1]
        keep = min(context, i2 - i1)
        whole[-1][-1] = (tag, i1, i1 + keep, j1, j1 + keep)
    return whole


def diff_rows(path: str, old: str, new: str, context: int) -> pd.DataFrame:
    """Hunk lines of one file; ``op`` is '+', '-' or ' '."""
    return pd.DataFrame(hunk_lines(path, old, new, context), columns=COLUMNS)


def hunk_lines(path: str | None, old: str, new: str, context: int) -> list[tuple[str | None, int, str, int, str, str]]:
    """The rows of :func:`diff_rows` as tuples."""
    before, after = old.split("\n"), new.split("\n")
    rows = []
    for number, group in enumerate(grouped(opcodes(before, after), context), 1):
        old_start, old_end = group[0][1], group[-1][2]
        new_start, new_end = group[0][3], group[-1][4]
        header = f"@@ -{old_start + 1},{old_end - old_start} +{new_start + 1},{new_end - new_start} @@"
        lines = []
        for tag, i1, i2, j1, j2 in group:
            if tag == "equal":
                lines += [(" ", line) for line in before[i1:i2]]
            else:
                lines += [("-", line) for line in before[i1:i2]]
                lines += [("+", line) for line in after[j1:j2]]
        rows += [(path, number, header, n, op, line) for n, (op, line) in enumerate(lines, 1)]
    return rows
