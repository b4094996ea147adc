"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with white space as single spaces.
An item of n characters may stand in a text with up to ``rate * n`` edits
(rounded down: the budget).  It is cut into budget + 1 pieces; of those, at least
one stands unchanged wherever the item stands within its budget.  All pieces are
searched at once (Aho-Corasick), and around each hit Myers' bit-parallel
algorithm finds the least distance of the whole item to a part of the text.  The
result is exact: every pair within the budget is found, none beyond.

The items are a query set run against all rows.  They go to the executors in
blocks of about ``BLOCK_CHARS`` characters, by a hash of the item: one narrow pass
over the texts for each block, so what is broadcast is bounded however many items
there are.

Defined cases: null items and items without a word are in no text; an item too
short for a budget of one must stand there exactly, between white space or text
ends; null and empty texts contain nothing; repeated items are each reported.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 0.08
BLOCK_CHARS = 2_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def letter_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, letter in enumerate(pattern):
        masks[letter] |= 1 << i
    return dict(masks)


def least_distance(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to any part of the text, and where the first such part ends (Myers 1999)."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    more, fewer, score = full, 0, size  # vertical steps of +1 and -1 in the current column
    best, end = size, 0
    for j, letter in enumerate(text, 1):
        x = masks.get(letter, 0) | fewer
        diagonal = (((x & more) + more) ^ more) | x
        right_more = fewer | ~(diagonal | more) & full
        right_fewer = diagonal & more
        if right_more & top:
            score += 1
        elif right_fewer & top:
            score -= 1
            if score < best:
                best, end = score, j
        shifted = right_more << 1 & full
        more = (right_fewer << 1 | ~(diagonal | shifted)) & full
        fewer = shifted & diagonal
    return best, end


class ItemSearch:
    """All items of a block, ready to be found in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.items: list[tuple[int, str, int]] = []
        self.masks: dict[int, dict[str, int]] = {}
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            budget = int(rate * len(text))
            for k in range(budget + 1):
                start, stop = k * len(text) // (budget + 1), (k + 1) * len(text) // (budget + 1)
                pieces[text[start:stop]].append((len(self.items), start))
            self.items.append((item_id, text, budget))
        self.machine = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.machine.add_word(piece, (len(piece), places))
        if pieces:
            self.machine.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, least distance, end of that part in the normal form) of every item in the text."""
        text = normal(text)
        if not text or not self.items:
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, places) in self.machine.iter(text):
            for item, offset in places:
                starts[item].add(end + 1 - size - offset)
        found = []
        for item, at in sorted(starts.items()):
            item_id, pattern, budget = self.items[item]
            if budget:
                best = self._verify(item, pattern, budget, text, sorted(at))
            else:
                ends = [s + len(pattern) for s in sorted(at) if text[s - 1 : s].strip() == "" and text[s + len(pattern) : s + len(pattern) + 1].strip() == ""]
                best = (0, ends[0]) if ends else None
            if best is not None:
                found.append((item_id, *best))
        return found

    def _verify(self, item: int, pattern: str, budget: int, text: str, starts: list[int]) -> tuple[int, int] | None:
        exact = text.find(pattern)
        if exact >= 0:
            return 0, exact + len(pattern)
        if item not in self.masks:
            self.masks[item] = letter_masks(pattern)
        windows: list[list[int]] = []
        for start in starts:  # hits of one place share a window
            low, high = max(0, start - budget), start + len(pattern) + 2 * budget
            if windows and low <= windows[-1][1] - len(pattern):
                windows[-1][1] = high
            else:
                windows.append([low, high])
        best = None
        for low, high in windows:
            distance, end = least_distance(self.masks[item], len(pattern), text[low:high])
            if distance <= budget and (best is None or distance < best[0]):
                best = (distance, low + end)
        return best


_SEARCHES: dict[str, ItemSearch] = {}


def _block(docs: DataFrame, items: list[tuple[int, str]], rate: float) -> Column:
    sent, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    @F.pandas_udf("array<struct<item_id: bigint, distance: bigint, end: bigint>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        search = _SEARCHES.get(name)
        if search is None:
            _SEARCHES.clear()
            search = _SEARCHES[name] = ItemSearch(sent.value, rate)
        for texts in batches:
            yield pd.Series([[{"item_id": i, "distance": d, "end": e} for i, d, e in search.matches(t)] for t in texts], dtype=object)

    return found("text")


def with_matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """All columns of ``docs`` with ``matches``: the benchmark items (item_id, text) in each text, their distance and end."""
    items = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    columns = []
    for k in range(blocks):
        block = sorted((tuple(r) for r in items.filter(number == k).collect()), key=lambda r: (r[0] is None, r))  # about block_chars characters
        columns.append(_block(docs, block, rate))
    names = [c for c in docs.columns if c != "matches"]
    return docs.select(*names, (F.concat(*columns) if len(columns) > 1 else columns[0]).alias("matches"))


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance: a row for each document and item it contains, once for rows that share a doc_id."""
    found = with_matches(docs.select("doc_id", "text"), benchmark, rate, block_chars)
    each = found.select("doc_id", F.explode("matches").alias("m"))
    return each.groupBy("doc_id", F.col("m.item_id").alias("item_id")).agg(F.min("m.distance").alias("distance"))


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with their own columns."""
    marked = with_matches(docs.withColumnRenamed("matches", "_own_matches"), benchmark, rate, block_chars)
    return marked.filter(F.size("matches") == 0).drop("matches").withColumnRenamed("_own_matches", "matches").select(*docs.columns)
