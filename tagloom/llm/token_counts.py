"""Token counts of a byte-level BPE vocabulary by heap-and-linked-list merging.

A text is cut at added tokens (one token each), then into pieces by the
vocabulary's pattern.  A piece starts as one symbol for each byte, linked to its
neighbours; the heap holds the adjacent pairs that have a merge, lowest rank
first, leftmost first among equals.  Every merge joins two symbols, so the count
is bytes minus merges and no token is ever built.  A piece of n bytes takes
O(n log n), however long it is.

The vocabulary file is read on the driver and broadcast: its size does not
depend on the data.  Counts of pieces are kept in each Python worker, in two
dictionaries of bounded size.

Defined cases: null counts as the empty text, 0 tokens.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level vocabularies split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_PIECES = 250_000
_BITS = 21


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class BpeCounter(dict):
    """piece -> number of tokens; computes what is missing."""

    def __init__(self, vocabulary: dict):
        super().__init__()
        model = vocabulary["model"]
        if model["type"] != "BPE" or vocabulary["pre_tokenizer"]["type"] != "ByteLevel" or vocabulary["normalizer"]:
            raise ValueError("only byte-level BPE without a normaliser")
        if vocabulary["pre_tokenizer"]["add_prefix_space"] or not vocabulary["pre_tokenizer"]["use_regex"]:
            raise ValueError("only the plain byte-level pattern")
        added = vocabulary["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("only added tokens that match as they are written")
        numbers = {letter: b for b, letter in enumerate(byte_letters())}
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            joined = numbers.setdefault(left + right, len(numbers))
            self.merges[numbers[left] << _BITS | numbers[right]] = (rank, joined)
        self.added = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.pieces = regex.compile(PATTERN).findall
        self.older: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        count = self.older.get(piece)
        if count is None:
            count = self.tokens(piece.encode("utf-8", "surrogatepass"))
        if len(self) >= CACHED_PIECES:
            self.older = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = count
        return count

    def tokens(self, piece: bytes) -> int:
        size = len(piece)
        if size < 2:
            return size
        merges = self.merges
        symbols = list(piece)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        heap = []
        for i in range(size - 1):
            found = merges.get(symbols[i] << _BITS | symbols[i + 1])
            if found:
                heap.append((found[0], i, found[1]))
        heapq.heapify(heap)
        merged = 0
        while heap:
            rank, i, joined = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= size:
                continue
            found = merges.get(symbols[i] << _BITS | symbols[j])
            if not found or found[0] != rank:
                continue  # one of the two has been merged since
            merged += 1
            symbols[i], symbols[j] = joined, -1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                found = merges.get(joined << _BITS | symbols[k])
                if found:
                    heapq.heappush(heap, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get(symbols[h] << _BITS | joined)
                if found:
                    heapq.heappush(heap, (found[0], h, found[1]))
        return size - merged

    def count(self, text: str) -> int:
        parts = self.added.split(text) if self.added else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(part))) for part in parts)


_COUNTERS: dict[int, BpeCounter] = {}


def n_tokens(df: DataFrame, text: str | Column, vocabulary: str) -> Column:
    """Number of tokens of a text column; ``vocabulary`` is the path of a tokenizer's .json file on the driver."""
    with open(vocabulary, encoding="utf-8") as file:
        sent = df.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("bigint")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = hash(sent.value)
        counter = _COUNTERS.get(key)
        if counter is None:
            _COUNTERS.clear()
            counter = _COUNTERS[key] = BpeCounter(json.loads(sent.value))
        for texts in batches:
            yield pd.Series([counter.count(t) if t else 0 for t in texts], dtype="int64")

    return counted(F.col(text) if isinstance(text, str) else text)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """All columns of ``docs`` with n_bytes, n_tokens and over_limit (replaced if they exist)."""
    counted = docs.withColumns({
        "n_bytes": F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint"),
        "n_tokens": n_tokens(docs, "text", vocabulary),
    })
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
