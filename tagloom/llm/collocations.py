"""Phrase collocations by vertical partitioning of the words' suffixes.

Texts fall into pieces at punctuation and line ends, pieces into words; a suffix is a
word with the words that follow it in its piece, cut off at three.  Phrases are the
nodes of the tree of all suffixes, and a node's count is the sum of its leaves.

1. Prefixes: first words are counted; those above the memory budget are extended by the
   next word, in one more pass for each further word, until no prefix is above it or three
   words are reached (a leaf).  Prefixes in order are put into groups of at most the budget.
2. Each task sorts the suffixes it has read, a few million words at a time, and sends each
   group its range, packed: the words of the range, and each different suffix once
   with its count.
3. A group's subtree is built alone, in one task: the ranges are merged, and the totals of
   its leaves are added up to its nodes.  A node whose prefix is spread over several groups
   (only the first and the last of a group can be) is added up in Spark.
4. Scores, containment and ranks are joins and aggregates over the nodes that are frequent
   enough; the arithmetic is in decimals.

A group holds at most ``BUDGET`` words of text, or the whole text's words by ``GROUPS``
where that is more: that bounds the list of group limits, which goes to every task.  A
word that a third of all texts consist of is only extended further, and a suffix that is
met again and again is one entry of each packed range.

Defined cases: null text is empty; null language is ``und``; A-Z count as a-z; every row
counts, also one whose doc_id or text another row has; ties are ranked by count, then
phrase; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import pickle
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.shared import Scratch, slices, stored

DEPTH = 3
BUDGET = 2_000_000
GROUPS = 1 << 18
#: Words a task reads before it sends what it has.
READ = 3_000_000
UNKNOWN = "und"

_LINES = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_END, _SPACE = -1, -2


class _Ids(dict):
    """Numbers for words, in the order they come."""

    def __init__(self):
        super().__init__({b"\n": _END, b"": _SPACE})

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self) - 2
        return self[word]


class Suffixes:
    """Different suffixes of some texts in order: up to three ranks of words (0: none) and their counts.

    ``words`` is sorted and starts with the empty word, so ranks compare as words do.
    """

    def __init__(self, ids: _Ids, texts: list[np.ndarray]):
        read = [w for w, i in ids.items() if i >= 0]
        order = sorted(range(len(read)), key=read.__getitem__)
        self.words = [b"", *[read[i] for i in order]]
        rank = np.zeros(len(read) + 1, np.int64)
        rank[order] = np.arange(1, len(read) + 1)  # the last entry, for ``_END``, stays 0
        first = rank[np.concatenate([*texts, [_END] * DEPTH])]
        columns = [first[:-2], first[1:-1], first[2:]]
        columns[2] = np.where(columns[1] > 0, columns[2], 0)
        starts = columns[0] > 0
        self.columns, self.counts = merged([c[starts] for c in columns], np.ones(int(starts.sum()), np.int64), len(self.words))

    def place(self, limit: tuple[bytes, ...]) -> int:
        """Number of suffixes before the given one, which need not be here."""
        low, high = 0, len(self.counts)
        for column, word in zip(self.columns, limit):
            at = bisect_left(self.words, word)
            if at == len(self.words) or self.words[at] != word:
                return low + int(np.searchsorted(column[low:high], at))
            low, high = low + int(np.searchsorted(column[low:high], at)), low + int(np.searchsorted(column[low:high], at, side="right"))
        return low

    def packed(self, start: int, stop: int) -> bytes:
        """The suffixes of a range with the words they need."""
        columns = [c[start:stop] for c in self.columns]
        used = np.unique(np.concatenate(columns))
        small = np.uint16 if len(used) < 1 << 16 else np.uint32
        return zlib.compress(pickle.dumps((b"\n".join(self.words[i] for i in used), [np.searchsorted(used, c).astype(small) for c in columns], self.counts[start:stop].astype(np.uint32))), 1)


def merged(columns: list[np.ndarray], counts: np.ndarray, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of ranks below ``words`` in order, equal ones made one and their counts added."""
    if not len(counts):
        return columns, counts
    if words < 1 << 20:
        order = np.argsort((columns[0] * words + columns[1]) * words + columns[2], kind="stable")
    else:
        order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    firsts = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))))
    return [c[firsts] for c in columns], np.add.reduceat(counts[order], firsts)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Suffixes]]:
    """Language and suffixes of batches of (lang, text), ``READ`` words at a time."""
    held: dict[str, tuple[_Ids, list]] = defaultdict(lambda: (_Ids(), []))
    total = 0
    for batch in slices(batches, 1):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
            if not text:
                continue
            ids, texts = held[lang]
            tokens = text.lower().translate(_LINES).replace(b"\n", b" \n ").split(b" ")
            found = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
            texts += [found[found != _SPACE], [_END]]
            total += len(tokens)
        if total >= READ:
            yield from ((lang, Suffixes(*one)) for lang, one in held.items())
            held.clear()
            total = 0
    yield from ((lang, Suffixes(*one)) for lang, one in held.items())


_PREFIX = "lang string, first binary, second binary, third binary, n bigint"
_KEYS = ["lang", "first", "second", "third"]


def _counted(texts: DataFrame, depth: int, heavy) -> DataFrame:
    """Prefixes of ``depth`` words with their counts: all, or those that extend the given ones (a broadcast set)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, found in _suffixes(batches):
            columns = [c if k < depth else np.zeros_like(c) for k, c in enumerate(found.columns)]
            if heavy is not None:
                wanted = np.zeros(len(found.counts), bool)
                for prefix in heavy.value.get(lang, ()):
                    wanted[found.place(prefix) : found.place((*prefix[:-1], prefix[-1] + b"\0"))] = True
                columns = [c[wanted] for c in columns]
                columns, counts = merged(columns, found.counts[wanted], len(found.words))
            else:
                columns, counts = merged(columns, found.counts, len(found.words))
            words = pa.array(found.words, pa.binary())
            for at in range(0, len(counts), 100_000):
                part = slice(at, at + 100_000)
                taken = [words.take(pa.array(c[part])) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(taken[0]), pa.string()), *taken, pa.array(counts[part])], [*_KEYS, "n"])

    return texts.mapInArrow(each, _PREFIX).groupBy(*_KEYS).agg(F.sum("n").alias("n"))


def _group_limits(prefixes: DataFrame, budget: int) -> list[tuple]:
    """First prefix of each group: prefixes in order, as many as the budget holds.

    Sorted by range in Spark; each partition closes its own groups, so there
    are at most twice the words by the budget, and one for each partition.
    """

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            limits = []
            for row, n in enumerate(batch["n"].tolist()):
                if total is None or total + n > budget:
                    limits.append(row)
                    total = 0
                total += n
            yield batch.iloc[limits]

    found = prefixes.orderBy(*_KEYS).mapInPandas(close, _PREFIX).drop("n").collect()
    return sorted((r["lang"].encode(), bytes(r["first"]), bytes(r["second"]), bytes(r["third"])) for r in found)


def vertical_partitions(texts: DataFrame, scratch: Scratch, budget: int) -> tuple[list[tuple], DataFrame]:
    """Limits of the groups, and lang, total: the words of each language."""
    context = texts.sparkSession.sparkContext
    words = scratch.put(_counted(texts, 1, None), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    budget = max(budget, (words.agg(F.sum("n")).first()[0] or 0) // GROUPS)
    prefixes, level = words.filter(F.col("n") <= budget), words
    for depth in range(2, DEPTH + 1):
        above = level.filter(F.col("n") > budget).select(*_KEYS).collect()  # at most the words by the budget
        if not above:
            break
        heavy = defaultdict(list)
        for r in above:
            heavy[r["lang"]].append(tuple(bytes(r[k]) for k in _KEYS[1:depth]))
        level = scratch.put(_counted(texts, depth, context.broadcast(dict(heavy))), "words")
        prefixes = prefixes.unionByName(level if depth == DEPTH else level.filter(F.col("n") <= budget))
    return _group_limits(prefixes, budget), totals


def _ranges(texts: DataFrame, limits) -> DataFrame:
    """group, lang, suffixes: each group's share of what a task has read."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, found in _suffixes(batches):
            low, high = bisect_left(limits.value, (lang.encode(),)), bisect_left(limits.value, (lang.encode() + b"\0",))
            # what comes before the language's first limit belongs to the group that began in an earlier language
            places = [0, *[found.place(limit[1:]) for limit in limits.value[low:high]], len(found.counts)]
            full = [k for k in range(high - low + 1) if places[k] < places[k + 1]]
            yield pa.RecordBatch.from_arrays([
                pa.array([low - 1 + k for k in full], pa.int32()), pa.array([lang] * len(full), pa.string()),
                pa.array([found.packed(places[k], places[k + 1]) for k in full], pa.binary()),
            ], ["group", "lang", "suffixes"])

    return texts.mapInArrow(each, "group int, lang string, suffixes binary")


NODES = "lang string, words int, phrase string, n bigint"


def subtree(ranges: list[bytes], least: int) -> Iterator[tuple[int, str, int]]:
    """(words, phrase, count) of the nodes of a group that are frequent enough, or first or last in it."""
    parts = [pickle.loads(zlib.decompress(r)) for r in ranges]
    lists = [words.split(b"\n") for words, _, _ in parts]
    known = sorted(set().union(*lists))
    rank = {w: i for i, w in enumerate(known)}
    maps = [np.fromiter(map(rank.__getitem__, words), np.int64, len(words)) for words in lists]
    columns = [np.concatenate([m[p[1][k]] for m, p in zip(maps, parts)]) for k in range(DEPTH)]
    columns, counts = merged(columns, np.concatenate([p[2] for p in parts]).astype(np.int64), len(known))
    absent = rank.get(b"", -1)
    for depth in range(1, DEPTH + 1):
        new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:depth]])
        firsts = np.flatnonzero(np.concatenate(([True], new)))
        totals = np.add.reduceat(counts, firsts)
        kept = totals >= least
        kept[[0, -1]] = True
        kept &= columns[depth - 1][firsts] != absent
        for row, total in zip(firsts[kept].tolist(), totals[kept].tolist()):
            yield depth, b" ".join(known[c[row]] for c in columns[:depth]).decode("utf-8", "replace"), total


def frequent_phrases(texts: DataFrame, limits: list[tuple], least: int) -> DataFrame:
    """lang, words, phrase, n of every phrase of up to three words that occurs ``least`` times or more."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for lang, ranges in group.groupby("lang")["suffixes"]:
            rows += [(lang, *node) for node in subtree(ranges.tolist(), least)]
        return pd.DataFrame(rows, columns=["lang", "words", "phrase", "n"])

    shared = texts.sparkSession.sparkContext.broadcast(limits)
    nodes = _ranges(texts, shared).groupBy("group").applyInPandas(build, NODES)
    return nodes.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates with a, l, r and score of the cut that scores lowest, contained ones left out."""
    word = F.split("phrase", " ")

    def some(start: int, length: int) -> Column:
        return F.array_join(F.slice(word, start, length), " ")

    def cut_after(k: int, words: int) -> Column:
        return F.struct(F.lit(k).alias("k"), some(1, k).alias("left"), some(k + 1, words - k).alias("right"))

    cuts = F.when(F.col("words") == 2, F.array(cut_after(1, 2))).otherwise(F.array(cut_after(1, 3), cut_after(2, 3)))
    candidates = phrases.filter(F.col("words") >= 2).select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(cuts).alias("cut"))
    cut = candidates.select("lang", "phrase", "words", "a", "cut.k", "cut.left", "cut.right")
    cut = cut.join(phrases.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cut = cut.join(phrases.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    big = {c: f"cast({c} as decimal(19, 0))" for c in "alr"}
    score = F.expr(f"({big['a']} * {big['a']} * cast(1000000 as decimal(7, 0))) div ({big['l']} * {big['r']})")
    lowest = cut.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    longer = phrases.filter(F.col("words") == 3).select("lang", "n", F.explode(F.array(some(1, 2), some(2, 2))).alias("phrase"))
    longest = longer.groupBy("lang", "phrase").agg(F.max("n").alias("above"))
    kept = lowest.join(longest, ["lang", "phrase"], "left").filter(F.col("above").isNull() | (100 * F.col("above") < 50 * F.col("a")))
    return kept.select("lang", "phrase", "a", "low.l", "low.r", "low.score")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of each language."""
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    with Scratch(docs.sparkSession, "phrases") as scratch:
        limits, totals = vertical_partitions(texts, scratch, budget)
        phrases = scratch.put(frequent_phrases(texts, limits, least), "phrases")
        best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = scored(phrases).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
        found = ranked.join(totals, "lang")
        return stored(found.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"), "collocations")
