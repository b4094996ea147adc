"""Removal of passages that a document of smaller doc_id holds too, by suffix automata of reference shards.

A window is ``span`` consecutive words.  Words of every window that also starts in
a document with a smaller doc_id go; windows are judged on the input.

1. Documents are written to the shared folder in parts of about 4 MB of text.
2. Every window has a minimiser: the least hash of its runs of ``ANCHOR`` words.
   Runs of windows with one minimiser make a *stretch*.  Equal windows have equal
   minimisers, so whatever two documents share is found under one of them.  Each
   part sends its distinct minimisers, packed; those that two documents hold come
   back to the part as a file of its own.  Minimisers of more than ``ROOM``
   stretches come back marked: their stretches are cut into single windows, each
   under its own hash, so that no minimiser makes a large group.
3. Stretches under shared minimisers are cut out.  A task gives each place of a stretch
   one narrow row, and the different stretches of every 16 MB, with their smallest doc_id,
   as one packed row for each shard: the reference.
4. The reference is dealt by minimiser into shards of bounded size.  A task builds a
   shard's suffix automaton, whose states know the smallest doc_id, and streams the
   shard's stretches through it: matching statistics of at least ``span`` words
   name the first holder of each window.  An automaton is used only where
   stretches of its shard are, so nothing is broadcast that grows with the data.
5. Windows that an earlier document holds go back to the parts, again as a file for each,
   and the documents are read once more to take the words out.

Hashes only choose what is compared; the automata compare words.

Defined cases: null and empty texts have no words; texts shorter than a window stay;
a document without doc_id counts as later than all others and is nobody's source; rows
that share a doc_id are one document, so they keep what they share with each other;
columns of the input named kept_text, n_words or n_removed are replaced, all others pass
through.  One document at a time is held in memory whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.shared import Scratch, read_file, remove, shared_folder, slices, write_file
from tagloom.llm.suffix_automaton import NOBODY, SuffixAutomaton

SPAN = 13
ANCHOR = 6
ROOM = 20_000
#: Most windows of a stretch: a word repeated all through a text has one minimiser.
LONGEST = 64
#: Stretches of a shard, and minimisers of a group, that a task aims at.
SHARD = 10_000
GROUP = 1_000_000
#: Bytes of different stretches that a task holds before it sends them.
HELD = 16_000_000

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x100000001B3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _MIX
    return values ^ (values >> np.uint64(29))


class Words:
    """The words of several texts laid end to end: their byte ranges, 64-bit hashes, and the text each belongs to."""

    def __init__(self, texts: list[bytes | None]):
        filled = [t or b"" for t in texts]
        self.bytes = b"\n".join(filled)
        data = np.frombuffer(self.bytes, np.uint8)
        edges = np.diff(np.concatenate(([1], _WHITE[data].view(np.int8), [1])))
        self.starts, self.stops = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        powers, inverse = np.full(len(data) + 1, _BASE, np.uint64), np.full(len(data) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        powers[0] = inverse[0] = 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers)[:-1], out=sums[1:])
        self.hashes = _mixed((sums[self.stops] - sums[self.starts]) * np.cumprod(inverse)[self.starts])
        ends = np.cumsum([len(t) + 1 for t in filled])
        self.text = np.searchsorted(ends, self.starts, side="right")
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def runs(self, size: int) -> np.ndarray:
        """A hash of every run of ``size`` words, also across texts."""
        many = max(0, len(self.hashes) - size + 1)
        total = np.zeros(many, np.uint64)
        for k in range(size):
            total = total * np.uint64(_BASE) + self.hashes[k : k + many]
        return _mixed(total)

    def stretches(self, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of windows and minimiser of each stretch, in order."""
        anchor = min(ANCHOR, span)
        least, covered, wanted = self.runs(anchor), 1, span - anchor + 1
        while covered < wanted:  # minima of twice as many runs each time
            step = min(covered, wanted - covered)
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
            covered += step
        inside = np.flatnonzero(self.text[: len(least)] == self.text[span - 1 :][: len(least)])
        if not len(inside):
            return inside, inside, np.zeros(0, np.uint64)
        key = least[inside]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (inside[1:] != inside[:-1] + 1)))
        at = np.arange(len(inside))
        new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % LONGEST == 0
        firsts = np.flatnonzero(new)
        return inside[firsts], np.diff(np.append(firsts, len(inside))), key[firsts]

    def piece(self, first: int, last: int) -> bytes:
        """Words from ``first`` to ``last`` with one space between them."""
        return b" ".join(self.bytes[self.starts[first] : self.stops[last]].split())


def _binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def _fragments(batches: Iterator[pa.RecordBatch], part: int, text: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Record batches cut where the part changes, with the part."""
    for batch in slices(batches, text):
        parts = batch.column(part).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for start, stop in zip(cuts, cuts[1:]):
            if stop > start:
                yield int(parts[start]), batch.slice(start, stop - start)


def in_parts(docs: DataFrame) -> DataFrame:
    """own (all columns but text), doc, text, part, row: rows of a part are neighbours in one file once written."""
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*others).alias("own"), F.col("doc_id").cast("bigint").alias("doc"), "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for batch in slices(batches, 2):
            numbers = [pa.array(np.full(batch.num_rows, part)), pa.array(np.arange(batch.num_rows, dtype=np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *numbers], ["own", "doc", "text", "part", "row"])
            part += 1

    own = packed.schema["own"].dataType.simpleString()
    return packed.mapInArrow(each, f"own {own}, doc bigint, text string, part bigint, row int")


def _packed_keys(docs: DataFrame, groups: int, span: int) -> DataFrame:
    """group, part, keys, counts: the distinct minimisers of each part, dealt over groups.

    A count (up to 32,767) says how many stretches of the part have the
    minimiser; its top bit, that they are of more than one document.
    """
    width = (1 << 64) // groups + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, batch in _fragments(batches, 2, 1):
            words = Words(_binary(batch.column(1)))
            first, _, key = words.stretches(span)
            if not len(key):
                continue
            holder = batch.column(0).fill_null(NOBODY).to_numpy(zero_copy_only=False)[words.text[first]]
            order = np.argsort(key, kind="stable")
            key, holder = key[order], holder[order]
            at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            counts = np.minimum(np.diff(np.append(at, len(key))), 0x7FFF).astype(np.uint16)
            counts |= (np.minimum.reduceat(holder, at) != np.maximum.reduceat(holder, at)).astype(np.uint16) << np.uint16(15)
            key = key[at]
            ends = np.searchsorted(key, np.array([min(g * width, (1 << 64) - 1) for g in range(groups + 1)], np.uint64))
            ends[-1] = len(key)
            full = [g for g in range(groups) if ends[g] < ends[g + 1]]
            yield pa.RecordBatch.from_arrays([
                pa.array(full, pa.int32()), pa.array(np.full(len(full), part)),
                pa.array([key[ends[g] : ends[g + 1]].tobytes() for g in full], pa.binary()),
                pa.array([counts[ends[g] : ends[g + 1]].tobytes() for g in full], pa.binary()),
            ], ["group", "part", "keys", "counts"])

    return docs.select("doc", "text", "part").mapInArrow(each, "group int, part bigint, keys binary, counts binary")


def _shared_keys(packed: DataFrame, room: int) -> DataFrame:
    """part, keys, hot: of each part's minimisers those that two documents hold, and whether they have more than ``room`` stretches."""

    def find(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(group["keys"]), np.uint64)
        counts = np.frombuffer(b"".join(group["counts"]), np.uint16)
        _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        several = np.zeros(len(times), bool)
        np.logical_or.at(several, which, counts >> 15 > 0)
        shared = (several | (times > 1))[which]
        hot = (np.bincount(which, counts & np.uint16(0x7FFF)) > room)[which].astype(np.uint8)
        rows, start = [], 0
        for part, size in zip(group["part"], group["keys"].str.len() // 8):
            own = shared[start : start + size]
            if own.any():
                rows.append((part, keys[start : start + size][own].tobytes(), hot[start : start + size][own].tobytes()))
            start += size
        return pd.DataFrame(rows, columns=["part", "keys", "hot"])

    return packed.groupBy("group").applyInPandas(find, "part bigint, keys binary, hot binary")


def _save(rows: DataFrame, columns: list[str], types: list[str], folder: str) -> None:
    """Write the given arrays (binary columns) of each part to a file of the part's name, sorted by the first."""

    def save(group: pd.DataFrame) -> pd.DataFrame:
        arrays = [np.frombuffer(b"".join(group[c]), t) for c, t in zip(columns, types)]
        order = np.argsort(arrays[0], kind="stable")
        write_file(f"{folder}/{int(group['part'].iloc[0])}", len(order).to_bytes(8, "little") + b"".join(a[order].tobytes() for a in arrays))
        return group[["part"]].head(1)

    rows.select("part", *columns).groupBy("part").applyInPandas(save, "part bigint").write.format("noop").mode("overwrite").save()


def _load(folder: str, part: int, types: list[str]) -> list[np.ndarray]:
    """The arrays of a part, empty ones if it has none."""
    content = read_file(f"{folder}/{part}") or bytes(8)
    many, at, arrays = int.from_bytes(content[:8], "little"), 8, []
    for kind in types:
        arrays.append(np.frombuffer(content, kind, many, at))
        at += arrays[-1].nbytes
    return arrays


def _known(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is listed, and where."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(0, len(sorted_keys) - 1))
    return (sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool)), at


PIECES = "shard int, keys binary, digests binary, least binary, words binary, key bigint, digest bigint, doc bigint, part bigint, row int, at int"
_NAMES = [field.split()[0] for field in PIECES.split(", ")]


def _reference(held: dict, shards: int) -> pa.RecordBatch:
    """The different stretches a task holds, packed by shard, each with its smallest doc_id; they are at no place."""
    keys, digests = (np.array(c, np.int64) for c in zip(*held))
    shard = (keys.view(np.uint64) % np.uint64(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    texts, least = zip(*held.values())
    least = np.array(least, np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(shard[order])) + 1).tolist(), len(order)]
    ranges = [order[a:b] for a, b in zip(cuts, cuts[1:])]
    packed = [pa.array([shard[r[0]] for r in ranges], pa.int32())]
    packed += [pa.array([column[r].tobytes() for r in ranges], pa.binary()) for column in (keys, digests, least)]
    packed.append(pa.array([zlib.compress(b"\n".join(texts[i] for i in r.tolist()), 1) for r in ranges], pa.binary()))
    return pa.RecordBatch.from_arrays([*packed, *[pa.nulls(len(ranges), t) for t in [pa.int64()] * 4 + [pa.int32()] * 2]], _NAMES)


def _pieces(docs: DataFrame, folder: str, span: int, shards: int) -> DataFrame:
    """The stretches under shared minimisers: their places (``at`` is the first word's number in the document), and their words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for part, batch in _fragments(batches, 2, 1):
            listed, hot = _load(folder, part, ["<u8", "u1"])
            words = Words(_binary(batch.column(1)))
            first, many, key = words.stretches(span)
            shared, at = _known(key, listed)
            first, many, key, at = first[shared], many[shared], key[shared], at[shared]
            if not len(first):
                continue
            cut = hot[at].astype(bool)
            singles = np.concatenate([np.arange(f, f + n) for f, n in zip(first[cut], many[cut])] or [first[:0]])
            key = np.concatenate((key[~cut], words.runs(span)[singles])).view(np.int64)
            last = np.concatenate((first[~cut] + many[~cut] + span - 2, singles + span - 1))
            first = np.concatenate((first[~cut], singles))
            of = words.text[first]
            doc = batch.column(0).take(pa.array(of))
            texts = [words.piece(f, to) for f, to in zip(first.tolist(), last.tolist())]
            digest = np.fromiter((xxhash.xxh64_intdigest(t) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.nulls(len(texts), pa.int32()), *[pa.nulls(len(texts), pa.binary())] * 4,
                pa.array(key), pa.array(digest), doc, pa.array(np.full(len(of), part)),
                batch.column(3).take(pa.array(of)), pa.array((first - words.first[of]).astype(np.int32)),
            ], _NAMES)
            for name, text, holder in zip(zip(key.tolist(), digest.tolist()), texts, doc.fill_null(NOBODY).to_pylist()):
                known = held.get(name)
                if known is None:
                    held[name] = (text, holder)
                    size += len(text)
                elif holder < known[1]:
                    held[name] = (text, holder)
            if size > HELD:
                yield _reference(held, shards)
                held, size = {}, 0
        if held:
            yield _reference(held, shards)

    return docs.select("doc", "text", "part", "row").mapInArrow(each, PIECES)


def first_holders(reference: DataFrame, span: int = SPAN) -> DataFrame:
    """key, digest, holders: of every different stretch the first holder of each of its windows.

    A shard holds all stretches of its keys; its automaton is built and used in one task.
    A stretch comes once from each task that met it, or a few times from a task that met many.
    """

    def match(shard: pd.DataFrame) -> pd.DataFrame:
        names = zip(*(np.frombuffer(b"".join(shard[c]), np.int64).tolist() for c in ("keys", "digests", "least")))
        texts = [text for words in shard["words"] for text in zlib.decompress(words).split(b"\n")]
        once: dict[tuple, list] = {}
        for (key, digest, holder), text in zip(names, texts, strict=True):
            known = once.setdefault((key, digest), [text, holder])
            known[1] = min(known[1], holder)
        automaton, numbers, stretches = SuffixAutomaton(), {}, []
        for text, holder in once.values():
            stretches.append([numbers.setdefault(w, len(numbers)) for w in text.split(b" ")])
            automaton.add(stretches[-1], holder)
        automaton.settle()
        keys, digests = zip(*once)
        return pd.DataFrame({"key": keys, "digest": digests, "holders": [automaton.first_holders(words, span) for words in stretches]})

    return reference.groupBy("shard").applyInPandas(match, "key bigint, digest bigint, holders array<bigint>")


def _removed(pieces: DataFrame, holders: DataFrame) -> DataFrame:
    """part, rows, starts (packed): the windows of each stretch that a smaller document holds."""
    found = pieces.select("key", "digest", "doc", "part", "row", "at").join(holders, ["key", "digest"])
    own = F.coalesce("doc", F.lit(NOBODY))
    starts = F.filter(F.transform("holders", lambda h, i: F.when(h < own, F.col("at") + i)), lambda s: s.isNotNull())
    kept = found.select("part", "row", starts.alias("starts")).filter(F.size("starts") > 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4"), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            rows = batch.column(1).to_numpy(zero_copy_only=False)
            packed = [values[e - n : e].tobytes() for e, n in zip(ends.tolist(), np.diff(ends, prepend=0).tolist())]
            numbers = [np.full(len(p) // 4, r, "<i4").tobytes() for p, r in zip(packed, rows.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.binary()), pa.array(packed, pa.binary())], ["part", "rows", "starts"])

    return kept.mapInArrow(pack, "part bigint, rows binary, starts binary")


def _kept(docs: DataFrame, folder: str, span: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, batch in _fragments(batches, 2, 1):
            rows, starts = _load(folder, part, ["<i4", "<i4"])
            numbers = batch.column(3).to_numpy(zero_copy_only=False)
            texts, totals, gone = [], [], []
            for text, row in zip(_binary(batch.column(1)), numbers):
                words = (text or b"").split()
                own = starts[np.searchsorted(rows, row) : np.searchsorted(rows, row, side="right")]
                covered = np.zeros(len(words) + 1, np.int64)
                np.add.at(covered, own, 1)
                np.add.at(covered, own + span, -1)
                stays = np.cumsum(covered)[:-1] == 0
                texts.append(b" ".join([w for w, s in zip(words, stays.tolist()) if s] if len(own) else words))
                totals.append(len(words))
                gone.append(len(words) - int(stays.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), batch.column(1)], ["own", "kept_text", "n_words", "n_removed", "text"])

    own = docs.schema["own"].dataType.simpleString()
    return docs.select("own", "text", "part", "row").mapInArrow(each, f"own {own}, kept_text string, n_words bigint, n_removed bigint, text string")


def dedup_passages(docs: DataFrame, span: int = SPAN, room: int = ROOM, shard: int = SHARD) -> DataFrame:
    """``docs`` with kept_text (kept words, one space between them), n_words and n_removed."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "passages")
    path = f"{folder}/documents"
    in_parts(docs).write.option("compression", "zstd").parquet(path)
    parts = spark.read.parquet(path)
    with Scratch(spark, "passages") as scratch:
        chars = parts.agg(F.sum(F.length("text"))).first()[0] or 0
        groups = max(8, chars // 36 // GROUP)  # about one minimiser in 36 characters
        shared = scratch.put(_shared_keys(_packed_keys(parts, groups, span), room), "keys")
        shards = max(8, (shared.agg(F.sum(F.length("keys"))).first()[0] or 0) // 8 // shard)
        _save(shared, ["keys", "hot"], ["<u8", "u1"], f"{scratch.folder}/shared")
        pieces = f"{scratch.folder}/pieces"
        _pieces(parts, f"{scratch.folder}/shared", span, shards).withColumn("packed", F.col("shard").isNotNull()).write.partitionBy("packed").option("compression", "zstd").parquet(pieces)
        remove(spark, f"{scratch.folder}/shared")
        read = spark.read.schema(f"{PIECES}, packed boolean")
        holders = scratch.put(first_holders(read.parquet(pieces).filter("packed"), span), "holders")
        remove(spark, f"{pieces}/packed=true")
        _save(_removed(read.parquet(pieces).filter("NOT packed"), holders), ["rows", "starts"], ["<i4", "<i4"], f"{folder}/windows")
    result = _kept(parts, f"{folder}/windows", span)
    columns = [c for c in docs.columns if c not in ("kept_text", "n_words", "n_removed")]
    return result.select(*["text" if c == "text" else F.col(f"own.`{c}`").alias(c) for c in columns], "kept_text", "n_words", "n_removed")
