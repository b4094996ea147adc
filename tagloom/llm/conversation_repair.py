"""Conversation structure repair: faults of turns, cheapest edits, repaired turns.

A conversation is legal if the initials of its roles spell ``(s?(ua)+)?``.  Its rows
are taken by turn (nulls first; then role, then text).  A row's first fault counts:
blank, duplicate (role and text seen earlier), truncated (does not end in ``.``, ``!``
or ``?``).  Blank and duplicate rows must be deleted, a truncated row that stays costs 1.

1. Rows are numbered by a range sort; a conversation is cut into blocks of at most
   ``BLOCK`` rows at fixed numbers, so one that holds a third of all rows is many blocks.
   Duplicates come from an aggregate over digests, not from a window over a conversation.
2. Each block is searched in its own row of initials and faults (``edit_lattice``):
   a conversation of one block from the empty start to its ends, a block of a longer
   one from each state to each state.  Costs and audits of blocks are put together
   one conversation at a time; what is gathered is 16 letters for a row.
3. Edits travel to the rows of their block as one more record in front of them;
   sorted by number they are applied as a stream, so a task holds one batch of rows.

Defined cases: a null role or text is one space, so such a text is blank and such a role
cannot be kept; an empty role has no initial; a null turn comes first and counts for no
gap; rows without conv_id are one conversation; repeated rows are duplicates; a
conversation without rows has no edits; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm import edit_lattice as lattice
from tagloom.llm.shared import Scratch, stored
from tagloom.operators.numbering import number_rows

BLOCK = 1024
_WHITE = r"\x20\x09-\x0D"


def conversation_key(conv_id: str = "conv_id") -> Column:
    """A key that is not null, also where the id is."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit(""))


def numbered_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """key, pos, block, turn, role, text, fault of every row; ``pos`` numbers all rows, conversation by conversation."""
    rows = conversations.select(
        conversation_key().alias("key"), F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    order = [F.col("key").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    placed = scratch.put(number_rows(rows, order, "pos"), "turns")
    same = F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary"), 256)
    firsts = placed.groupBy("key", same.alias("same")).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = (
        F.when(~F.col("text").rlike(f"[^{_WHITE}]"), lattice.BLANK)
        .when(F.col("first").isNull(), lattice.DUPLICATE)
        .when(~F.col("text").rlike(rf"[.!?][{_WHITE}]*\z"), lattice.TRUNCATED)
        .otherwise(lattice.NONE)
    )
    return placed.join(firsts, "pos", "left").select("key", "pos", "turn", "role", "text", fault.alias("fault"))


EDITS = "key string, block bigint, cost bigint, audit string"
_PATHS = "key string, block bigint, start int, stop int, cost bigint, audit string"


def _paths(blocks: DataFrame) -> DataFrame:
    """Cheapest paths of each block; start and stop are null where the block is the whole conversation."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, block, low, high, initials, faults in zip(*(batch[c] for c in ("key", "block", "low", "high", "initials", "faults"))):
                letters, marks = "".join(i or " " for i in initials), [int(f) for f in faults]
                if low == high:
                    rows.append((key, block, None, None, *lattice.cheapest(letters, marks)))
                    continue
                for start in range(lattice.STATES) if block > low else [lattice.EMPTY]:
                    for stop in range(lattice.STATES) if block < high else lattice.ENDS:
                        path = lattice.cheapest(letters, marks, start, (stop,))
                        if path is not None:
                            rows.append((key, block, start, stop, *path))
            frame = pd.DataFrame(rows, columns=["key", "block", "start", "stop", "cost", "audit"])
            yield frame.astype({"start": "Int32", "stop": "Int32"})

    return blocks.mapInPandas(search, _PATHS)


def chained(paths: pd.DataFrame) -> pd.DataFrame:
    """The edits of each block on the cheapest way through all blocks of a conversation, the least audit among equals."""
    ways = {lattice.EMPTY: (0, ())}
    for block, part in paths.sort_values("block").groupby("block"):
        reached: dict[int, tuple[int, tuple]] = {}
        for start, stop, cost, audit in zip(part["start"], part["stop"], part["cost"], part["audit"]):
            if start not in ways:
                continue
            way = ways[start][0] + cost, (*ways[start][1], (block, cost, audit))
            known = reached.get(stop)
            if known is None or way[0] < known[0] or way[0] == known[0] and _spelled(way) < _spelled(known):
                reached[stop] = way
        ways = reached
    _, steps = min((ways[q] for q in lattice.ENDS if q in ways), key=lambda w: (w[0], _spelled(w)))
    return pd.DataFrame([(paths["key"].iloc[0], *step) for step in steps], columns=["key", "block", "cost", "audit"])


def _spelled(way: tuple[int, tuple]) -> str:
    return "".join(step[2] for step in way[1])


def cheapest_edits(turns: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """key, block, cost, audit: the edits of every block of rows."""
    cut = turns.select("key", F.expr(f"pos div {block}").alias("block"), F.struct("pos", F.substring("role", 1, 1).alias("initial"), "fault").alias("row"))
    rows = cut.groupBy("key", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"))  # at most ``block`` rows
    blocks = scratch.put(rows.select("key", "block", F.col("rows.initial").alias("initials"), F.col("rows.fault").alias("faults")), "blocks")
    ends = blocks.groupBy("key").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    paths = scratch.put(_paths(blocks.join(ends, "key")), "paths")
    whole = paths.filter("start IS NULL").select("key", "block", "cost", "audit")
    long = paths.filter("start IS NOT NULL").groupBy("key").applyInPandas(chained, EDITS)
    return scratch.put(whole.unionByName(long), "edits")


class Edited:
    """Applies the audit letters of a conversation to its rows, in order."""

    def __init__(self) -> None:
        self.state, self.letters = lattice.EMPTY, iter("")

    def _give(self) -> str:
        initial = lattice.given(self.state)
        self.state = lattice.AFTER[self.state][initial]
        return lattice.ROLES[initial]

    def rest(self) -> list[tuple[str, str]]:
        """The turns inserted after the last row of a block."""
        return [(self._give(), "") for _ in self.letters]

    def start(self, audit: str) -> list[tuple[str, str]]:
        before, self.letters = self.rest(), iter(audit)
        return before

    def row(self, role: str, text: str) -> list[tuple[str, str]]:
        out = []
        for letter in self.letters:
            if letter == "I":
                out.append((self._give(), ""))
                continue
            if letter == "K":
                self.state = lattice.AFTER[self.state][role[0]]
                out.append((role, text))
            elif letter == "R":
                out.append((self._give(), text))
            break
        return out


class Summary:
    """Counts, audit and digest of one conversation, row by row."""

    COLUMNS = "key string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"

    def __init__(self, key: str):
        self.key, self.turns, self.low, self.last = key, 0, None, None
        self.faults = [0] * 4
        self.illegal, self.before, self.cost, self.audit = 0, None, 0, []
        self.digest, self.edited, self.lines = hashlib.sha256(), Edited(), 0

    def _write(self, turns: list[tuple[str, str]]) -> None:
        for role, text in turns:
            self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.lines += 1

    def edits(self, cost: int, audit: str) -> None:
        self._write(self.edited.start(audit))
        self.cost += cost
        self.audit.append(audit)

    def row(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.last:
            self.low = turn if self.low is None else self.low
            self.turns, self.last = self.turns + 1, turn
        self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        self._write(self.edited.row(role, text))

    def done(self) -> tuple:
        self._write(self.edited.rest())
        gaps = self.last - self.low + 1 - self.turns if self.turns else 0
        return (self.key, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


class Turns:
    """The repaired turns of one conversation."""

    COLUMNS = "key string, turn bigint, role string, text string"

    def __init__(self, key: str):
        self.key, self.edited, self.number = key, Edited(), 0

    def _numbered(self, turns: list[tuple[str, str]]) -> list[tuple]:
        self.number += len(turns)
        return [(self.key, self.number - len(turns) + i, *turn) for i, turn in enumerate(turns)]

    def edits(self, cost: int, audit: str) -> list[tuple]:
        return self._numbered(self.edited.start(audit))

    def row(self, turn: int | None, role: str, text: str, fault: int) -> list[tuple]:
        return self._numbered(self.edited.row(role, text))

    def rest(self) -> list[tuple]:
        return self._numbered(self.edited.rest())


def _streamed(turns: DataFrame, edits: DataFrame, block: int, walk: Callable[[Iterator], Iterator], columns: str) -> DataFrame:
    """``walk`` over (key, is a row, turn or cost, role or audit, text, fault), the edits of a block in front of its rows."""
    rows = turns.select("key", "pos", F.lit(True).alias("is_row"), "turn", "role", "text", "fault")
    marks = edits.select(
        "key", (F.col("block") * block).alias("pos"), F.lit(False).alias("is_row"), F.col("cost").alias("turn"),
        F.col("audit").alias("role"), F.lit("").alias("text"), F.lit(0).alias("fault"),
    )
    ordered = rows.unionByName(marks).repartition("key").sortWithinPartitions("key", "pos", "is_row").drop("pos")

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def records():
            for batch in batches:
                yield from zip(*(column.to_pylist() for column in batch.columns))

        names, held = [c.split()[0] for c in columns.split(", ")], []
        for made in walk(records()):
            held.append(made)
            if len(held) == 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, m)) for m in held], _arrow(columns))
                held = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, m)) for m in held], _arrow(columns))

    return ordered.mapInArrow(each, columns)


def _arrow(columns: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "bigint": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def _summaries(records: Iterator[tuple]) -> Iterator[tuple]:
    own = None
    for key, is_row, turn, role, text, fault in records:
        if own is None or own.key != key:
            if own is not None:
                yield own.done()
            own = Summary(key)
        if is_row:
            own.row(turn, role, text, fault)
        else:
            own.edits(turn, role)
    if own is not None:
        yield own.done()


def _repaired(records: Iterator[tuple]) -> Iterator[tuple]:
    own = None
    for key, is_row, turn, role, text, fault in records:
        if own is None or own.key != key:
            if own is not None:
                yield from own.rest()
            own = Turns(key)
        yield from own.row(turn, role, text, fault) if is_row else own.edits(turn, role)
    if own is not None:
        yield from own.rest()


def summarise(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation with rows.

    A digest is taken over a whole conversation in order, so one task streams it;
    nothing else of it is gathered.
    """
    with Scratch(conversations.sparkSession, "repair") as scratch:
        turns = scratch.put(numbered_turns(conversations, scratch), "faults")
        found = _streamed(turns, cheapest_edits(turns, scratch, block), block, _summaries, Summary.COLUMNS)
        return stored(found, "repaired")


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """key, turn (from 0), role, text: the repaired turns."""
    with Scratch(conversations.sparkSession, "repair") as scratch:
        turns = scratch.put(numbered_turns(conversations, scratch), "faults")
        found = _streamed(turns, cheapest_edits(turns, scratch, block), block, _repaired, Turns.COLUMNS)
        return stored(found, "repaired")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by a checksum of conversation and turn: dropped, emptied, without ends of sentences, repeated, or given to the user."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    kept = rows.filter("harm <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("harm") == 3, 2).otherwise(1).alias("times"))
    return kept.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("_")).drop("_")


def repair_report(original: DataFrame, rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id and the summary of ``rows`` for every conversation of ``original``; zeros where none of its rows is left."""
    ids = original.select("conv_id").distinct().withColumn("key", conversation_key())
    found = ids.join(summarise(rows, block), "key", "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
