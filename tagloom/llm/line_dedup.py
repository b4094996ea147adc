"""Line dedup that can be undone: sharded cuckoo filters backed by exact reference tables.

A line's key is the line stripped of ASCII white space with A-Z in lower case.
A key of at least ``min_chars`` code points that at least ``min_docs`` documents
hold is *repeated*; all its lines go, except those of the largest doc_id.

State, all below one folder of the shared file system:

* ``refs``: one row for each (key, document), the exact reference table.  Rows
  are dealt by (place of the key, salt of the document), so a key that a third
  of all documents hold is spread over a thousand places;
* ``gone``: the documents taken back, which hide references of earlier steps
  until ``compact`` writes the references anew;
* ``repeated``: key, number of documents, largest document;
* ``filters``: for each shard one file with a cuckoo filter of its repeated keys.
  A shard is a run of places; there are so many that each has about
  ``KEYS_A_SHARD`` repeated keys, whatever the input.

Inserting or deleting documents recounts only the keys touched, and inserts into
or deletes from the filters those keys that crossed the threshold.  A filter
that has no place for a key is built anew from the shard's exact repeated keys,
and all are when the number of shards changes.  Cleaning asks the filters first;
only references that they affirm reach the exact join, which also removes their
false positives.

Defined cases: null text is one empty line; a null doc_id refers to nothing (it
never counts as a document) but its repeated lines go; rows that share a doc_id
are one document; a document that is inserted twice counts once; own columns
``n_lines`` and ``n_dropped`` are replaced, names that begin with ``_line_`` are
taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.cuckoo import CuckooFilter
from tagloom.llm.shared import read_file, remove, shared_folder, slices, write_file

SPACE = " \t\n\x0b\x0c\r"
SALTS = 1024
PLACES = 65_536
#: Repeated keys that one filter holds, about.
KEYS_A_SHARD = 50_000
LEAST_SHARDS = 16
REFS = "place int, salt int, key binary, doc bigint, nameless string"
REPEATED = "place int, key binary, n_docs bigint, last bigint"


def line_digest(line: str, min_chars: int) -> bytes | None:
    """128-bit digest of a line's key; None for short keys."""
    line = line.strip(SPACE)
    if len(line) < min_chars:
        return None
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest()


def nameless(doc_id: Column) -> Column:
    """What tells rows without a doc_id apart: their text."""
    return F.when(doc_id.isNull(), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


class LineIndex:
    """References of all lines of a growing and shrinking set of documents.

    ``shards`` fixes the number of filters, which else follows from the number
    of repeated keys.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, shards: int | None = None, min_docs: int = 3, min_chars: int = 20):
        self.spark, self.fixed, self.min_docs, self.min_chars = spark, shards, min_docs, min_chars
        self.folder = folder or shared_folder(spark, "lines")
        self.ref_steps: list[int] = []
        self.gone_steps: list[int] = []
        self.repeated_path: str | None = None
        self.shards = shards or LEAST_SHARDS
        self.filter_steps: dict[int, int] = {}  # shard -> step that wrote its filter; none for a shard without repeated keys
        self.step = 0

    # ---- state ----

    def refs(self) -> DataFrame:
        """References of the documents that are in."""
        if not self.ref_steps:
            return self.spark.createDataFrame([], REFS)
        read = self.spark.read.schema(REFS)
        if not self.gone_steps:
            return read.parquet(*[f"{self.folder}/refs/{s}" for s in self.ref_steps])
        rows = reduce(DataFrame.unionByName, [read.parquet(f"{self.folder}/refs/{s}").withColumn("_at", F.lit(s)) for s in self.ref_steps])
        gone = reduce(DataFrame.unionByName, [self.spark.read.schema("gone bigint").parquet(f"{self.folder}/gone/{s}").withColumn("_until", F.lit(s)) for s in self.gone_steps])
        gone = gone.groupBy("gone").agg(F.max("_until").alias("_until"))
        return rows.join(gone, (F.col("doc") == F.col("gone")) & (F.col("_at") < F.col("_until")), "left_anti").drop("_at")

    def repeated(self) -> DataFrame:
        if self.repeated_path is None:
            return self.spark.createDataFrame([], REPEATED)
        return self.spark.read.schema(REPEATED).parquet(self.repeated_path)

    def _pairs(self, docs: DataFrame) -> DataFrame:
        """Distinct (key, document) of the documents' long lines."""
        min_chars = self.min_chars

        def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1):
                keys, owners, names = [], [], []
                for owner, text, name in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                    found = {line_digest(line, min_chars) for line in (text or "").split("\n")} - {None}
                    keys.extend(found)
                    owners.extend([owner] * len(found))
                    names.extend([name] * len(found))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(owners, pa.int64()), pa.array(names, pa.string())], ["key", "doc", "nameless"])

        sent = docs.select(F.col("doc_id").cast("bigint").alias("doc"), "text", nameless(F.col("doc_id")).alias("nameless"))
        found = sent.mapInArrow(lines, "key binary, doc bigint, nameless string")
        place = F.pmod(F.xxhash64("key"), F.lit(PLACES)).cast("int")
        dealt = found.withColumns({"place": place, "salt": F.pmod(F.xxhash64("doc", "nameless"), F.lit(SALTS)).cast("int")})
        dealt = dealt.repartition("place", "salt")
        return dealt.groupBy("place", "salt", "key", "doc", "nameless").agg(F.count("*").alias("n")).drop("n")

    # ---- changes ----

    def insert(self, docs: DataFrame) -> None:
        new = self._pairs(docs)
        first = not self.ref_steps
        if not first:
            held = self.refs().select(F.col("key").alias("k"), F.col("doc").alias("d"), F.col("nameless").alias("m"))
            new = new.join(held, (F.col("key") == F.col("k")) & F.col("doc").eqNullSafe(F.col("d")) & F.col("nameless").eqNullSafe(F.col("m")), "left_anti")
        path = f"{self.folder}/refs/{self.step}"
        new.sortWithinPartitions("place").write.parquet(path)
        self.ref_steps.append(self.step)
        self._recount(None if first else self.spark.read.schema(REFS).parquet(path).select("key").distinct())

    def delete(self, doc_ids: DataFrame) -> None:
        """Take back documents; afterwards the state is as if they had never been inserted."""
        path = f"{self.folder}/gone/{self.step}"
        doc_ids.select(F.col("doc_id").cast("bigint").alias("gone")).filter("gone IS NOT NULL").distinct().write.parquet(path)
        gone = self.spark.read.schema("gone bigint").parquet(path)
        keys = f"{self.folder}/touched/{self.step}"
        self.refs().join(gone, F.col("doc") == F.col("gone"), "left_semi").select("key").distinct().write.parquet(keys)
        self.gone_steps.append(self.step)
        self._recount(self.spark.read.schema("key binary").parquet(keys))

    def compact(self) -> None:
        """Write the references that count as one step and delete the rest; earlier results must not be read afterwards."""
        old = [f"{self.folder}/refs/{s}" for s in self.ref_steps] + [f"{self.folder}/gone/{s}" for s in self.gone_steps]
        rows = self.refs().select(*[f.name for f in self.spark.createDataFrame([], REFS).schema])
        rows.repartition("place", "salt").sortWithinPartitions("place").write.parquet(f"{self.folder}/refs/{self.step}")
        self.ref_steps, self.gone_steps = [self.step], []
        self.step += 1
        for path in old:
            remove(self.spark, path)

    def _recount(self, touched: DataFrame | None) -> None:
        """Exact counts of the keys touched, and the filters of those that crossed the threshold."""
        refs, old = self.refs(), self.repeated()
        if touched is not None:
            refs = refs.join(touched, "key", "left_semi")
        counts = refs.groupBy("place", "key").agg(F.count("doc").alias("n_docs"), F.max("doc").alias("last"))
        path = f"{self.folder}/repeated/{self.step}"
        now = counts.filter(F.col("n_docs") >= self.min_docs)
        if touched is not None:
            now = old.join(touched, "key", "left_anti").select(*now.columns).unionByName(now)
        now.write.parquet(path)
        self.repeated_path = path
        now = self.repeated()
        shards = self.fixed or self._wanted_shards(now.count())
        if touched is None or shards != self.shards:
            self.shards, self.filter_steps = shards, {}
            self._note(self._build(now), "built")
        else:
            changes = now.select("place", "key").join(old.select("key"), "key", "left_anti").withColumn("add", F.lit(True))
            lost = old.select("place", "key").join(now.select("key"), "key", "left_anti").withColumn("add", F.lit(False))
            full = self._note(self._change(changes.unionByName(lost)), "changed")
            if full:
                ids = self.spark.createDataFrame([(s,) for s in full], "id int")
                self._note(self._build(now.join(F.broadcast(ids), self._shard() == F.col("id"), "left_semi")), "built")
        self.step += 1

    def _wanted_shards(self, keys: int) -> int:
        """As many as there are, twice as many until the keys fit; never fewer, so that few steps build filters anew."""
        shards = self.shards
        while shards < PLACES and keys > shards * KEYS_A_SHARD:
            shards *= 2
        return shards

    def _shard(self) -> Column:
        return F.floor(F.col("place") * F.lit(self.shards) / F.lit(PLACES)).cast("int")

    def _note(self, done: DataFrame, name: str) -> list[int]:
        """Run the task per shard, take down which step wrote its filter; returns the shards that were full (``PLACES`` rows at most)."""
        path = f"{self.folder}/filter-log/{self.step}-{name}"
        done.write.parquet(path)
        rows = self.spark.read.schema("shard int, full boolean").parquet(path).collect()
        self.filter_steps.update({r["shard"]: self.step for r in rows if not r["full"]})
        return [r["shard"] for r in rows if r["full"]]

    def _build(self, keys: DataFrame) -> DataFrame:
        """A filter for each shard of exact keys."""
        folder, step = self.folder, self.step

        def build(group: pd.DataFrame) -> pd.DataFrame:
            shard = int(group["shard"].iloc[0])
            write_file(filter_path(folder, step, shard), CuckooFilter.of(map(bytes, group["key"])).dump())
            return pd.DataFrame({"shard": [shard], "full": [False]})

        return keys.select(self._shard().alias("shard"), "key").groupBy("shard").applyInPandas(build, "shard int, full boolean")

    def _change(self, changes: DataFrame) -> DataFrame:
        """The filters with some keys taken out and others put in; a full one is left to be built anew."""
        folder, step, steps = self.folder, self.step, self.filter_steps

        def change(group: pd.DataFrame) -> pd.DataFrame:
            shard = int(group["shard"].iloc[0])
            added = sorted(map(bytes, group.loc[group["add"], "key"]))
            if shard in steps:
                held = load_filter(folder, steps[shard], shard)
                for key in group.loc[~group["add"], "key"]:
                    held.delete(bytes(key))
                full = not all(map(held.insert, added))
            else:
                held, full = CuckooFilter.of(added), False
            if not full:
                write_file(filter_path(folder, step, shard), held.dump())
            return pd.DataFrame({"shard": [shard], "full": [full]})

        return changes.select(self._shard().alias("shard"), "key", "add").groupBy("shard").applyInPandas(change, "shard int, full boolean")

    # ---- use ----

    def probe(self, pairs: DataFrame) -> DataFrame:
        """Of references those whose key the shard's filter affirms."""
        folder, steps, shards = self.folder, self.filter_steps, self.shards

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, held = None, None
            for batch in batches:
                keep = []
                for place, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if place * shards // PLACES != shard:
                        shard = place * shards // PLACES
                        held = load_filter(folder, steps[shard], shard) if shard in steps else None
                    keep.append(held is not None and key in held)
                yield batch.filter(pa.array(keep, pa.bool_()))

        rows = pairs.select("place", "key", "doc", "nameless")
        return rows.mapInArrow(ask, rows.schema)

    def drops(self) -> DataFrame:
        """For each document the keys whose lines it loses: doc, nameless, keys."""
        lost = self.probe(self.refs()).join(self.repeated().select("key", "last"), "key")
        lost = lost.filter(~F.col("doc").eqNullSafe(F.col("last")))
        return lost.groupBy("doc", "nameless").agg(F.collect_list("key").alias("keys"))

    def clean(self, docs: DataFrame) -> DataFrame:
        """The indexed documents' rows, with ``text`` as kept and the columns ``n_lines`` and ``n_dropped``."""
        min_chars = self.min_chars

        @F.pandas_udf("text string, n_lines bigint, n_dropped bigint")
        def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for texts, lost in batches:
                rows = []
                for text, keys in zip(texts, lost, strict=True):
                    lines = (text or "").split("\n")
                    kept = lines
                    if keys is not None and len(keys):
                        gone = set(map(bytes, keys))
                        kept = [line for line in lines if line_digest(line, min_chars) not in gone]
                    rows.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
                yield pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

        names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
        drops = self.drops().select(F.col("doc").alias("_line_doc"), F.col("nameless").alias("_line_name"), F.col("keys").alias("_line_keys"))
        same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_line_doc")) & nameless(F.col("doc_id")).eqNullSafe(F.col("_line_name"))
        joined = docs.select(*names).join(drops.hint("shuffle_hash"), same, "left")
        done = joined.withColumn("_line_cut", cut("text", "_line_keys"))
        result = [F.col("_line_cut.text").alias("text") if c == "text" else F.col(c) for c in names]
        return done.select(*result, "_line_cut.n_lines", "_line_cut.n_dropped")


def filter_path(folder: str, step: int, shard: int) -> str:
    return f"{folder}/filters/{step}/{shard}.npy"


def load_filter(folder: str, step: int, shard: int) -> CuckooFilter:
    return CuckooFilter.load(read_file(filter_path(folder, step, shard)))


def dedup_lines(docs: DataFrame, shards: int | None = None, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """All documents indexed and cleaned."""
    index = LineIndex(docs.sparkSession, None, shards, min_docs, min_chars)
    index.insert(docs)
    return index.clean(docs)
