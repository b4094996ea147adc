"""SimHash near-dedup by a binary trie self-join.

Distinct fingerprints form a trie.  Its upper part is walked in Spark: a frontier
of node pairs, with their differing bits, starts at six bits (a small input is
spread over many tasks too) and goes down two bits a step; pairs above the budget
are dropped, and pairs whose nodes hold at most ``ROOM`` fingerprints leave the
frontier.  A subtree that is too large, such as a family of near copies
that holds a third of the corpus, is split further, so no task gets an unbounded
group.  Each pair that is left is walked to the leaves in one task
(``hamming_trie``) and yields at most one edge for each of its fingerprints, and
components of those edges are found in Spark.  No link is lost: a task leaves out
only links between fingerprints it has already united.

Fingerprints: A-Z in lower case, words without ASCII white space, shingles joined
by a space (repeats count; fewer words than a shingle: the whole sequence), XXH64
with seed 42; a bit is 1 if more than half of the shingles have it.

Defined cases: a text without a word (null, empty) has fingerprint zero and is
linked like any other; a null doc_id is never a component's name unless there is
no other (then it is null); rows that share a doc_id keep a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.components import components
from tagloom.llm.hamming_trie import linked_groups
from tagloom.llm.shared import slices, stored
from tagloom.llm.similar_sets import similar_documents

BUDGET = 3
ROOM = 4096
FIRST = 6
STEP = 2


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*[words[k:] for k in range(shingle)], strict=False)
    hashes = np.fromiter((digest(join(run), 42) for run in runs), np.uint64, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 15):
        part = hashes[start : start + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id (bigint), fp (the fingerprint's 64 bits as a bigint) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(each, "doc_id bigint, fp bigint")


def _prefix(depth: int):
    return F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("bigint")


def _with_sizes(pairs: DataFrame, fps: DataFrame, depth: int) -> DataFrame:
    """Pairs of nodes of one depth whose nodes exist, with their numbers of fingerprints."""
    sizes = stored(fps.groupBy(_prefix(depth).alias("node")).agg(F.count("*").alias("n")), "nodes")
    sized = pairs.join(sizes.select(F.col("node").alias("u"), F.col("n").alias("n_u")), "u")
    sized = sized.join(sizes.select(F.col("node").alias("v"), F.col("n").alias("n_v")), "v")
    return stored(sized.select("u", "v", "differing", "n_u", "n_v"), "frontier")


def node_pairs(fps: DataFrame, budget: int = BUDGET, room: int = ROOM) -> DataFrame:
    """Pairs of subtrees that hold every pair of fingerprints within the budget: depth, u, v (prefixes, u <= v), differing."""
    spark = fps.sparkSession
    top = range(1 << FIRST)
    starts = [(u, v, (u ^ v).bit_count()) for u in top for v in top if u <= v and (u ^ v).bit_count() <= budget]
    frontier = _with_sizes(spark.createDataFrame(starts, "u bigint, v bigint, differing int"), fps, FIRST)
    done = []
    steps = [(i, j, (i ^ j).bit_count()) for i in range(1 << STEP) for j in range(1 << STEP)]
    pick = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j"), F.lit(d).alias("d")) for i, j, d in steps])
    for depth in range(FIRST, 65, STEP):
        large = (F.when(F.col("u") == F.col("v"), F.col("n_u")).otherwise(F.col("n_u") + F.col("n_v")) > F.when(F.col("u") == F.col("v"), room).otherwise(2 * room)) & F.lit(depth < 64)
        done.append(frontier.filter(~large).select(F.lit(depth).alias("depth"), "u", "v", "differing"))
        down = frontier.filter(large)
        if depth == 64 or down.isEmpty():
            break
        down = down.select("u", "v", "differing", F.explode(pick).alias("s")).filter((F.col("u") != F.col("v")) | (F.col("s.i") <= F.col("s.j")))
        down = down.select((F.shiftleft("u", STEP) + F.col("s.i")).alias("u"), (F.shiftleft("v", STEP) + F.col("s.j")).alias("v"), (F.col("differing") + F.col("s.d")).alias("differing"))
        frontier = _with_sizes(down.filter(F.col("differing") <= budget), fps, depth + STEP)
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return stored(result, "node-pairs")


def links(fps: DataFrame, budget: int = BUDGET, room: int = ROOM) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fp) whose components are those of all links within the budget."""
    pairs = node_pairs(fps, budget, room)
    depths = sorted(r["depth"] for r in pairs.select("depth").distinct().collect())  # at most one for each step of the walk
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(d).alias("node")) for d in depths] or [F.struct(F.lit(0).alias("depth"), _prefix(0).alias("node"))]))
    placed = fps.select("fp", at.alias("p")).select("fp", "p.depth", "p.node")
    lefts = placed.withColumnRenamed("node", "u").join(pairs, ["depth", "u"]).select("depth", "u", "v", "differing", "fp", F.lit(False).alias("right"))
    rights = placed.withColumnRenamed("node", "v").join(pairs.filter("u <> v"), ["depth", "v"]).select("depth", "u", "v", "differing", "fp", F.lit(True).alias("right"))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        keys, right = group["fp"].to_numpy().view(np.uint64), group["right"].to_numpy()
        other = None if first["u"] == first["v"] else keys[right]
        a, b = linked_groups(keys[~right], other, int(first["depth"]), int(first["differing"]), budget)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return lefts.unionByName(rights).groupBy("depth", "u", "v").applyInPandas(walk, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = BUDGET, room: int = ROOM) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id that links reach) of every row of ``docs``."""
    found = stored(fingerprints(docs, shingle), "fingerprints")
    fps = stored(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(fps.select("fp"), budget, room))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    names = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    named = stored(rooted.join(names, "root").select("fp", "component_id"), "named")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, budget: int | None = None) -> DataFrame:
    """``docs`` without the near copies of a document of smaller doc_id; rows of one doc_id share its fate, rows without a doc_id stay.

    With a budget near copies are the documents whose fingerprints link within it
    (:func:`near_duplicates`).  Without one they are those that share at least 0.8 of
    their shingles: most of such pairs differ in more bits than a trie can be walked
    with, so they are found by their shingles (``similar_sets``).
    """
    if budget is None:
        named = similar_documents(docs, shingle)
    else:
        named = near_duplicates(docs.filter("doc_id IS NOT NULL"), shingle, budget)
    gone = named.filter("doc_id <> component_id").select(F.col("doc_id").alias("_dup_doc")).distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == F.col("_dup_doc"), "left_anti")
