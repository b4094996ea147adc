"""Exact self-join of shingle sets: all pairs of documents that share at least 0.8 of their shingles.

Prefix filter: two sets of similarity t share at least t of the larger one, so, in
any one order of the shingles, they share one among the first n - ceil(t n) + 1 of
either.  Only those are shuffled.  Shingles that are frequent in a bounded sample
come last in the order; the sample shapes the cost, never the result.

A family of near copies would make pairs by the square of its size.  So documents
with equal sets are one node; the nodes that meet at a shingle are first compared
with the least and the greatest of them only; then, while the pairs of components that
meet would be many, with one pivot of each shingle a round, first the most central
node, then any; then the pairs of nodes at a shingle
that are not united yet are compared.  Every pair is counted on the whole sets
before it links, and pairs that are never compared are in one component already.

Most pairs that meet are not similar.  Where two sets first meet in the order, what
they can share is what is left of the shorter rest, so a pair must meet somewhere early
enough; sizes must be near.  Each node has a bit map of its set, of at least
two bits for a shingle: a bit that only one of two maps has set is a shingle the other set
lacks, which bounds what they share from above.  Only pairs whose bound
reaches the similarity are counted, and only their texts travel: one text of a
pair with each pair, the other once for a thousand of its partners.

Defined cases: shingles as for fingerprints, each counted once, compared by their
64-bit digests; texts without a word are equal; a null doc_id is not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.components import components
from tagloom.llm.shared import Scratch, slices, stored

#: The similarity, as a fraction.
SHARED, OF = 4, 5
SAMPLE = 4_000_000
#: Most rounds of pivots; pairs of components for a node at a shingle that need no further round.
ROUNDS = 2
FEW = 2
FREQUENT = 3


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Digests of a text's shingles in their order; none for a text without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        return np.array([digest(join(words), 42)], np.uint64)
    runs = zip(*[words[k:] for k in range(shingle)], strict=False)
    return np.fromiter((digest(join(run), 42) for run in runs), np.uint64, len(words) - shingle + 1)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def _node(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), 42)).view(np.int64))


def prefix_size(n: int) -> int:
    return n - -(-SHARED * n // OF) + 1


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= SHARED * (len(a) + len(b) - both)


def _frequent(docs: DataFrame, shingle: int, sample: int):
    """Shingles that stand in several documents of a sample, sorted, and in how many; broadcast."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    one_in = max(1, chars // 6 // sample)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, shingle).view(np.int64))], ["shingle"])

    taken = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select("text").mapInArrow(each, "shingle bigint")
    found = taken.groupBy("shingle").agg(F.count("*").cast("int").alias("n")).filter(F.col("n") >= FREQUENT).toPandas()
    keys, counts = found["shingle"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int32)
    order = np.argsort(keys)
    return docs.sparkSession.sparkContext.broadcast((keys[order], counts[order]))


def prefixes(docs: DataFrame, shingle: int, sample: int = SAMPLE) -> DataFrame:
    """doc_id, node (digest of the set), size, prefix, bits of every row; a task gives a node's prefix and bit map once."""
    frequent = _frequent(docs, shingle, sample)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, counts), seen = frequent.value, set()
        for batch in slices(batches, 1):
            nodes, sizes, firsts, maps = [], [], [], []
            for text in batch.column(1).to_pylist():
                own = shingle_set(text, shingle)
                nodes.append(_node(own))
                sizes.append(len(own))
                if nodes[-1] in seen:
                    firsts.append(own[:0].view(np.int64))
                    maps.append(None)
                    continue
                seen.add(nodes[-1])
                rank = np.zeros(len(own), np.int32)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    rank = np.where(keys[at] == own, counts[at], 0)
                firsts.append(own[np.lexsort((own, rank))[: prefix_size(len(own))]].view(np.int64))
                maps.append(bit_map(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(maps, pa.binary())], ["doc_id", "node", "size", "prefix", "bits"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(each, "doc_id bigint, node bigint, size int, prefix array<bigint>, bits binary")


def bit_map(hashes: np.ndarray) -> bytes:
    """Bits set at the low ends of the hashes; a power of two of them, at least two for a hash."""
    bits = np.zeros(max(64, 1 << (2 * len(hashes)).bit_length()), np.uint8)
    bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_be_similar(a: bytes, n_a: int, b: bytes, n_b: int) -> bool:
    """Whether sets of the given sizes and bit maps can share enough; never false for similar sets."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    both = min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))
    return OF * both >= SHARED * (n_a + n_b - both)


def _near_in_size(a: str, b: str, one_way: bool = False):
    if one_way:
        return OF * F.col(a).cast("bigint") >= SHARED * F.col(b)
    return (OF * F.col(a).cast("bigint") >= SHARED * F.col(b)) & (OF * F.col(b).cast("bigint") >= SHARED * F.col(a))


def _texts(docs: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, text of the given nodes, from one document each: texts are packed where digests cannot be."""
    chosen = rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("_doc"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # rows that share a doc_id may have other texts, or the same
        for batch in slices(batches, 1):
            kept = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kept.append(node not in seen and _node(shingle_set(text, shingle)) == node)
                if kept[-1]:
                    seen.add(node)
            yield batch.filter(pa.array(kept, pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("bigint").alias("_doc"), "text").join(chosen, "_doc").select("node", "text")
    return texts.mapInArrow(each, "node bigint, text string")


def _possible(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs a, b whose bit maps allow them to be similar."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [may_be_similar(*row) for row in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    full = pairs.join(maps.select(F.col("node").alias("a"), F.col("bits").alias("x"), F.col("size").alias("n_x")), "a")
    full = full.join(maps.select(F.col("node").alias("b"), F.col("bits").alias("y"), F.col("size").alias("n_y")), "b")
    return full.select("a", "b", "x", "n_x", "y", "n_y").mapInArrow(each, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, each_text: int = 1000) -> DataFrame:
    """The pairs a, b whose sets are similar.

    A node's partners are dealt by the thousand; each lot is sorted behind the node's text.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in slices(batches, 2):
            kept = []
            for b, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if b is None:
                    own = shingle_set(text, shingle)
                kept.append(b is not None and similar(own, shingle_set(text, shingle)))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    lots = pairs.groupBy("a").agg(F.ceil(F.count("*") / each_text).cast("int").alias("lots"))
    heads = texts.select(F.col("node").alias("a"), "text").join(lots, "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(None).cast("bigint").alias("b"), "text"
    )
    dealt = pairs.join(lots, "a").select("a", F.pmod(F.xxhash64("b"), F.col("lots")).cast("int").alias("lot"), "b")
    partners = dealt.join(texts.select(F.col("node").alias("b"), "text"), "b").select("a", "lot", "b", "text")
    ordered = heads.unionByName(partners).repartition("a", "lot").sortWithinPartitions("a", "lot", F.col("b").asc_nulls_first())
    return ordered.select("a", "b", "text").mapInArrow(each, "a bigint, b bigint")


def _met(placed: DataFrame) -> DataFrame:
    """shingle, node, size, place, low, high: nodes that share a shingle of their prefixes, with the least and the greatest of them.

    The ends are aggregated before they are shuffled and joined back, so a shingle
    of a third of all nodes is a join of many rows with one, which adaptive execution splits.
    """
    ends = placed.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    return placed.join(ends, "shingle")


def _stars(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of near size of each node with the least and the greatest node of its shingles."""
    ends = members.select("node", F.explode(F.array("low", "high")).alias("end")).filter("node <> end")
    pairs = ends.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct()
    sizes = nodes.select("node", "size")
    sized = pairs.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b")
    return sized.filter(_near_in_size("n_a", "n_b")).select("a", "b")


def _early_enough(size_a: str, place_a: str, size_b: str, place_b: str):
    """Whether two sets whose first common shingle has these places can be similar."""
    left = F.least(F.col(size_a) - F.col(place_a), F.col(size_b) - F.col(place_b)).cast("bigint")
    return (OF + SHARED) * left >= SHARED * (F.col(size_a).cast("bigint") + F.col(size_b))


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """shingle, node, size, place, root of the nodes that meet."""
    return members.select("shingle", "node", "size", "place").join(roots, "node", "left").select("shingle", "node", "size", "place", F.coalesce("root", "node").alias("root"))


def _many_apart(placed: DataFrame) -> bool:
    """Whether the pairs of components that meet are more than ``FEW`` for a node at a shingle."""
    held = placed.groupBy("shingle").agg(F.approx_count_distinct("root").alias("n"), F.count("*").alias("m"))
    pairs, rows = held.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2), F.sum("m")).first()
    return (pairs or 0) > FEW * (rows or 0)


def _pivots(placed: DataFrame, turn: int) -> DataFrame:
    """Pairs of near size of each node with a pivot of its shingle in another component.

    The first turn's pivot has the largest part of its prefix in common with others, as the
    original of a family of copies has; later ones are taken by a hash.
    """
    if turn == 0:
        shared = placed.groupBy("node").agg((F.count("*") / F.max("size")).alias("shared"))
        placed = placed.join(shared, "node")
        order = F.struct(-F.col("shared"), "node")
    else:
        order = F.struct(F.xxhash64("node", F.lit(turn)), "node")
    pivot = placed.groupBy("shingle").agg(F.min_by(F.struct("node", "size", "place", "root"), order).alias("p"))
    apart = (F.col("root") != F.col("p.root")) & _near_in_size("size", "p.size") & _early_enough("size", "place", "p.size", "p.place")
    met = placed.join(pivot, "shingle").filter(apart)
    return met.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def _apart(placed: DataFrame) -> DataFrame:
    """Pairs of nodes of near size that meet at a shingle and are in different components."""
    held = placed.groupBy("shingle", "root").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.max(F.col("size") - F.col("place")).alias("left"))
    r, s = (held.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("root", "least", "most", "left")]) for side in "rs")
    may = (
        (F.col("root_r") < F.col("root_s")) & _near_in_size("most_r", "least_s", one_way=True) & _near_in_size("most_s", "least_r", one_way=True)
        & ((OF + SHARED) * F.least("left_r", "left_s").cast("bigint") >= SHARED * (F.col("least_r").cast("bigint") + F.col("least_s")))
    )
    apart = r.join(s, (r["shingle"] == s["shingle"]) & may).select(r["shingle"], F.col("root_r").alias("r"), F.col("root_s").alias("s"))
    lefts = placed.select("shingle", F.col("root").alias("r"), F.col("node").alias("u"), F.col("size").alias("n_u"), F.col("place").alias("i_u"))
    rights = placed.select("shingle", F.col("root").alias("s"), F.col("node").alias("v"), F.col("size").alias("n_v"), F.col("place").alias("i_v"))
    pairs = apart.join(lefts, ["shingle", "r"]).join(rights, ["shingle", "s"]).filter(_near_in_size("n_u", "n_v") & _early_enough("n_u", "i_u", "n_v", "i_v"))
    return pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def similar_documents(docs: DataFrame, shingle: int = 5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, node, component_id (smallest doc_id that similar pairs reach) of every row with a doc_id."""
    docs = docs.filter("doc_id IS NOT NULL")
    with Scratch(docs.sparkSession, "similar") as scratch:
        rows = scratch.put(prefixes(docs, shingle, sample), "prefixes")
        every = rows.filter("bits IS NOT NULL").groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "prefix", "bits")])
        every = scratch.put(every, "nodes")
        members = scratch.put(_met(every.select("node", "size", F.posexplode("prefix").alias("place", "shingle"))), "members")
        stars = scratch.put(_stars(members, every), "stars")
        maps = scratch.put(every.join(members.select("node").distinct(), "node", "left_semi").select("node", "bits", "size"), "maps")

        def links(pairs: DataFrame) -> DataFrame:
            possible = scratch.put(_possible(pairs, maps), "possible")
            nodes = possible.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            texts = scratch.put(_texts(docs, rows, nodes, shingle), "texts")
            return scratch.put(_verified(possible, texts, shingle), "links")

        found, tested = links(stars), stars
        for turn in range(ROUNDS):
            placed = scratch.put(_rooted(members, components(found)), "placed")
            if not _many_apart(placed):
                break
            pairs = scratch.put(_pivots(placed, turn).join(tested, ["a", "b"], "left_anti"), "pivots")
            found, tested = found.unionByName(links(pairs)), tested.unionByName(pairs)
        else:
            placed = scratch.put(_rooted(members, components(found)), "placed")
        further = scratch.put(_apart(placed).join(tested, ["a", "b"], "left_anti"), "further")
        roots = components(found.unionByName(links(further)))
        nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left")
        rooted = scratch.put(nodes.select("node", "least", F.coalesce("root", "node").alias("root")), "rooted")
        names = scratch.put(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")
        named = scratch.put(rooted.join(names, "root").select("node", "component_id"), "named")
        return stored(rows.select("doc_id", "node").join(named, "node").select("doc_id", "node", "component_id"), "components")
