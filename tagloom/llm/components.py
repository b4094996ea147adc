"""Connected components by alternating large-star and small-star rounds, all in Spark.

Each round reads edges from files and writes them to files in the shared folder,
so lineage stays short and a lost executor costs one stage.  Minima are written
before they are joined back: both sides of that join are then plain shuffles, and
adaptive execution can split a node that a third of all edges touch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.shared import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = down.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) of every node that has an edge; ``edges`` has columns a, b."""
    tell = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    state = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state.agg(*tell).first()
    while before[0]:
        state = stored(_small_star(_large_star(state)), "edges")
        now = state.agg(*tell).first()
        if now == before:
            break
        before = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
