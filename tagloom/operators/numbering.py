"""Row numbers over a whole table without passing it through one task."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_ROW_BITS = 33  # monotonically_increasing_id keeps the row inside the partition in its low 33 bits


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the session's checkpoint folder; only a local session gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    context.setCheckpointDir(folder)


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its row number (from 1) in the given total order.

    The rows are sorted by range, every partition counts its own, and the
    offset of a partition is the sum of the counts before it.  The sorted rows
    are checkpointed between the two passes so that both see the same
    partitions, also after an executor is lost.  What is broadcast has one row
    per shuffle partition.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    marked = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    marked = marked.withColumn("_part", F.shiftright("_id", _ROW_BITS))
    sizes = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        marked.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + inside + 1)
        .drop("_id", "_part", "_offset")
    )
