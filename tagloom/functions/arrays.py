"""Running totals over an array inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.functions.lets import let

BLOCK = 256


def running(
    array: Column,
    zero: Column,
    type_name: str,
    step: Callable[[Column, Column], Column],
    join: Callable[[Column, Column], Column],
    show: Callable[[Column, Column], Column],
) -> Column:
    """For each entry ``show(total before it, entry)``.

    ``step(total, entry)`` moves a total on and ``join(total, total)`` puts two
    together.

    In two levels, blocks of 256 entries and entries inside a block: a plain
    fold would copy its growing result at every entry, which for a text with
    very many tags is far too much.  ``type_name`` is the type of the total.
    """

    def over(a: Column) -> Column:
        n_blocks = F.ceil(F.size(a) / BLOCK).cast("int")
        numbers = F.when(n_blocks > 0, F.sequence(F.lit(1), F.greatest(n_blocks, F.lit(1))))
        blocks = F.transform(numbers, lambda n: F.slice(a, (n - 1) * BLOCK + 1, F.lit(BLOCK)))
        return F.when(n_blocks > 0, let(blocks, in_blocks))

    def in_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, zero, step))
        return let(before_each(totals), lambda starts: F.flatten(F.transform(blocks, lambda b, i: in_block(b, F.get(starts, i)))))

    def before_each(totals: Column) -> Column:
        start = F.struct(zero.alias("now"), F.array().cast(f"array<{type_name}>").alias("out"))
        return F.aggregate(
            totals,
            start,
            lambda acc, t: F.struct(
                join(acc["now"], t).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")
            ),
            lambda acc: acc["out"],
        )

    def in_block(block: Column, start: Column) -> Column:
        state = F.struct(start.alias("now"), F.array().cast(f"array<{type_name}>").alias("out"))
        befores = F.aggregate(
            block,
            state,
            lambda acc, x: F.struct(
                step(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")
            ),
            lambda acc: acc["out"],
        )
        return let(befores, lambda bs: F.transform(block, lambda x, i: show(F.get(bs, i), x)))

    return let(array, over)
