"""Array helpers that take time in proportion to the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that one accumulator gathers: it is copied at every step, so it must stay short.
BLOCK = 128


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_total(sizes: Column, kind: str = "int") -> Column:
    """Sum of all elements up to and with each one.

    Totals are gathered block by block, then the blocks are moved by what stands before them:
    an accumulator over the whole array would copy it for every element.
    """
    return F.when(sizes.isNotNull(), bound(sizes, lambda own: _totals(own, kind)))


def _totals(sizes: Column, kind: str) -> Column:
    none = F.array().cast(f"array<{kind}>")

    def block(i: Column) -> Column:
        start = F.struct(F.lit(0).cast(kind).alias("at"), none.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            after = acc["at"] + x
            return F.struct(after.alias("at"), F.concat(acc["out"], F.array(after)).alias("out"))

        return F.aggregate(F.slice(sizes, i * BLOCK + 1, F.lit(BLOCK)), start, step)

    last = F.floor(F.greatest(F.size(sizes) - 1, F.lit(0)) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), block)
    start = F.struct(F.lit(0).cast(kind).alias("at"), F.array(none).alias("out"))

    def join(acc: Column, own: Column) -> Column:
        moved = F.transform(own["out"], lambda x: x + acc["at"])
        return F.struct(
            (acc["at"] + own["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out")
        )

    return F.flatten(F.aggregate(blocks, start, join, lambda acc: acc["out"]))
