"""Expressions over arrays inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements added up in one go; a longer array is cut, so that no step copies all of it.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _before(numbers: Column, start: Column) -> Column:
    none = F.array().cast("array<bigint>")
    state = F.struct(start.alias("total"), none.alias("before"))
    return F.aggregate(
        numbers,
        state,
        lambda s, x: F.struct((s["total"] + x).alias("total"), F.concat(s["before"], F.array(s["total"])).alias("before")),
        lambda s: s["before"],
    )


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda s, x: s + x)


def sums_before(numbers: Column) -> Column:
    """For every element of an array of bigint the sum of those before it."""

    def of_blocks(blocks: Column) -> Column:
        starts = _before(F.transform(blocks, _total), F.lit(0).cast("bigint"))
        return F.flatten(F.zip_with(blocks, starts, _before))

    def of_array(whole: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(whole), F.lit(1)), F.lit(BLOCK))
        return let(F.transform(firsts, lambda i: F.slice(whole, i, BLOCK)), of_blocks)

    return let(numbers, of_array)
