"""Running results over arrays as Column expressions (JVM-side, no UDF).

A fold that appends to its result copies it at every step, which is quadratic
in the array. The functions here double their reach in each round instead: a
round is one pass over the array, and a thousand elements take ten rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _rounds(size: Column) -> Column:
    """0, 1, ... for each doubling that an array of this size (two or more) takes."""
    return F.sequence(F.lit(0), F.ceil(F.log2(size)).cast("int") - 1)


def _shift(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running result: element i is x0 . x1 . ... . xi for an associative ``combine``."""
    def round_(acc: Column, k: Column) -> Column:
        return F.transform(acc, lambda x, i: F.when(i >= _shift(k), combine(F.get(acc, i - _shift(k)), x)).otherwise(x))
    return let(values, lambda v: F.when(F.size(v) < 2, v).otherwise(F.aggregate(_rounds(F.size(v)), v, round_)))


#: Elements of a block whose running sum is built by appending.
SUM_BLOCK = 32


def running_sum(values: Column) -> Column:
    """Inclusive running sum: appended element by element in short blocks, which the totals of the blocks before are added to."""
    def block(v: Column, b: Column) -> Column:
        return F.aggregate(F.slice(v, b * SUM_BLOCK + 1, SUM_BLOCK), F.slice(v, 1, 0), lambda acc, x: F.array_append(
            acc, F.when(F.size(acc) == 0, x).otherwise(F.element_at(acc, -1) + x)))

    def whole(blocks: Column) -> Column:
        totals = running(F.transform(blocks, lambda b: F.element_at(b, -1)), lambda a, b: a + b)
        return let(totals, lambda t: F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: x + F.get(t, i - 1))))))

    return let(values, lambda v: F.when(F.size(v) < 2, v).otherwise(let(F.transform(
        F.sequence(F.lit(0), F.floor((F.size(v) - 1) / SUM_BLOCK).cast("int")), lambda b: block(v, b)), whole)))


def running_back(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Element i is xi . ... . xn, for an associative and commutative ``combine``."""
    return F.reverse(running(F.reverse(values), combine))


def first_after(sorted_values: Column, value: Column, equal: bool) -> Column:
    """Index (0-based) of the first ascending element above ``value`` (or at it, with ``equal``); the size if none."""
    def round_(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["low"] + acc["high"], 1)
        at = F.get(sorted_values, mid)
        found = (acc["low"] < acc["high"]) & (at >= value if equal else at > value)
        low = F.when((acc["low"] < acc["high"]) & ~found, mid + 1).otherwise(acc["low"])
        return F.struct(low.alias("low"), F.when(found, mid).otherwise(acc["high"]).alias("high"))
    start = F.struct(F.lit(0).alias("low"), F.size(sorted_values).alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(sorted_values) + 1)).cast("int")), start, round_, lambda acc: acc["low"])


def chain(following: Column, starts: Column) -> Column:
    """The indices that the ``starts`` lead to, themselves included, ascending.

    ``following`` has for each index the next one of its chain, always larger; a value of its size or more ends it.
    """
    def round_(acc: Column, _: Column) -> Column:
        return F.struct(
            F.array_union(acc["found"], F.filter(F.transform(acc["found"], lambda i: F.get(acc["jump"], i)), lambda i: i < F.size(acc["jump"]))).alias("found"),
            F.transform(acc["jump"], lambda i: F.coalesce(F.get(acc["jump"], i), F.size(acc["jump"]))).alias("jump"))
    whole = let(following, lambda f: F.when(F.size(f) < 2, starts).otherwise(F.aggregate(
        _rounds(F.size(f)), F.struct(starts.alias("found"), f.alias("jump")), round_, lambda acc: acc["found"])))
    return F.sort_array(whole)
