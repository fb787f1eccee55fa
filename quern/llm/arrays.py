"""Column expressions over long arrays and texts whose cost grows with their length, not its square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of a block of a running combination, and characters of a piece of a text.
BLOCK, CHUNK = 256, 1024


def running(values: Column, combine: Callable[[Column, Column], Column] = lambda a, b: a + b, zero: int = 0, kind: str = "int") -> Column:
    """Running combination (sums, unless told otherwise) of an array by an associative ``combine`` with neutral ``zero``; blocks are worked out
    apart and then shifted, so that a very long array costs no quadratic copying. ``values`` should be a column of its own."""
    start = F.struct(F.lit(zero).cast(kind).alias("s"), F.array().cast(f"array<{kind}>").alias("r"))

    def simple(a: Column) -> Column:
        return F.aggregate(a, start, lambda st, x: F.struct(combine(st["s"], x).cast(kind).alias("s"), F.array_append(st["r"], combine(st["s"], x).cast(kind)).alias("r")))["r"]

    n = F.size(values)
    runs = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda k: simple(F.slice(values, k * BLOCK + 1, F.lit(BLOCK))))
    totals = F.transform(runs, lambda r: F.element_at(r, -1))
    before = F.slice(F.concat(F.array(F.lit(zero).cast(kind)), simple(totals)), 1, F.size(totals))
    shifted = F.transform(F.arrays_zip(runs.alias("r"), before.alias("o")), lambda z: F.transform(z["r"], lambda x: combine(z["o"], x).cast(kind)))
    return F.when(n == 0, F.array().cast(f"array<{kind}>")).when(n <= BLOCK, simple(values)).otherwise(F.flatten(shifted))


def pieces(text: Column) -> Column:
    """A text cut into pieces of CHUNK characters, for :func:`between`."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))


def between(cut: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` up to ``end`` (from 0, exclusive) of a text cut by :func:`pieces`, whatever its length: only the pieces that hold
    them are looked at. ``cut`` should be a column of its own."""
    bits = CHUNK.bit_length() - 1
    first, last = F.shiftright(start, bits).cast("int"), F.shiftright(end - 1, bits).cast("int")

    def part(c: Column) -> Column:
        low = F.greatest(start.cast("int") - c * CHUNK, F.lit(0))
        return F.substr(F.get(cut, c), low + 1, F.least(end.cast("int") - c * CHUNK, F.lit(CHUNK)) - low)

    return F.when(end > start, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise("")
