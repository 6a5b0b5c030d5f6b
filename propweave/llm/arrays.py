"""Array helpers whose work grows with the array, not with its square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Elements added one by one to an array; longer arrays are put together from such parts.
PART = 128


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once; inside a lambda an expression would be worked out for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _scan(sizes: Column) -> Column:
    """Sums before each element of a short array: an array is copied whenever it grows."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, zero, lambda acc, x: F.struct(
        (acc["at"] + x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])


def starts(sizes: Column, levels: int = 3) -> Column:
    """The sum of all sizes before each element of an array<int>: parts are scanned, then the sums of the parts."""
    if levels == 1:
        return _scan(sizes)

    def scanned(s: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / PART).cast("int")), lambda k: F.slice(s, k * PART + 1, PART))
        return bound(parts, lambda p: F.flatten(F.zip_with(
            F.transform(p, _scan), starts(F.transform(p, lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b)), levels - 1),
            lambda own, before: F.transform(own, lambda v: v + before))))

    return bound(sizes, lambda s: F.when(F.size(s) <= PART, _scan(s)).otherwise(scanned(s)))
