"""Array expressions: padding, pairing, shifting, encoding."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pad_list(arr: str | Column, n: int | Column, pad: Column) -> Column:
    """Cut to ``n`` entries or fill up with ``pad``."""
    a, size = _c(arr), n if isinstance(n, Column) else F.lit(n)
    return F.slice(F.concat(a, F.array_repeat(pad, F.greatest(size - F.size(a), F.lit(0)))), F.lit(1), size)


def flat_pairs(pairs: str | Column, first: str, second: str) -> Column:
    """[(a, v), ...] to [a, v, ...]."""
    return F.flatten(F.transform(_c(pairs), lambda p: F.array(p[first], p[second])))


def chunk_pairs(flat: str | Column, first: str, second: str) -> Column:
    """[a, v, ...] to [(a, v), ...]; an odd last entry is left out."""
    a = _c(flat)
    firsts = F.filter(a, lambda x, i: i % 2 == 0)
    seconds = F.filter(a, lambda x, i: i % 2 == 1)
    return F.zip_with(F.slice(firsts, F.lit(1), F.size(seconds)), seconds,
                      lambda x, y: F.struct(x.alias(first), y.alias(second)))


def prefixes(arr: str | Column) -> Column:
    """[x, y, z] to [[x], [x, y], [x, y, z]]."""
    a = _c(arr)
    return F.transform(F.sequence(F.lit(1), F.size(a)), lambda i: F.slice(a, F.lit(1), i))


def permutation_list(n: int) -> Column:
    """All n! index orders as a constant array of arrays."""
    return F.array(*[F.array(*[F.lit(i) for i in p]) for p in permutations(range(n))])


def reorder(arr: str | Column, order: Column) -> Column:
    a = _c(arr)
    return F.transform(order, lambda i: F.get(a, i))


def shift_left(arr: str | Column, pad: Column) -> Column:
    """Next-token target: drop the first entry, append ``pad``."""
    a = _c(arr)
    return F.concat(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.array(pad))


def shift_right(arr: str | Column, start: Column) -> Column:
    """Teacher input: prepend ``start``, drop the last entry."""
    a = _c(arr)
    return F.concat(F.array(start), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))))


def one_hot(idx: str | Column, n: int) -> Column:
    x = _c(idx)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == x).cast("int"))


def one_hot_matrix(ids: str | Column, n: int) -> Column:
    """One row of ``n`` zeros and ones for each id of a sequence; an id outside 0 .. n-1 stops the job."""
    bad = F.raise_error(F.lit(f"id outside 0 .. {n - 1}")).cast("int")
    return F.transform(_c(ids), lambda x: one_hot(F.when((x >= 0) & (x < n), x).otherwise(bad), n))


def inner_product(a: str | Column, b: str | Column) -> Column:
    prod = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)


def joined(arr: str | Column, sep: str = " ") -> Column:
    """Array to one text, for keys and reports."""
    return F.array_join(F.transform(_c(arr), lambda x: x.cast("string")), sep)
