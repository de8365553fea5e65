"""Expressions on arrays; all stay inside one row, so none of them shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe(array: Column | str) -> Column:
    """The array, or an empty one for null."""
    array = F.col(array) if isinstance(array, str) else array
    return F.coalesce(array, F.array())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_by(array: Column, key: Callable[[Column], Column]) -> Column:
    """The elements whose key doesn't occur before them, in order; each key is computed once."""
    both = F.struct(array.alias("a"), F.transform(array, key).alias("k"))
    return let(both, lambda s: F.filter(s["a"], lambda _, i: F.array_position(s["k"], F.get(s["k"], i)) == i + 1))


def last_by(array: Column, key: Callable[[Column], Column]) -> Column:
    """For each key its last element, in the order of the keys' last occurrence."""
    return F.reverse(first_by(F.reverse(array), key))


def jaccard(left: Column, right: Column) -> Column:
    """Set similarity of two arrays: two empty ones are equal, an empty and another have nothing in common."""
    both = F.size(F.array_union(left, right))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / F.greatest(both, F.lit(1)))


def set_jaccard(left: Column, right: Column) -> Column:
    """jaccard() of arrays that repeat no element, with one comparison of the two."""
    total = F.size(left) + F.size(right)
    return F.when(total == 0, F.lit(1.0)).otherwise(let(F.size(F.array_intersect(left, right)), lambda n: n / F.greatest(total - n, F.lit(1))))


def ordered(array: Column) -> Column:
    """Payloads of an array of struct<ord, v> in order."""
    return F.transform(F.array_sort(array), lambda x: x["v"])


def pairs_before(array: Column) -> Column:
    """All struct<a, b> of elements where a stands before b."""
    return F.flatten(F.transform(array, lambda a, i: F.transform(F.filter(array, lambda _, j: j > i), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def cross(left: Column, right: Column) -> Column:
    """All struct<a, b> of an element of each."""
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.struct(a.alias("a"), b.alias("b")))))


def first_nonempty(*arrays: Column) -> Column:
    """The first array with an element, else an empty one."""
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays], arrays[-1])
