"""Small integer arrays (shapes, strides) as array columns; negative positions count from the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i)) if i >= 0 else F.element_at(a, i)


def put(a: Column, i: int, value) -> Column:
    k = F.lit(i) if i >= 0 else F.size(a) + i
    return F.transform(a, lambda x, p: F.when(p == k, F.lit(value)).otherwise(x))


def cut(a: Column, low: int, high: int) -> Column:
    """Elements low to high, both included."""
    return F.slice(a, low + 1, high - low + 1)


def insert(a: Column, i: int, value) -> Column:
    return F.concat(F.slice(a, 1, i), F.array(F.lit(value)), F.slice(a, i + 1, 1 << 20))


def delete(a: Column, i: int) -> Column:
    return F.filter(a, lambda x, p: p != i)


def add(a: Column, value) -> Column:
    return F.array_append(a, F.lit(value))


def set_len(a: Column, n: int) -> Column:
    """The first n elements, filled up with 0."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0).cast("long"), n)), 1, n)


def product(a: Column) -> Column:
    return F.aggregate(a, F.lit(1).cast("long"), lambda p, x: p * x)


def concat(*arrays: Column) -> Column:
    return F.concat(*arrays)


def reversed_(a: Column) -> Column:
    return F.reverse(a)


def equal(a: Column, b: Column) -> Column:
    return a == b


def zip_(a: Column, b: Column) -> Column:
    """Pairs up to the shorter of the two."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(F.arrays_zip(a, b), F.lit(1), n)


def pairs(a: Column) -> Column:
    return F.transform(a, lambda x, p: F.struct(p.alias("at"), x.alias("x")))


def greatest(a: Column) -> Column:
    return F.array_max(a)


def text(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(a.cast("array<string>"), ", "), F.lit("]"))


def strides(shape: Column) -> Column:
    """Row-major strides of a shape."""
    return F.transform(shape, lambda x, p: product(F.slice(shape, p + 2, F.size(shape))))
