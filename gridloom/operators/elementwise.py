"""Elementwise loops over several arrays, with and without broadcasting, and staged folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import NDFrame
from .views import broadcast_shape, broadcast_to


def _aligned(xs: Sequence[NDFrame]) -> DataFrame:
    """(axes, v0, v1, ...): equi-joins on all coordinates. An operand that is the same frame as an earlier one costs no join."""
    first = xs[0]
    seen: dict[int, int] = {id(first.df): 0}
    df = first.df.select(*first.axes, F.col("v").alias("v0"))
    for k, x in enumerate(xs[1:], 1):
        if id(x.df) in seen:
            df = df.withColumn(f"v{k}", F.col(f"v{seen[id(x.df)]}"))
            continue
        seen[id(x.df)] = k
        other = x.df.select(*x.axes, F.col("v").alias(f"v{k}"))
        how = "full" if first.sparse or x.sparse else "inner"
        df = df.join(other, first.axes, how) if first.rank else df.crossJoin(other)
    if any(x.sparse for x in xs):
        df = df.select(*first.axes, *(F.coalesce(f"v{k}", F.lit(0)).alias(f"v{k}") for k in range(len(xs))))
    return df


def for_each(body: Callable[..., Column], *xs: NDFrame) -> NDFrame:
    """body of the values of arrays of equal shape, cell by cell. Layouts (contiguous, strided) make no
    difference: coordinates have them folded in. Sparse operands give a sparse result, and body(0, ...) must be 0."""
    if len({x.shape for x in xs}) != 1:
        raise ValueError(f"shapes differ: {[x.shape for x in xs]}")
    v = body(*(F.col(f"v{k}") for k in range(len(xs))))
    return NDFrame(_aligned(xs).select(*xs[0].axes, v.alias("v")), xs[0].shape, any(x.sparse for x in xs))


def for_each_serial(body: Callable[..., Column], *xs: NDFrame) -> NDFrame:
    """:func:`for_each` in one task: only for small arrays."""
    out = for_each(body, *xs)
    return out.with_df(out.df.coalesce(1))


def for_each_wide(df: DataFrame, body: Callable[..., Column], *columns: str, name: str = "v") -> DataFrame:
    """body of columns that are aligned by row: one projection, no join."""
    return df.withColumn(name, body(*(F.col(c) for c in columns)))


def broadcast(body: Callable[..., Column], *xs: NDFrame, align: str = "right") -> NDFrame:
    """body over arrays of compatible shapes. The operand of full shape keeps its rows; smaller ones are joined
    on the axes along which they vary, so nothing is stretched where one operand has the whole shape."""
    shape = broadcast_shape(*(x.shape for x in xs), align=align)
    whole = next((k for k, x in enumerate(xs) if x.shape == shape), None)
    if whole is None:
        whole = 0
        xs = (broadcast_to(xs[0], shape, align), *xs[1:])
    base = xs[whole]
    df = base.df.select(*base.axes, F.col("v").alias(f"v{whole}"))
    for k, x in enumerate(xs):
        if k == whole:
            continue
        shift = len(shape) - x.rank if align == "right" else 0
        on = [a for a in range(x.rank) if x.shape[a] != 1]
        other = x.df.select(*(F.col(f"i{a}").alias(f"i{a + shift}") for a in on), F.col("v").alias(f"v{k}"))
        df = df.join(other, [f"i{a + shift}" for a in on]) if on else df.crossJoin(other)
    v = body(*(F.col(f"v{k}") for k in range(len(xs))))
    return NDFrame(df.select(*base.axes, v.alias("v")), shape)


def materialise_into(out: NDFrame, body: Callable[..., Column], *xs: NDFrame) -> NDFrame:
    """:func:`broadcast` whose result must have the shape of an existing array."""
    got = broadcast(body, *xs)
    if got.shape != out.shape:
        raise ValueError(f"{got.shape} into {out.shape}")
    return got


def staged_fold(
    df: DataFrame,
    before: Callable[[], Any],
    inside: Callable[[Any, pd.DataFrame], Any],
    row: Callable[[Any], dict],
    schema: str,
    after: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """A fold in stages for states that no built-in aggregate has: each task begins with before(), takes its
    batches in by inside(state, batch), and gives one row(state); after merges the tasks' rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, any_ = before(), False
        for batch in batches:
            state, any_ = inside(state, batch), True
        if any_:
            yield pd.DataFrame([row(state)])

    return after(df.mapInPandas(run, schema))


def lift_unary(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """f over the elements of an array column."""
    return lambda a: F.transform(a, f)


def lift_reduction(op: Callable[[Column, Column], Column], start: Column) -> Callable[[Column], Column]:
    """A fold of an array column."""
    return lambda a: F.aggregate(a, start, op)


def axpy(alpha: float, x: NDFrame, y: NDFrame) -> NDFrame:
    """alpha * x + y."""
    return for_each(lambda a, b: F.lit(alpha) * a + b, x, y)


def scal(alpha: float, x: NDFrame) -> NDFrame:
    return x.map(lambda v: F.lit(alpha) * v)
