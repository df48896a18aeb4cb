"""Views and layout changes: projections and filters on coordinates, no data moves until something reads them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import NDFrame, axes


def permute(x: NDFrame, order: Sequence[int]) -> NDFrame:
    """Axis k of the result is axis order[k] of x."""
    if sorted(order) != list(range(x.rank)):
        raise ValueError(f"{order} is no order of {x.rank} axes")
    cols = [F.col(f"i{o}").alias(f"i{k}") for k, o in enumerate(order)]
    pick = lambda t: tuple(t[o] for o in order)
    return x.with_df(x.df.select(*cols, "v"), shape=pick(x.shape), strides=pick(x.strides))


def transpose(x: NDFrame) -> NDFrame:
    return permute(x, range(x.rank)[::-1])


def transpose_batched(x: NDFrame) -> NDFrame:
    """Swaps the last two axes, whatever stands before them."""
    return permute(x, [*range(x.rank - 2), x.rank - 1, x.rank - 2])


def nchw_to_nhwc(x: NDFrame) -> NDFrame:
    return permute(x, (0, 2, 3, 1))


def nhwc_to_nchw(x: NDFrame) -> NDFrame:
    return permute(x, (0, 3, 1, 2))


def oihw_to_hwio(x: NDFrame) -> NDFrame:
    return permute(x, (2, 3, 1, 0))


def materialise(x: NDFrame) -> NDFrame:
    """The same cells as a row-major array: what a copying transpose leaves."""
    return NDFrame(x.df, x.shape, x.sparse)


def slice_(x: NDFrame, *which: slice | int) -> NDFrame:
    """Python's slices per axis, negative steps too; an integer keeps its axis with extent 1."""
    if len(which) > x.rank:
        raise IndexError(f"{len(which)} slices for rank {x.rank}")
    keep, cols, shape, strides = [], [], [], []
    for k, (n, s) in enumerate(zip(x.shape, x.strides)):
        w = which[k] if k < len(which) else slice(None)
        if isinstance(w, int):
            if not -n <= w < n:
                raise IndexError(f"{w} in extent {n}")
            w = slice(w % n, w % n + 1)
        a, b, step = w.indices(n)
        r, i = range(a, b, step), F.col(f"i{k}")
        shape.append(len(r))
        strides.append(s * step)
        if len(r) < n or step != 1:
            low, high = (min(r), max(r)) if len(r) else (0, -1)
            keep.append((i >= low) & (i <= high))
            if abs(step) != 1:
                keep.append((i - a) % step == 0)
        moved = F.expr(f"(i{k} - {a}) div {step}") if abs(step) != 1 else (i - a) * step
        cols.append(moved.cast("long").alias(f"i{k}"))
    df = x.df.filter(reduce(lambda p, q: p & q, keep)) if keep else x.df
    return x.with_df(df.select(*cols, "v"), shape=tuple(shape), strides=tuple(strides))


def sub_matrix(x: NDFrame, row: int, col: int) -> NDFrame:
    """The matrix from a row and a column on."""
    return slice_(x, slice(row, None), slice(col, None))


def reshape(x: NDFrame, *shape: int) -> NDFrame:
    from ..sources.arrays import reshape_positions

    out = NDFrame(reshape_positions(x.enumerate(), "position", "v", shape).df, tuple(shape), x.sparse)
    if out.size != x.size:
        raise ValueError(f"{x.shape} to {shape}")
    return out


def broadcast_shape(*shapes: Sequence[int], align: str = "right") -> tuple[int, ...]:
    """The common shape; extents of 1 stretch. Shorter shapes are filled up with 1 on the left, as NumPy does, or
    (align="left") on the right."""
    rank = max(map(len, shapes))
    pad = lambda s: (1,) * (rank - len(s)) + tuple(s) if align == "right" else tuple(s) + (1,) * (rank - len(s))
    out = []
    for extents in zip(*map(pad, shapes)):
        wide = {n for n in extents if n != 1}
        if len(wide) > 1:
            raise ValueError(f"shapes {shapes} don't broadcast")
        out.append(wide.pop() if wide else 1)
    return tuple(out)


def broadcast_to(x: NDFrame, shape: Sequence[int], align: str = "right") -> NDFrame:
    """x stretched to a shape. The stretched axes are generated row by row, without a join."""
    shape = tuple(shape)
    if broadcast_shape(x.shape, shape, align=align) != shape:
        raise ValueError(f"{x.shape} doesn't broadcast to {shape}")
    shift = len(shape) - x.rank if align == "right" else 0
    df, strides = x.df, []
    cols = []
    for k, n in enumerate(shape):
        old = k - shift
        if 0 <= old < x.rank and x.shape[old] == n:
            cols.append(F.col(f"i{old}").alias(f"i{k}"))
            strides.append(x.strides[old])
        else:
            df = df.withColumn(f"s{k}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))) if n > 1 else df.withColumn(f"s{k}", F.lit(0).cast("long"))
            cols.append(F.col(f"s{k}").alias(f"i{k}"))
            strides.append(0)
    return x.with_df(df.select(*cols, "v"), shape=shape, strides=tuple(strides))


def concat(xs: Sequence[NDFrame], axis: int = 0) -> NDFrame:
    """Arrays one after the other along an axis."""
    rest = {(*x.shape[:axis], *x.shape[axis + 1 :]) for x in xs}
    if len(rest) != 1:
        raise ValueError("extents differ beside the axis")
    at, parts = 0, []
    for x in xs:
        parts.append(x.df.withColumn(f"i{axis}", F.col(f"i{axis}") + at).select(*x.axes, "v"))
        at += x.shape[axis]
    shape = list(xs[0].shape)
    shape[axis] = at
    return NDFrame(reduce(DataFrame.unionByName, parts), tuple(shape), any(x.sparse for x in xs))


def morton_order(x: NDFrame, bits: int = 31) -> DataFrame:
    """The cells with their Morton key, range-partitioned by it: neighbours in all axes end up in one file."""
    key = F.lit(0).cast("long")
    for b in range(min(bits, 62 // max(1, x.rank))):
        for k in range(x.rank):
            bit = F.shiftright(F.col(f"i{k}"), b).bitwiseAND(F.lit(1).cast("long"))
            key = key.bitwiseOR(F.shiftleft(bit, b * x.rank + k))
    return x.df.select(key.alias("key"), *axes(x.rank), "v").repartitionByRange("key").sortWithinPartitions("key")
