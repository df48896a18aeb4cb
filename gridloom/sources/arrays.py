"""Constructors of arrays, and copies."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import prod
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import NDFrame, axes, check_shape, coordinates


def new_tensor(spark: SparkSession, *shape: int, dtype: str = "double") -> NDFrame:
    """Zeros (empty strings for string)."""
    zero = F.lit("") if dtype == "string" else F.lit(0).cast(dtype)
    return NDFrame(coordinates(spark, shape).withColumn("v", zero), shape)


def shape_of(nested: Any) -> tuple[int, ...]:
    """The shape of nested lists; every level must agree, a string is one element."""
    if not isinstance(nested, (list, tuple)):
        return ()
    inner = {shape_of(x) for x in nested}
    if len(inner) > 1:
        raise IndexError("ragged literal")
    return (len(nested), *(inner.pop() if inner else ()))


def flat(nested: Any) -> Iterator[Any]:
    """The elements of nested lists in order."""
    if isinstance(nested, (list, tuple)):
        for x in nested:
            yield from flat(x)
    else:
        yield nested


def to_tensor(spark: SparkSession, nested: Any, dtype: str = "double") -> NDFrame:
    """An array from a literal on the driver."""
    return from_values(spark, list(flat(nested)), shape_of(nested), dtype)


def from_values(spark: SparkSession, values: Sequence[Any], shape: Sequence[int], dtype: str = "double") -> NDFrame:
    """An array from as many values as the shape has cells, in C order."""
    shape = check_shape(shape)
    if len(values) != prod(shape):
        raise ValueError(f"{len(values)} values for shape {shape}")
    kind = T._parse_datatype_string(dtype)
    to = float if isinstance(kind, (T.DoubleType, T.FloatType)) else int if isinstance(kind, T.IntegralType) else lambda x: x
    fields = [T.StructField("id", T.LongType()), T.StructField("v", kind)]
    df = spark.createDataFrame([(i, to(x)) for i, x in enumerate(values)], T.StructType(fields))
    return reshape_positions(df, "id", "v", shape)


def reshape_positions(df: DataFrame, position: str, value: str, shape: Sequence[int]) -> NDFrame:
    """An array from a frame of (C-order position, value)."""
    from ..frame import _unravel_sql

    at = df.select(F.col(position).cast("long").alias("id"), F.col(value).alias("v"))
    return NDFrame(at.select(*(F.expr(_unravel_sql(k, shape)).alias(f"i{k}") for k in range(len(shape))), "v"), tuple(shape))


def from_vectors(df: DataFrame, row: str, vector: str, shape: Sequence[int], scale: int | None = None) -> NDFrame:
    """An array from a table of (row id, array column): axis 0 is the row, the others unravel the vector. With a
    scale the values are quantised to integers, for exact sums."""
    from ..frame import _unravel_sql

    v = F.col("x").cast("double")
    if scale is not None:
        v = F.round(v * scale).cast("long")
    long = df.select(F.col(row).cast("long").alias("i0"), F.posexplode(vector).alias("p", "x"))
    inner = tuple(shape[1:])
    cols = [F.expr(_unravel_sql(k, inner).replace("id", "cast(p as bigint)")).alias(f"i{k + 1}") for k in range(len(inner))]
    return NDFrame(long.select("i0", *cols, v.alias("v")), tuple(shape))


def random_tensor(spark: SparkSession, *shape: int, low: float = 0.0, high: float = 1.0, seed: int = 0) -> NDFrame:
    """Uniform values; a cell's value depends on the seed and its indices alone."""
    from ..operators.sampling import unit

    v = F.lit(low) + unit(seed, *axes(len(shape))) * (high - low)
    return NDFrame(coordinates(spark, shape).withColumn("v", v), shape)


def random_normal(spark: SparkSession, *shape: int, seed: int = 0) -> NDFrame:
    return NDFrame(coordinates(spark, shape).withColumn("v", F.randn(seed)), shape)


def deep_copy(x: NDFrame) -> NDFrame:
    """The same cells without the lineage: written to the checkpoint folder where one is set, else the plan itself."""
    if x.spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return x.with_df(x.df.checkpoint(eager=False))
    return x.with_df(x.df.select("*"))


def copy_from(into: NDFrame, src: NDFrame, at: Sequence[int] | None = None) -> NDFrame:
    """into with the cells of src put in at an offset."""
    at = tuple(at or (0,) * into.rank)
    if src.rank != into.rank or any(o < 0 or o + n > m for o, n, m in zip(at, src.shape, into.shape)):
        raise ValueError(f"{src.shape} at {at} doesn't fit {into.shape}")
    moved = src.df.select(*((F.col(a) + o).alias(a) for a, o in zip(src.axes, at)), F.col("v").alias("new"))
    joined = into.df.join(moved, into.axes, "left")
    return into.with_df(joined.select(*into.axes, F.coalesce("new", "v").alias("v")))


def set_zero(x: NDFrame) -> NDFrame:
    return x.map(lambda v: F.lit(0).cast(x.dtype))


def from_parquet(spark: SparkSession, path: str, shape: Sequence[int]) -> NDFrame:
    """An array that :func:`to_parquet` wrote; reads only the columns and row groups that later steps need."""
    return NDFrame(spark.read.parquet(path).select(*axes(len(shape)), "v"), tuple(shape))


def to_parquet(x: NDFrame, path: str, order: bool = False) -> None:
    """Writes the cells; in C order by ranges if wanted, so that slices of axis 0 skip files."""
    df = x.df.repartitionByRange(*x.axes).sortWithinPartitions(*x.axes) if order and x.rank else x.df
    df.write.parquet(path)


def to_vectors(x: NDFrame) -> DataFrame:
    """(i0, vector): the cells of each index of axis 0 in C order."""
    rest = x.axes[1:]
    cells = F.sort_array(F.collect_list(F.struct(*rest, "v")))
    return x.dense().df.groupBy("i0").agg(F.transform(cells, lambda c: c["v"]).alias("vector"))


def pretty(x: NDFrame) -> str:
    """A matrix, or the matrices of the last two axes, as text: for arrays that are known to be small."""
    import numpy as np

    return np.array2string(x.to_numpy())


def pretty_images(x: NDFrame) -> str:
    """Images (n, c, h, w) as text: a block for each image, its channels side by side; for small arrays."""
    if x.rank != 4:
        raise ValueError(f"images have rank 4, not {x.rank}")
    texts = [[[[str(v) for v in row] for row in channel] for channel in image] for image in x.to_numpy()]
    wide = max((len(v) for image in texts for channel in image for row in channel for v in row), default=0)
    line = lambda row: " ".join(v.rjust(wide) for v in row)
    return "\n\n".join("\n".join(" | ".join(map(line, rows)) for rows in zip(*image)) for image in texts)


def to_hex(b: Column) -> Column:
    """Bytes as lower-case hex pairs with spaces between."""
    return F.trim(F.regexp_replace(F.lower(F.hex(b)), "(..)", "$1 "))
