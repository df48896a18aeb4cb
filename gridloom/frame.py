"""Arrays as DataFrames in coordinate form.

An :class:`NDFrame` of shape (n0, ..., nr-1) is a DataFrame with the columns i0 ... i{r-1} (BIGINT, from 0) and v, a
row for each cell. Shapes are known on the driver, so shape errors are raised before any job, and views
(transpose, slice, broadcast) are projections and filters that Catalyst fuses into what follows. Frames are
immutable: what would change an array returns another.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RANK = 6


def axes(rank: int) -> list[str]:
    return [f"i{k}" for k in range(rank)]


def strides_of(shape: Sequence[int]) -> tuple[int, ...]:
    """Row-major strides: of each axis, the cells from one index to the next."""
    return tuple(prod(shape[k + 1 :]) for k in range(len(shape)))


def check_shape(shape: Sequence[int]) -> tuple[int, ...]:
    shape = tuple(int(n) for n in shape)
    if len(shape) > MAX_RANK:
        raise ValueError(f"rank {len(shape)} is above {MAX_RANK}")
    if any(n < 0 for n in shape):
        raise ValueError(f"negative extent in {shape}")
    return shape


@dataclass(frozen=True)
class NDFrame:
    df: DataFrame
    shape: tuple[int, ...]
    #: Cells that have no row count as zero (a sparse frame); dense frames have a row for each cell.
    sparse: bool = False
    #: Strides of the layout that the cells came in; only metadata, as coordinates have no order.
    strides: tuple[int, ...] | None = None

    def __post_init__(self):
        object.__setattr__(self, "shape", check_shape(self.shape))
        if self.strides is None:
            object.__setattr__(self, "strides", strides_of(self.shape))
        missing = {*axes(self.rank), "v"} - set(self.df.columns)
        if missing:
            raise ValueError(f"no column {sorted(missing)}")

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return prod(self.shape)

    @property
    def axes(self) -> list[str]:
        return axes(self.rank)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def dtype(self) -> str:
        return self.df.schema["v"].dataType.simpleString()

    def is_c_contiguous(self) -> bool:
        """Whether the layout is row-major without gaps; axes of extent 1 don't matter."""
        want = 1
        for n, s in zip(reversed(self.shape), reversed(self.strides)):
            if n != 1:
                if s != want:
                    return False
                want *= n
        return True

    def position(self) -> Column:
        """Row-major linear index of a cell."""
        return reduce(lambda a, b: a + b, (F.col(a) * s for a, s in zip(self.axes, strides_of(self.shape))), F.lit(0)).cast("long")

    def with_df(self, df: DataFrame, **other) -> NDFrame:
        return replace(self, df=df, **other)

    def map(self, f: Callable[[Column], Column]) -> NDFrame:
        return self.with_df(self.df.select(*self.axes, f(F.col("v")).alias("v")))

    def cast(self, kind: str) -> NDFrame:
        return self.map(lambda v: v.cast(kind))

    def enumerate(self) -> DataFrame:
        """(position, v) of each cell; order by position for C order."""
        return self.df.select(self.position().alias("position"), "v")

    def get(self, *index: int) -> DataFrame:
        """The cell at an index, as a frame of one row. Indices are checked on the driver."""
        self._check(index)
        return self.df.filter(_at(index)).select("v")

    def set(self, index: Sequence[int], value) -> NDFrame:
        """The array with one cell changed."""
        self._check(index)
        v = F.when(_at(index), F.lit(value).cast(self.dtype)).otherwise(F.col("v"))
        return self.with_df(self.df.select(*self.axes, v.alias("v")))

    def _check(self, index: Sequence[int]) -> None:
        if len(index) != self.rank or any(not 0 <= i < n for i, n in zip(index, self.shape)):
            raise IndexError(f"{tuple(index)} in shape {self.shape}")

    def dense(self) -> NDFrame:
        """With a row for each cell; missing ones are zero."""
        if not self.sparse:
            return self
        grid = coordinates(self.spark, self.shape)
        full = grid.join(self.df, self.axes, "left") if self.rank else self.df
        return self.with_df(full.select(*self.axes, F.coalesce("v", F.lit(0).cast(self.dtype)).alias("v")), sparse=False)

    def to_numpy(self):
        """The whole array on the driver: for arrays that are known to be small."""
        import numpy as np

        rows = self.dense().enumerate().toPandas()
        out = np.zeros(self.size, dtype=rows["v"].dtype)
        out[rows["position"].to_numpy()] = rows["v"].to_numpy()
        return out.reshape(self.shape)

    def view(self, name: str) -> NDFrame:
        """Names the frame for SQL; shares the data."""
        self.df.createOrReplaceTempView(name)
        return self


def _at(index: Sequence[int]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"i{k}") == i for k, i in enumerate(index)), F.lit(True))


def unravel(position: Column, shape: Sequence[int]) -> list[Column]:
    """Coordinates of a row-major linear index."""
    out = []
    for k, (n, s) in enumerate(zip(shape, strides_of(shape))):
        c = F.floor(position / s) if s > 1 else position
        out.append((c % n if k else c).cast("long").alias(f"i{k}"))
    return out


def coordinates(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """A row for each cell of a shape."""
    shape = check_shape(shape)
    grid = spark.range(prod(shape))
    return grid.select(*(F.expr(_unravel_sql(k, shape)).alias(f"i{k}") for k in range(len(shape)))) if shape else grid.select()


def _unravel_sql(k: int, shape: Sequence[int]) -> str:
    s = strides_of(shape)[k]
    whole = f"id div {s}" if s > 1 else "id"
    return f"({whole}) % {shape[k]}" if k else f"({whole})"
