"""The same reductions on streams: Spark keeps the partial results as state and updates them batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reduce import fold
from ..operators.sampling import exponential_key


def reduce_stream(stream: DataFrame, by: Sequence[str], value: str, kinds: Sequence[str] = ("sum", "min", "max")) -> DataFrame:
    """Running reductions by key; write in complete or update mode."""
    return stream.groupBy(*by).agg(*(fold(k, F.col(value)).alias(k) for k in kinds))


def reduce_windows(stream: DataFrame, ts: str, width: str, late: str, value: str, kinds: Sequence[str] = ("sum",), by: Sequence[str] = ()) -> DataFrame:
    """Reductions of windows of event time; state is dropped, and late rows with it, after the watermark."""
    windows = stream.withWatermark(ts, late).groupBy(F.window(ts, width), *by)
    return windows.agg(*(fold(k, F.col(value)).alias(k) for k in kinds))


def map_stream(stream: DataFrame, body: Callable[..., Column], *columns: str, name: str = "v") -> DataFrame:
    """An elementwise expression: stateless, the same projection as on a table."""
    return stream.withColumn(name, body(*(F.col(c) for c in columns)))


def sample_keys(stream: DataFrame, id_col: str, weight: str, seed: int = 0) -> DataFrame:
    """Rows with keys of which the k least of everything seen so far are a weighted sample without replacement."""
    unit = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return stream.withColumn("key", exponential_key(unit, F.col(weight))).filter("key is not null")
