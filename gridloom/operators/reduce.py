"""Reductions of whole arrays and along axes, errors, softmax."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import NDFrame
from .elementwise import for_each

#: Aggregate and value of an empty array.
_KINDS = {
    "sum": (F.sum, 0),
    "min": (F.min, float("inf")),
    "max": (F.max, float("-inf")),
    "product": (F.product, 1),
    "mean": (F.avg, float("nan")),
}


def fold(kind: str, v: Column) -> Column:
    """The aggregate, with its neutral element for no values. NaN counts as the largest value, as Spark orders it."""
    agg, neutral = _KINDS[kind]
    return F.coalesce(agg(v), F.lit(neutral))


def reduce_all(x: NDFrame, kind: str = "sum") -> DataFrame:
    """One row (v). Tasks reduce their cells first; one row each meets in the end."""
    return x.df.agg(fold(kind, F.col("v")).alias("v"))


def reduce_axes(x: NDFrame, over: Sequence[int], kind: str = "sum") -> NDFrame:
    """The array without the axes in over."""
    kept = [k for k in range(x.rank) if k not in over]
    out = x.df.groupBy(*(F.col(f"i{k}").alias(f"i{n}") for n, k in enumerate(kept))).agg(fold(kind, F.col("v")).alias("v"))
    return NDFrame(out, tuple(x.shape[k] for k in kept), x.sparse)


def fused_reduction(body, *xs: NDFrame, kind: str = "sum") -> DataFrame:
    """A reduction of an elementwise expression, which is never stored."""
    return reduce_all(for_each(body, *xs), kind)


def argmax(df: DataFrame, by: Sequence[str], position: str, value: str) -> DataFrame:
    """(by, position, v) of the greatest value; the least position among equals, -1 and -Infinity for none."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.col(position)).alias("p")))
    out = df.groupBy(*by).agg(best.alias("b")) if by else df.agg(best.alias("b"))
    return out.select(*by, F.coalesce(-F.col("b.p"), F.lit(-1)).alias(position), F.coalesce("b.v", F.lit(float("-inf"))).alias("v"))


def absolute_error(y: Column, truth: Column) -> Column:
    return F.abs(truth - y)


def relative_error(y: Column, truth: Column) -> Column:
    """|truth - y| over the greater magnitude; 0 if both are 0."""
    scale = F.greatest(F.abs(truth), F.abs(y))
    return F.when(scale == 0, F.lit(0.0)).otherwise(F.abs(truth - y) / scale)


def mean_errors(df: DataFrame, y: str, truth: str) -> DataFrame:
    return df.agg(
        F.avg(relative_error(F.col(y), F.col(truth))).alias("mean_relative_error"),
        F.avg(absolute_error(F.col(y), F.col(truth))).alias("mean_absolute_error"),
    )


def max_sumexp(df: DataFrame, by: Sequence[str], v: str) -> DataFrame:
    """(by, m, s): the maximum and the sum of exp(v - maximum) of each row of a matrix. Partial results
    (m, s) of any two parts merge, so the second step aggregates parts, not values."""
    top = df.groupBy(*by).agg(F.max(v).alias("m"))
    return df.join(top, list(by)).groupBy(*by, "m").agg(F.sum(F.exp(F.col(v) - F.col("m"))).alias("s"))


def logsumexp(df: DataFrame, by: Sequence[str], v: str) -> DataFrame:
    return max_sumexp(df, by, v).select(*by, (F.col("m") + F.log("s")).alias("v"))


def softmax(x: NDFrame) -> NDFrame:
    """Stable softmax along the last axis: one exchange by row, both windows share it."""
    row = Window.partitionBy(*x.axes[:-1])
    shifted = x.df.withColumn("e", F.exp(F.col("v") - F.max("v").over(row)))
    return x.with_df(shifted.select(*x.axes, (F.col("e") / F.sum("e").over(row)).alias("v")))


def softmax_vector(a: Column) -> Column:
    """Stable softmax of an array column, within its row."""
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def softmax_cross_entropy(logits: NDFrame, labels: DataFrame) -> DataFrame:
    """(i0, v): -log softmax of the label of each row; labels has (i0, label)."""
    lse = logsumexp(logits.df, ["i0"], "v").withColumnRenamed("v", "lse")
    own = logits.df.join(labels, (logits.df["i0"] == labels["i0"]) & (logits.df["i1"] == labels["label"]))
    return own.select(logits.df["i0"], "v").join(lse, "i0").select("i0", (F.col("lse") - F.col("v")).alias("v"))
