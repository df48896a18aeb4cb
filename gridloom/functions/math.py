"""Elementary functions of columns; all run in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

exp, log, log2, sin, cos, tanh, sqrt = F.exp, F.log, F.log2, F.sin, F.cos, F.tanh, F.sqrt
pow_ = F.pow


def exp_clamped(x: Column, bound: float = 88.0) -> Column:
    """exp of x held within +-bound, as single-precision kernels saturate. NaN, the largest value, gives exp(bound)."""
    return F.exp(F.least(F.greatest(x, F.lit(-bound)), F.lit(bound)))


def exp2(x: Column) -> Column:
    return F.pow(F.lit(2.0), x)


def exp_float(x: Column) -> Column:
    """exp with the result in single precision."""
    return F.exp(x).cast("float")


def sincos(x: Column) -> Column:
    return F.struct(F.sin(x).alias("sin"), F.cos(x).alias("cos"))


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0).cast("double"))


def vectorize(f):
    """f over the elements of an array column."""
    return lambda a: F.transform(a, f)
