"""Recurrent cells over sequences that are array columns: a fold inside the row, so sequences never leave the JVM.

A sequence is an array of vectors (arrays of doubles). Weights are nested lists on the driver: w is hidden x features,
u hidden x hidden, b one for each hidden unit. A null sequence gives null, an empty one the first state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.math import sigmoid
from ..sources.arrays import shape_of

Matrix = Sequence[Sequence[float]]


@dataclass(frozen=True)
class Gate:
    """w x + u h + b."""

    w: Matrix
    u: Matrix
    b: Sequence[float]

    def __post_init__(self):
        n = len(self.b)
        if shape_of(list(map(list, self.w)))[0] != n or shape_of(list(map(list, self.u))) != (n, n):
            raise ValueError(f"gate of {n} units with weights {shape_of(self.w)} and {shape_of(self.u)}")

    def of(self, x: Column, h: Column) -> Column:
        inner = F.zip_with(_times(self.w, x), _times(self.u, h), lambda p, q: p + q)
        return F.zip_with(inner, _vector(self.b), lambda p, q: p + q)


def _vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _times(m: Matrix, x: Column) -> Column:
    rows = F.array(*map(_vector, m))
    return F.transform(rows, lambda r: F.aggregate(F.zip_with(r, x, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def windows(vector: Column | str, features: int) -> Column:
    """A flat vector as a sequence of vectors."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    starts = F.sequence(F.lit(1), F.greatest(F.size(vector) - features + 1, F.lit(1)), F.lit(features))
    return F.transform(starts, lambda at: F.slice(vector, at, features).cast("array<double>"))


def rnn(sequence: Column, gate: Gate, start: Sequence[float] | None = None) -> Column:
    """The last state of h = tanh(w x + u h + b)."""
    return F.aggregate(sequence, _vector(start or [0.0] * len(gate.b)), lambda h, x: F.transform(gate.of(x, h), F.tanh))


def gru(sequence: Column, update: Gate, reset: Gate, candidate: Gate, start: Sequence[float] | None = None) -> Column:
    """The last state of h = z h + (1 - z) c, with gates z and r and c = tanh(w x + u (r h) + b)."""

    def step(h: Column, x: Column) -> Column:
        damped = F.zip_with(F.transform(reset.of(x, h), sigmoid), h, lambda r, v: r * v)
        new = _let(damped, lambda rh: F.transform(candidate.of(x, rh), F.tanh))
        mixed = F.zip_with(F.transform(update.of(x, h), sigmoid), new, lambda z, c: F.struct(z.alias("z"), c.alias("c")))
        return F.zip_with(mixed, h, lambda m, v: m["z"] * v + (1 - m["z"]) * m["c"])

    return F.aggregate(sequence, _vector(start or [0.0] * len(update.b)), step)
