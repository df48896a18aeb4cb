"""Stencils on grids (i0: grid, i1: row, i2: column), and recurrences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import NDFrame


def jacobi(grids: NDFrame, steps: int = 1, combine: str = "sum") -> NDFrame:
    """Steps in which each interior cell becomes a quarter of the sum (or product) of its four neighbours as they
    were before the step. A step sends each cell to its neighbours and adds up: one exchange, no join."""
    _, rows, cols = grids.shape
    inside = lambda i, j: i.between(1, rows - 2) & j.between(1, cols - 2)
    for _ in range(steps):
        moves = [F.struct(F.lit(d).alias("di"), F.lit(e).alias("dj")) for d, e in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))]
        sent = grids.df.select("i0", "i1", "i2", "v", F.explode(F.array(*moves)).alias("m"))
        own = (F.col("m.di") == 0) & (F.col("m.dj") == 0)
        sent = sent.select("i0", (F.col("i1") + F.col("m.di")).alias("i1"), (F.col("i2") + F.col("m.dj")).alias("i2"), "v", own.alias("own"))
        sent = sent.filter(F.col("own") | inside(F.col("i1"), F.col("i2")))
        beside = F.when(~F.col("own"), F.col("v"))
        near = F.product(beside) if combine == "prod" else F.sum(beside)
        met = sent.groupBy("i0", "i1", "i2").agg(F.max(F.when(F.col("own"), F.col("v"))).alias("old"), near.alias("near"))
        v = F.when(inside(F.col("i1"), F.col("i2")), F.col("near") * 0.25).otherwise(F.col("old"))
        grids = grids.with_df(met.select("i0", "i1", "i2", v.alias("v")))
    return grids


def sweep(grid: np.ndarray, steps: int, combine: str = "sum") -> np.ndarray:
    """Gauss-Seidel sweeps over the interior of one grid, in place; each uses the new values above and to the left.
    Along an anti-diagonal cells don't depend on each other, so each is one vector operation."""
    rows, cols = grid.shape
    for _ in range(steps):
        for d in range(2, rows + cols - 3):
            i = np.arange(max(1, d - cols + 2), min(rows - 2, d - 1) + 1)
            j = d - i
            near = grid[i - 1, j], grid[i + 1, j], grid[i, j - 1], grid[i, j + 1]
            grid[i, j] = 0.25 * (near[0] * near[1] * near[2] * near[3] if combine == "prod" else near[0] + near[1] + near[2] + near[3])
    return grid


def gauss_seidel(grids: NDFrame, steps: int = 1, combine: str = "sum") -> NDFrame:
    """Sweeps over each grid: the order of updates makes a grid one task's work, different grids run side by side.
    combine="prod" multiplies the neighbours."""
    rows, cols = grids.shape[1:]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((rows, cols))
        grid[pdf["i1"], pdf["i2"]] = pdf["v"]
        i, j = np.divmod(np.arange(rows * cols), cols)
        return pd.DataFrame({"i0": pdf["i0"].iloc[0], "i1": i, "i2": j, "v": sweep(grid, steps, combine).ravel()})

    return grids.with_df(grids.df.groupBy("i0").applyInPandas(run, "i0 long, i1 long, i2 long, v double"))


def recur(start: DataFrame, steps: int, step: Callable[[DataFrame, int], DataFrame], every: int = 8) -> DataFrame:
    """step(state, t) for t in turn. The lineage is cut every few steps where a checkpoint folder is set."""
    state = start
    folder = start.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    for t in range(steps):
        state = step(state, t)
        if folder and t % every == every - 1:
            state = state.checkpoint()
    return state


def where(state: DataFrame, domain: Column, value: Column) -> DataFrame:
    """v replaced inside a domain."""
    return state.withColumn("v", F.when(domain, value).otherwise(F.col("v")))


def scan_rows(pdf_rows: Iterator[pd.DataFrame], f: Callable) -> Iterator[pd.DataFrame]:
    """A fold over batches that are already in order, for recurrences along one axis inside a partition."""
    carry = None
    for pdf in pdf_rows:
        pdf, carry = f(pdf, carry)
        yield pdf
