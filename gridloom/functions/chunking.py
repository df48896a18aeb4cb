"""Integer arithmetic of chunks and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round_down(x: Column, step: int) -> Column:
    return x - x % step


def round_up(x: Column, step: int) -> Column:
    return x + F.pmod(-x, F.lit(step))


def next_power_of_two(x: Column) -> Column:
    """The least power of two that is at least x; 1 for x below 2. Counts bits, so large integers stay exact."""
    bits = F.length(F.bin((x - 1).cast("long")))
    return F.when(x < 2, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), bits))


def chunk_sizes(n: int, chunks: int) -> list[int]:
    """Sizes of chunks that differ by one at most, larger ones first."""
    return [n // chunks + (k < n % chunks) for k in range(chunks)]


def chunk_of(position: Column, n: int, chunks: int) -> Column:
    """The chunk of a position from 0 to n - 1."""
    small, more = n // chunks, n % chunks
    edge = more * (small + 1)
    low = F.floor(position / (small + 1))
    high = more + F.floor((position - edge) / max(1, small))
    return F.when(position < edge, low).otherwise(high).cast("long")


def in_chunks(df: DataFrame, position: str, n: int, chunks: int) -> DataFrame:
    """df with each chunk of positions in one partition, in order."""
    out = df.withColumn("chunk", chunk_of(F.col(position), n, chunks))
    return out.repartitionByRange(chunks, "chunk").sortWithinPartitions(position)
