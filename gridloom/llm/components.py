"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def _state(edges: DataFrame) -> tuple[int, int]:
    got = edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38,0)))")).first()
    return got[0], got[1] or 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), root being the least node of its component.

    Union-find by alternating large-star and small-star rounds: each hangs the neighbours of a node on the
    least of them, so the number of rounds grows with the logarithm of the longest path. The edges are a
    table in the shared folder after each round; neither nodes nor edges ever meet on the driver. Nodes that
    only have an edge to themselves, and nulls, are left out.
    """
    edges = edges.filter("a is not null and b is not null and a != b")
    edges = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        # large star: the neighbours above a node go to the least of all its neighbours or itself
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = durable(large.distinct(), "edges")
        # small star: the neighbours below a node, and itself, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = durable(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
