"""Prefix sums, searches in sorted rows, and weighted sampling.

Weights are matrices (i0: row, i1: item, v: weight); they need not sum to 1.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frame import NDFrame


def unit(seed: int, *key: str | Column) -> Column:
    """A number in [0, 1) for each key, by MD5 of seed and key: the same on any partitioning and any engine."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *key)), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def cumsum(df: DataFrame, by: Sequence[str], order: str, v: str, name: str = "cdf") -> DataFrame:
    """Inclusive prefix sums of each row."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(v).over(w))


def cumsum_long(df: DataFrame, order: str, v: str, step: int = 1 << 16, name: str = "cdf") -> DataFrame:
    """Inclusive prefix sum of one long row by an integer position: stretches of the row are summed alone and set
    after those before, so no task holds the row."""
    cells = df.withColumn("__cell", F.expr(f"`{order}` div {step}"))
    before = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.groupBy("__cell").agg(F.sum(v).alias("__n"))
    starts = starts.select("__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = cells.withColumn("__here", F.sum(v).over(within)).join(starts, "__cell")
    return out.withColumn(name, F.col("__start") + F.col("__here")).drop("__cell", "__n", "__start", "__here")


def searchsorted(rows: DataFrame, probes: DataFrame, by: Sequence[str], v: str, probe: str, left: bool = True) -> DataFrame:
    """(probe columns, position): the values of the probe's row below it (left), or not above it (right).

    The values and probes of a row are merged in order and counted in one pass, so no pair is ever formed."""
    tag = 1 if left else -1
    a = rows.select(*by, F.col(v).alias("__v"), F.lit(0).alias("__kind"), *(F.lit(None).cast(t).alias(c) for c, t in probes.dtypes if c not in by))
    b = probes.select(*by, F.col(probe).cast(dict(rows.dtypes)[v]).alias("__v"), F.lit(-tag).alias("__kind"), *(c for c in probes.columns if c not in by))
    order = Window.partitionBy(*by).orderBy("__v", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    merged = a.unionByName(b).withColumn("position", F.sum((F.col("__kind") == 0).cast("long")).over(order))
    return merged.filter("__kind != 0").select(*probes.columns, "position")


def searchsorted_array(values: Column, probe: Column, left: bool = True) -> Column:
    """The same in a sorted array column."""
    return F.size(F.filter(values, (lambda x: x < probe) if left else (lambda x: x <= probe)))


def draw(weights: NDFrame, u: DataFrame) -> DataFrame:
    """(i0, i1): an item of each row by inverse CDF, where u (i0, u) is uniform in [0, 1): the first item whose
    prefix sum exceeds u times the row's total. Items of weight 0 are never drawn; rows without weight draw nothing."""
    row = Window.partitionBy("i0")
    sums = cumsum(weights.df, ["i0"], "i1", "v").withColumn("total", F.sum("v").over(row))
    hit = sums.join(u, "i0").filter(F.col("cdf") > F.col("u") * F.col("total"))
    return hit.groupBy("i0").agg(F.min("i1").alias("i1"))


def draw_seeded(weights: NDFrame, seed: int = 0) -> DataFrame:
    rows = weights.df.select("i0").distinct()
    return draw(weights, rows.select("i0", unit(seed, "i0").alias("u")))


def exponential_key(u: Column, weight: Column) -> Column:
    """A key whose k least are a weighted sample of k without replacement; keys of parts merge, so streams sample too."""
    return F.when(weight > 0, -F.log(1 - u) / weight)


def sample_without_replacement(weights: NDFrame, k: int, u: Column | None = None, seed: int = 0) -> DataFrame:
    """(i0, draw, i1): k items of each row, or all of positive weight if there are fewer, by exponential keys: the
    distribution is that of drawing one at a time and putting its weight to 0."""
    if u is None:
        u = unit(seed, "i0", "i1")
    keyed = weights.df.withColumn("key", exponential_key(u, F.col("v"))).filter("key is not null")
    order = Window.partitionBy("i0").orderBy("key", "i1")
    ranked = keyed.withColumn("draw", F.row_number().over(order)).filter(F.col("draw") <= k)
    return ranked.select("i0", (F.col("draw") - 1).cast("long").alias("draw"), "i1")


def update_weights(weights: NDFrame, changes: DataFrame) -> NDFrame:
    """Weights with those in changes (i0, i1, w) put in their place."""
    joined = weights.df.join(changes, ["i0", "i1"], "left")
    return weights.with_df(joined.select("i0", "i1", F.coalesce("w", "v").alias("v")))


def draw_and_remove(weights: NDFrame, u: DataFrame) -> tuple[DataFrame, NDFrame]:
    """An item of each row, and the weights with those put to 0."""
    drawn = draw(weights, u)
    return drawn, update_weights(weights, drawn.withColumn("w", F.lit(0).cast(weights.dtype)))


# ---- weights as one tree for each row, for many draws and changes


@dataclass(frozen=True)
class WeightTree:
    """Weights with their partial sums: (i0, tree), a row of n items being one array in which entry k (from 1) holds the
    sum of the items k - (k & -k) to k - 1. Draws and changes pass along an array and need no join of the weights; a
    row of items has to fit into one array."""

    df: DataFrame
    n: int

    def total(self) -> DataFrame:
        """(i0, total) of each row."""
        return self.df.select("i0", _prefix(self.n).alias("total"))

    def draw(self, u: DataFrame) -> DataFrame:
        """(i0, i1) as by :func:`draw`, for each row of u (i0, u); u may hold several for a row, and further columns, which
        stay. About log2(n) entries are looked at for one draw."""
        met = self.df.join(u, "i0").withColumn("__left", F.col("u") * _prefix(self.n))
        steps = [1 << b for b in reversed(range(max(1, self.n).bit_length()))]
        start = F.struct(F.lit(0).alias("at"), F.col("__left").cast("double").alias("left"))

        def down(state: Column, step: Column) -> Column:
            to = state["at"] + step
            under = F.when(to <= self.n, F.get("tree", to - 1).cast("double"))
            go = F.coalesce(under <= state["left"], F.lit(False))
            return F.when(go, F.struct(to.alias("at"), (state["left"] - under).alias("left"))).otherwise(state)

        at = F.aggregate(F.array(*map(F.lit, steps)), start, down)["at"]
        found = met.withColumn("i1", at.cast("long")).filter(_prefix(self.n) > 0)
        return found.select("i0", *(c for c in u.columns if c not in ("i0", "u")), "i1")

    def update(self, changes: DataFrame) -> WeightTree:
        """The tree with the weights in changes (i0, i1, w) put in their place; one row at most for each item. Changes are
        gathered by row and joined with the rows that have any."""
        per_row = changes.groupBy("i0").agg(F.collect_list(F.struct(F.col("i1").cast("int").alias("at"), F.col("w").alias("w"))).alias("__c"))
        met = self.df.join(per_row, "i0", "left")
        kind = self.df.schema["tree"].dataType.elementType
        deltas = F.transform("__c", lambda c: F.struct(c["at"].alias("at"), (c["w"].cast(kind) - _item(c["at"])).alias("d")))
        met = met.withColumn("__d", deltas)

        def entry(x: Column, k: Column) -> Column:
            at = k + 1
            mine = F.filter("__d", lambda d: (d["at"] <= k) & (d["at"] >= at - at.bitwiseAND(-at)))
            return x + F.aggregate(mine, F.lit(0).cast(kind), lambda a, d: (a + d["d"]).cast(kind))

        return WeightTree(met.select("i0", F.when(F.col("__d").isNull(), F.col("tree")).otherwise(F.transform("tree", entry)).alias("tree")), self.n)

    def draw_and_remove(self, u: DataFrame) -> tuple[DataFrame, WeightTree]:
        """An item of each row, and the tree in which those weigh 0."""
        drawn = self.draw(u)
        return drawn, self.update(drawn.withColumn("w", F.lit(0)))

    def weights(self) -> DataFrame:
        """(i0, i1, v): the weights that the tree holds."""
        items = F.transform(F.sequence(F.lit(0), F.lit(self.n - 1)), _item) if self.n else F.array()
        return self.df.select("i0", F.posexplode(items).alias("i1", "v")).select("i0", F.col("i1").cast("long").alias("i1"), "v")


def _prefix(upto: int) -> Column:
    """The sum of the items below a position that the driver knows."""
    at, parts = upto, []
    while at:
        parts.append(F.get("tree", F.lit(at - 1)))
        at &= at - 1
    return reduce(lambda a, b: a + b, parts) if parts else F.lit(0)


def _item(at: Column) -> Column:
    """One weight of the tree: its entry without the entries that it sums up."""
    k = at + 1
    low = k.bitwiseAND(-k)
    under = F.filter(F.array(*(F.lit(1 << b) for b in range(31))), lambda step: step < low)
    return F.get("tree", at) - F.aggregate(under, F.get("tree", at) * 0, lambda a, step: a + F.get("tree", k - step - 1))


def weight_tree(weights: NDFrame) -> WeightTree:
    """The tree of each row of weights; missing items weigh nothing. One exchange by row. Integer weights stay exact."""
    kind = "bigint" if weights.dtype in ("tinyint", "smallint", "int", "bigint") else "double"
    n = weights.shape[1]
    cells = F.sort_array(F.collect_list(F.struct("i1", F.col("v").cast(kind).alias("v"))))
    rows = weights.dense().df.groupBy("i0").agg(F.transform(cells, lambda c: c["v"]).alias("x"))
    sums = F.aggregate("x", F.array(F.lit(0).cast(kind)), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))
    rows = rows.select("i0", sums.alias("sums"))

    def entry(k: Column) -> Column:
        return F.get("sums", k) - F.get("sums", k - k.bitwiseAND(-k))

    tree = F.transform(F.sequence(F.lit(1), F.lit(n)), entry) if n else F.array().cast(f"array<{kind}>")
    return WeightTree(rows.select("i0", tree.alias("tree")), n)


def reservoir(df: DataFrame, k: int, id_col: str, weight: Column | None = None, seed: int = 0) -> DataFrame:
    """k rows at random, by weight if one is given: the least keys, which partial results of any parts keep."""
    key = exponential_key(unit(seed, id_col), weight if weight is not None else F.lit(1.0))
    return df.withColumn("__key", key).filter("__key is not null").orderBy("__key", id_col).limit(k).drop("__key")


def importance_weights(df: DataFrame, target: Column, proposal: Column) -> DataFrame:
    """Adds w, the normalised ratio of densities."""
    ratio = df.withColumn("__r", target / proposal)
    total = ratio.agg(F.sum("__r").alias("__total"))
    return ratio.crossJoin(F.broadcast(total)).withColumn("w", F.col("__r") / F.col("__total")).drop("__r", "__total")


def alias_table(weights: Sequence[float]) -> list[tuple[float, int]]:
    """(threshold, alias) of each item, for draws in constant time; for weights of one row on the driver."""
    n, total = len(weights), sum(weights)
    scaled = [w * n / total for w in weights]
    out = [(1.0, i) for i in range(n)]
    low, high = [i for i in range(n) if scaled[i] < 1], [i for i in range(n) if scaled[i] >= 1]
    while low and high:
        a, b = low.pop(), high[-1]
        out[a] = scaled[a], b
        scaled[b] -= 1 - scaled[a]
        if scaled[b] < 1:
            low.append(high.pop())
    return out


def alias_draw(table: Sequence[tuple[float, int]], u: Column) -> Column:
    """An item for u uniform in [0, 1)."""
    n = len(table)
    at = F.floor(u * n).cast("int")
    keep = F.element_at(F.array(*(F.lit(float(t)) for t, _ in table)), at + 1)
    other = F.element_at(F.array(*(F.lit(a) for _, a in table)), at + 1)
    return F.when(u * n - at < keep, at).otherwise(other)
