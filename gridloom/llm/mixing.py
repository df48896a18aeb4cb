"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, followed by a second pass over the same.
A document's virtual finish time is the queue's words up to and with it, divided by the source's
target. All queues are served by virtual finish time until the budget is used. What a source gives is
a prefix of its queue, so the decision is a cut per source, and whether a document is taken follows
from its own columns. Equal rows are numbered first, and each number has a place of its own in the queue.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_WORDS, durable, power_of_two, view

#: Passes over a source at most.
PASSES = 2
#: Documents whose words are summed in one task at a time, about.
RUN = 2_000
#: Bins of the histograms that find the cut, and rows that may be sorted on the driver at the end of it.
BINS, LAST_ROWS = 65_536, 10_000
#: Sources at most: their sizes and targets are held on the driver and sent to the tasks.
MOST_SOURCES = 100_000


def targets(sizes: list[int], weights: list[int], budget: Fraction, most: int = PASSES) -> list[Fraction]:
    """Shares of the budget by weight, none above most times its size, the excess reshared by weight."""
    out: list[Fraction | None] = [None] * len(sizes)
    left = budget
    open_ = list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] > most * sizes[i] * total]
        if not above:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if out[i] is None]
    return [x or Fraction(0) for x in out]


def same_key(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> Column:
    """A hash of id, text and source, which rows that are equal in them share."""
    return F.xxhash64(F.lit(seed), docs[id_col], docs[text_col], docs[source_col])


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORDS)), F.lit(0)).cast("long")


def plan_mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (3, 1, 2),
    share: Fraction = Fraction(3, 2),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, queue, cuts): the documents with their places, those with words with their words so far in
    the queue of their source, and one row for each source with its cuts.

    Sources go by code point, null last, and weigh the given weights in turn; the list of sources is held
    on the driver, the documents never, and more than MOST_SOURCES are refused. Null texts have no words. Sources
    without words get nothing. Rows repeated are documents of their own: how many of them are taken is the same in
    each run. An empty table gives empty results.
    """
    narrow = view(
        docs,
        doc_id=id_col,
        source=source_col,
        size=words_in(docs[text_col]),
        key=same_key(docs, id_col, text_col, source_col, seed),
    )
    return _plan(narrow.withColumn("row", F.monotonically_increasing_id()), weights, share)


def _plan(narrow: DataFrame, weights: tuple[int, ...], share: Fraction) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (doc_id, source, size, key, row), row being a number that tells them apart."""
    spark = narrow.sparkSession
    rows = durable(_placed(durable(narrow, "mix-input")), "mix-rows")
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    sums = found.limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    sums.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in sums]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sums))], share * sum(sizes))
    schema = T.StructType(
        [
            T.StructField("source", T.StringType()),
            T.StructField("rank", T.IntegerType()),
            T.StructField("source_size", T.LongType()),
            T.StructField("target", T.DoubleType()),
        ]
    )
    known = spark.createDataFrame(
        [(r["source"], i, r["size"], float(goal[i])) for i, r in enumerate(sums)], schema
    )
    queue = durable(_queue(rows, known, sum(r["n"] for r in sums)), "mix-queue")
    cut = _cut(queue, int(share * sum(sizes)))
    accepted = [
        F.max(F.when(_served(p, cut), F.struct("place", "doc_id", "size"))).alias(f"cut{p}") for p in range(PASSES)
    ]
    cuts = queue.groupBy("rank").agg(*accepted)
    return rows, queue, known.join(cuts, "rank", "left")


def _placed(rows: DataFrame) -> DataFrame:
    """Adds place, non-negative: a hash of the key and a number among the rows of that key. Those of one key are
    numbered in parts, each of the rows of one input task, so that no task has to hold a key that is everywhere."""
    part = F.shiftright("row", 33)  # as monotonically_increasing_id builds it
    rows = rows.withColumn("part", part)
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("key", "part").agg(F.count("*").alias("n"))
    starts = parts.select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).filter("start > 0")
    within = Window.partitionBy("key", "part").orderBy("row")
    number = F.coalesce("start", F.lit(0)) + F.row_number().over(within)
    return rows.join(starts, ["key", "part"], "left").select(
        "doc_id", "source", "size", "row", F.shiftrightunsigned(F.xxhash64("key", number), 1).alias("place")
    )


def _queue(rows: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """Adds each document's words up to and with it in its queue. No task holds a whole source: a queue is
    cut into stretches of the shuffle key, each summed alone and set after the stretches before it."""
    bits = power_of_two(n / RUN, most=1 << 20).bit_length() - 1
    cells = rows.filter("size > 0").withColumn("cell", F.expr(f"cast(shiftright(place, {63 - bits}) as int)"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    cells = cells.join(known, same(cells, known)).drop(known["source"]).drop("source")
    before = Window.partitionBy("rank").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cells.groupBy("rank", "cell")
        .agg(F.sum("size").alias("words"))
        .select("rank", "cell", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("rank", "cell").orderBy("place", "doc_id", "size")
    return (
        cells.withColumn("here", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .join(starts, ["rank", "cell"])
        .withColumn("upto", F.col("start") + F.col("here"))
        .select("doc_id", "size", "row", "place", "rank", "source_size", "target", "upto")
    )


def finish(number: int) -> Column:
    """Virtual finish time of a document in the pass of this number."""
    return (F.col("upto") + F.lit(number) * F.col("source_size")) / F.col("target")


def _cut(queue: DataFrame, budget: int) -> tuple[float, int] | None:
    """The last (virtual finish time, source) that the budget allows; None if it allows none.

    A histogram of the finish times finds the bin in which the budget ends, and then a finer one of that
    bin, until few enough rows are left to sort. Ties within one finish time number one per source at most."""
    items = queue.filter("target > 0").select(
        F.explode(F.array(*(F.struct(finish(p).alias("v"), "rank", "size") for p in range(PASSES)))).alias("x")
    ).select("x.*")
    low, high, used = 0.0, items.agg(F.max("v")).first()[0], 0
    if high is None:
        return None
    while True:
        inside = items.filter(F.col("v").between(low, high))
        width = (high - low) / BINS
        bin_ = F.least(F.floor((F.col("v") - low) / F.lit(width)), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        counts = (
            inside.groupBy(bin_.cast("int").alias("bin"))
            .agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            .collect()
        )
        last = None
        for r in sorted(counts, key=lambda r: r["bin"]):
            last = r
            if used + r["words"] > budget:
                break
            used += r["words"]
        else:
            return (last["high"], 1 << 30)
        if last["n"] <= LAST_ROWS or last["low"] == last["high"]:
            break
        low, high = last["low"], last["high"]
    best = None
    for r in items.filter(F.col("v").between(last["low"], last["high"])).orderBy("v", "rank").collect():
        used += r["size"]
        if used > budget:
            return best or (last["low"], -1)
        best = (r["v"], r["rank"])
    return best


def _served(number: int, cut: tuple[float, int] | None) -> Column:
    if cut is None:
        return F.lit(False)
    v = finish(number)
    return (F.col("target") > 0) & ((v < cut[0]) | ((v == cut[0]) & (F.col("rank") <= cut[1])))


def passes_taken(place: Column, doc_id: Column, size: Column) -> Column:
    """How often a document is taken, from its place and its source's cuts."""
    here = F.struct(place.alias("place"), doc_id.alias("doc_id"), size.alias("size"))
    taken = [F.coalesce(here <= F.col(f"cut{p}"), F.lit(False)).cast("int") for p in range(PASSES)]
    return sum(taken[1:], taken[0])


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = (3, 1, 2),
    share: Fraction = Fraction(3, 2),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 0,
) -> DataFrame:
    """The mixed corpus: all columns of docs, a document that is taken twice twice, range-sorted by virtual
    finish time. Documents without words are not mixed; see :func:`plan_mix` for the other cases. The input is
    written once, so that rows are told apart even if they are equal; the plan reads its narrow columns only."""
    key = same_key(docs, id_col, text_col, source_col, seed).alias("key")
    columns = {"doc_id": docs[id_col], "source": docs[source_col], "size": words_in(docs[text_col])}
    whole = docs.select(
        *(c.alias(name) for name, c in columns.items()), key, F.struct(*(docs[c] for c in docs.columns)).alias("whole")
    )
    whole = durable(whole.withColumn("row", F.monotonically_increasing_id()), "mix-whole")
    _, queue, cuts = _plan(whole.drop("whole"), weights, share)
    orders = (
        queue.join(F.broadcast(cuts.drop("source", "source_size", "target")), "rank")  # a row for each source
        .withColumn("taken", passes_taken(F.col("place"), F.col("doc_id"), F.col("size")))
        .filter("taken > 0")
        .select("row", F.explode(F.slice(F.array(*(finish(p) for p in range(PASSES))), F.lit(1), F.col("taken"))).alias("time"))
    )
    orders = durable(orders, "mix-orders")
    # bounds of the ranges from the narrow times, so that the texts need not be read for a sample of them
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = orders.select(F.percentile_approx("time", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    bounds = np.array(sorted(set(bounds or [])))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("part", pa.array(np.searchsorted(bounds, np.asarray(batch.column(1))), pa.int32()))

    orders = orders.mapInArrow(dealt, "row long, time double, part int")
    return (
        whole.select("row", "whole")
        .join(orders.hint("shuffle_hash"), "row")  # row is unique, so the narrow side is dealt evenly
        .repartitionById(len(bounds) + 1, "part")
        .sortWithinPartitions("time")
        .select("whole.*")
    )


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, _, cuts = plan_mix(docs)
    cuts = cuts.withColumnRenamed("source", "its_source")
    joined = rows.join(cuts, rows["source"].eqNullSafe(cuts["its_source"]))
    passes = passes_taken(F.col("place"), F.col("doc_id"), F.col("size"))
    return joined.select(
        "doc_id", "size", "source_size", "target", (passes * F.col("size")).cast("long").alias("taken")
    )
