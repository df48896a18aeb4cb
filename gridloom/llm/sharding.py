"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

Documents of equal text form a group that must not be split. Groups above a share of all bytes stand
alone; the others are bundled by the hash of their text into a fixed number of bricks. The items that
remain (at most 1.25 * bricks, whatever the corpus) are differenced on the driver: each starts as a
partial partition (size, 0, ..., 0), and again and again the two partial partitions of largest spread
are added in opposite order, until one is left.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, view

#: Light groups share this many bricks; heavy ones number at most a quarter of it.
BRICKS = 16384
#: Rows that one task numbers at a time.
RUN = 50_000
#: Slots of one repeated row that a task lists at a time.
PIECE = 1 << 16


def differencing(sizes: Sequence[int], k: int) -> list[int]:
    """The bin from 0 to k-1 of each size. Ties go by position, so reruns agree.

    An item that fills a bin by itself stands alone, in a bin of the highest number left, and the others are
    differenced over the other bins: a partial partition of such an item would keep the largest spread to the
    end, and all that follow would be added to it one by one."""
    alone: dict[int, int] = {}
    left = sum(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        free = k - len(alone)
        if free == 1 or sizes[i] * free < left or not sizes[i]:
            break
        alone[i] = free - 1
        left -= sizes[i]
    if not alone:
        return _difference(sizes, k)
    others = [i for i in range(len(sizes)) if i not in alone]
    out = [alone.get(i, 0) for i in range(len(sizes))]
    for i, shard in zip(others, _difference([sizes[i] for i in others], k - len(alone))):
        out[i] = shard
    return out


def _difference(sizes: Sequence[int], k: int) -> list[int]:
    if k == 1:
        return [0] * len(sizes)
    # a partial partition: bins in descending order of size, each with a tree of the items it holds
    heap = [(-s, i, [s] + [0] * (k - 1), [i] + [None] * (k - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, sums, bins = heapq.heappop(heap)
        _, _, other, theirs = heapq.heappop(heap)
        met = sorted(
            ((a + b, i) for i, (a, b) in enumerate(zip(sums, reversed(other)))), key=lambda x: (-x[0], x[1])
        )
        pairs = list(zip(bins, reversed(theirs)))
        joined = [p if None not in (p := pairs[i]) else p[0] if p[1] is None else p[1] for _, i in met]
        heapq.heappush(heap, (met[-1][0] - met[0][0], made, [s for s, _ in met], joined))
        made += 1
    out = [0] * len(sizes)
    for shard, root in enumerate(heap[0][3] if heap else ()):
        todo = [root]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo += node
            elif node is not None:
                out[node] = shard
    return out


def shard_documents(
    docs: DataFrame, n_shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", bricks: int = BRICKS
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): each row of docs in one of n_shards.

    size is the UTF-8 length of the text plus 1. A null text counts as an empty one (size 1, CRC 0) and
    shares its group. Rows repeated are kept, each with a slot of its own; a null id is an id like any
    other. Slots run from 0 without gaps in each shard, in an order that depends on ids and texts alone.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = durable(
        view(
            docs,
            doc_id=id_col,
            size=(F.octet_length(text) + 1).cast("long"),
            text_crc32=F.crc32(text.cast("binary")),
            key=F.xxhash64(text),
        ),
        "shard-rows",
    ).withColumn("brick", F.pmod("key", F.lit(bricks)).cast("int"))

    by_brick = {r.brick: r.bytes for r in rows.groupBy("brick").agg(F.sum("size").alias("bytes")).collect()}
    total = sum(by_brick.values())
    bar = max(1, 4 * total // bricks)
    # only a brick that reaches the bar can hold a group that does
    full = [b for b, n in by_brick.items() if n >= bar]
    heavy = []
    if full:
        in_full = rows.join(F.broadcast(_frame(spark, [(b,) for b in full], "brick int")), "brick")
        groups = in_full.groupBy("brick", "key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") >= bar)
        heavy = sorted((r.key, r.brick, r.bytes) for r in groups.collect())
    for _, brick, n in heavy:
        by_brick[brick] -= n
    light = sorted(by_brick.items())
    shard = differencing([n for _, _, n in heavy] + [n for _, n in light], n_shards)

    of_key = _frame(spark, [(h[0], s) for h, s in zip(heavy, shard)], "key long, own_shard int")
    of_brick = _frame(spark, [(b[0], s) for b, s in zip(light, shard[len(heavy) :])], "brick int, its_shard int")
    placed = (  # both tables are bounded by the number of bricks
        rows.join(F.broadcast(of_key), "key", "left")
        .join(F.broadcast(of_brick), "brick", "left")
        .select("doc_id", "size", "text_crc32", "key", F.coalesce("own_shard", "its_shard").alias("shard"))
    )
    return _slots(placed, rows.count(), n_shards)


def _slots(placed: DataFrame, n_rows: int, n_shards: int) -> DataFrame:
    """Numbers the rows of each shard from 0: in runs of bounded length, each after the runs before it. Repeated
    rows are counted before they meet, so a row that stands often is one row of its run; its slots are listed
    afterwards, in pieces that different tasks take."""
    runs = max(1, n_rows // (n_shards * RUN))
    one = ["doc_id", "size", "text_crc32", "key", "shard"]
    counted = placed.groupBy(*one).agg(F.count("*").alias("n"))
    counted = counted.withColumn("run", F.pmod(F.xxhash64("doc_id", "key"), F.lit(runs)).cast("int"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counted.groupBy("shard", "run")
        .agg(F.sum("n").alias("rows"))
        .select("shard", "run", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("shard", "run").orderBy("doc_id", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("start") + F.col("upto") - F.col("n")
    numbered = counted.withColumn("upto", F.sum("n").over(within)).join(starts, ["shard", "run"])
    numbered = durable(numbered.select(*one, "n", first.cast("long").alias("first")), "shard-slots")
    often = numbered.filter(F.col("n") > PIECE)
    often = often.select(*one, "n", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))).alias("from"))
    pieces = often.repartition("key", "from").select(
        *one, F.least(F.col("n") - F.col("from"), F.lit(PIECE).cast("long")).alias("n"), (F.col("first") + F.col("from")).alias("first")
    )
    listed = numbered.filter(F.col("n") <= PIECE).unionByName(pieces)
    slot = F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot")
    return listed.select("doc_id", "size", "text_crc32", "shard", slot)


def _frame(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, T._parse_datatype_string(schema))


def op3_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs, 8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
