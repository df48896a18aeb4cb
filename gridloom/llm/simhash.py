"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 4 bits exactly if some 64-bit value differs from each of them in at most
2. So every distinct fingerprint emits all values within 2 bits of it, and those that meet on a value are
linked. The 2081 values of a fingerprint aren't shuffled one by one: it is sent once to each *home*, a
prefix of the values' bits, that it can reach with 2 flips, and its values there are listed on arrival.
All that meet on a value are within 4 bits of each other (the triangle inequality; verified all the same),
so a star from the least of them keeps every link without listing pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import durable, power_of_two, view
from .components import connected_components
from .decontam import apart

RADIUS = 2
#: Values that one task lists at a time, and that one partition is to get, about.
SLAB, PER_PARTITION = 1 << 22, 1 << 23
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 15


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit: sums of bytes, eight to a word, over 255 hashes at a time."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at = np.arange(0, len(bits), 255)
    return np.add.reduceat(bits.view(np.uint64), at, axis=0).view(np.uint8).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """64-bit SimHash of the shingles of width words of a UTF-8 text; a text without words has 0."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    join = b" ".join
    if len(words) <= width:
        return xxh64_intdigest(join(words), 42)
    n, ones = len(words) - width + 1, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + width - 1]
        hashes = [xxh64_intdigest(join(t), 42) for t in zip(*(part[i:] for i in range(width)))]
        ones += _ones(np.array(hashes, "<u8"))
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp): one row for each row of docs; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    rows = view(docs, doc_id=id_col, text=docs[text_col].cast("binary"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType())]))


_masks: dict[tuple[int, int], np.ndarray] = {}


def _flips(bits: int, most: int) -> np.ndarray:
    """All masks of at most so many of the lowest bits."""
    if (bits, most) not in _masks:
        every = (sum(1 << i for i in c) for k in range(most + 1) for c in combinations(range(bits), k))
        _masks[bits, most] = np.array(list(every), np.uint64)
    return _masks[bits, most]


def _count(bits: int, left: np.ndarray) -> int:
    return int(sum((left == k).sum() * len(_flips(bits, k)) for k in range(RADIUS + 1)))


def meet(fps: np.ndarray, left: np.ndarray, home: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fingerprints, the least one each is linked with) among the values whose first 64-bits bits are home,
    left being the flips that remain for the other bits. Lists at most SLAB values at a time or so: a larger
    home is split by its next bit, where each fingerprint goes to one side free and to the other for a flip."""
    if len(fps) < 2:
        return
    if bits and len(fps) > 64 and _count(bits, left) > SLAB:
        bit = (fps >> np.uint64(bits - 1)) & np.uint64(1)
        for side in (0, 1):
            rest = left - (bit != side)
            yield from meet(fps[rest >= 0], rest[rest >= 0], home << 1 | side, bits - 1)
        return
    low = fps & np.uint64((1 << bits) - 1)
    values, owner = [], []
    for k in range(RADIUS + 1):
        if len(own := np.flatnonzero(left == k)):
            masks = _flips(bits, k)
            values.append((low[own, None] ^ masks).ravel())
            owner.append(np.repeat(own, len(masks)))
    values, owner = np.concatenate(values), np.concatenate(owner)
    ranked = np.sort(values)
    shared = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(shared):
        return
    at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
    keep = shared[at] == values
    at, owner = at[keep], owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    group = np.cumsum(np.r_[False, at[1:] != at[:-1]])
    assert (np.bitwise_count(fps[owner] ^ fps[owner[first]][group]) <= 2 * RADIUS).all()
    root = np.arange(len(fps))  # positions; fps ascend, so the least position is the least fingerprint
    while True:
        before = root.copy()
        np.minimum.at(root, owner, np.minimum.reduceat(root[owner], first)[group])
        root = root[root]
        if (root == before).all():
            break
    linked = np.flatnonzero(root != np.arange(len(fps)))
    if len(linked):
        yield fps[linked], fps[root[linked]]


def links(fps: DataFrame, n: int) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints in column fp exactly as distances of 4 or less do."""
    parts = max(1, -(-n * len(_flips(64, RADIUS)) // PER_PARTITION))
    prefix = power_of_two(8 * parts, least=1 << 6, most=1 << 28).bit_length() - 1
    bits = 64 - prefix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
        if not got:
            return
        fp, home = (np.concatenate(x) for x in zip(*got))
        fp = fp.view(np.uint64)
        order = np.lexsort((fp, home))
        fp, home = fp[order], home[order]
        for s in np.split(np.arange(len(fp)), np.flatnonzero(home[1:] != home[:-1]) + 1):
            h = int(home[s[0]])
            left = RADIUS - np.bitwise_count((fp[s] >> np.uint64(bits)) ^ np.uint64(h)).astype(np.int64)
            for a, b in meet(fp[s], left, h, bits):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    masks = F.array(*(F.lit(int(m)).cast("long") for m in _flips(prefix, RADIUS)))
    sent = fps.select("fp", F.explode(masks).alias("mask")).select(
        "fp", F.shiftrightunsigned("fp", bits).bitwiseXOR(F.col("mask")).alias("home")
    )
    return sent.repartition(parts, "home").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least id reachable over links of 4 bits or less.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows repeated are kept. A null id
    is never the least unless a component has no other. An empty table gives an empty result.
    """
    rows = durable(fingerprints(docs, id_col, text_col, width), "fingerprints")
    return rows.join(components(rows), "fp").select("doc_id", "fp", "component_id")


def components(rows: DataFrame) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint among rows (doc_id, fp)."""
    fps = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    edges = links(fps.select("fp"), fps.count())
    roots = connected_components(edges).withColumnRenamed("node", "fp")
    rooted = fps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return durable(rooted.join(least, "root").select("fp", "component_id"), "fingerprint-components")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """docs with one row of each component, all columns kept: the row with the least id (a null id only
    where there is no other), and among equal ids one of those with the least hash of their text. Null and empty
    texts are linked with each other and with those of fingerprint 0. Of rows repeated one stays, as of rows that
    differ in other columns alone. An empty table gives an empty result.

    Decided on keys alone, ids and hashes of texts. Rows whose key isn't in a bit map of the keys that lose their
    rows, or have more than one, pass where they are; only the others are shuffled, for the exact decision."""
    keys = [F.xxhash64(docs[id_col], docs[text_col]).alias("k1"), F.xxhash64(F.lit(1), docs[text_col], docs[id_col]).alias("k2")]
    who = F.struct(docs[id_col].isNull().alias("no_id"), docs[id_col].alias("id"), *keys)
    rows = durable(fingerprints(view(docs, who=who, text=text_col), "who", "text", width), "fingerprints")
    kept = F.col("doc_id") == F.col("component_id")
    fate = rows.join(components(rows), "fp").groupBy("doc_id.k1", "doc_id.k2").agg(F.count("*").alias("n"), F.max(kept).alias("kept"))
    fate = durable(fate.filter("not kept or n > 1").select("k1", "k2", "kept"), "fates")
    outside, inside = apart(docs, keys, fate.select("k1"))
    open_ = inside.join(fate, ["k1", "k2"], "left")
    open_ = durable(open_.filter("kept is null or kept"), "repeated")
    # a row for each key of those that have several; any two are equal in all that counts, so the order is by the rest
    other = [F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    one = open_.filter("kept").groupBy("k1", "k2").agg(F.min_by("row", F.xxhash64(*other)).alias("row"))
    return outside.union(open_.filter("kept is null").select("row.*")).union(one.select("row.*"))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
