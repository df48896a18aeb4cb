"""Fuzzy line dedup by MinHash.

A line's character shingles give a MinHash signature, cut into bands; lines that agree on a band meet in a
bucket, and there the exact Jaccard similarity of their shingle sets decides which are linked. Components of
the links, found by distributed union-find, keep their first line in order of document and line.

Only hashes are shuffled until buckets of two or more different lines are known; the texts of those lines
alone are fetched then. Buckets with the same members are verified once. Lines are first held against the least
line of each of their buckets; only in buckets that this leaves unconnected are the others compared. A large
bucket is never gathered: the lines outside its largest component so far, in blocks of bounded size, are held
against all of its lines, which pass by one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import durable, view
from .components import connected_components

#: Characters in a shingle; bands and hashes in each: at the threshold of 0.8 a link is missed once in 1600.
SHINGLE, BANDS, ROWS, ALIKE = 8, 14, 4, 0.8  # shingles() packs 8 characters
#: Lines that are compared with each other in memory at a time.
BLOCK = 512
#: Lines that a task remembers to have seen.
REMEMBERED = 1 << 20
#: Bits of a line's map of shingles, pairs of lines whose maps are compared at a time, and rows of small buckets that
#: are looked at together, about.
MAP, PAIRS, TOGETHER = 1024, 1 << 14, 2048
#: Characters that are hashed at a time.
CHUNK = 1 << 18
_FACTORS = np.random.default_rng(7).integers(1, 1 << 32, (BANDS * ROWS, 2), np.uint64).astype(np.uint32) | np.uint32(1)


def shingles(line: str) -> set[str]:
    """The shingles of a line; a line shorter than one is its own."""
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def packed(line: str) -> np.ndarray | None:
    """The shingles of a line as numbers in order, each once: eight characters of Latin-1 are 64 bits. None for other
    lines, and for those shorter than a shingle."""
    try:
        raw = line.encode("latin-1")
    except UnicodeEncodeError:
        return None
    if len(raw) < SHINGLE:
        return None
    every = np.sort(np.ndarray(len(raw) - SHINGLE + 1, "<u8", raw, strides=(1,)))
    return every[np.r_[True, every[1:] != every[:-1]]]


def alike(a: set, b: set, least: float = ALIKE) -> bool:
    """Whether the exact Jaccard similarity is at least so much."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both)


def similar(a: str, b: str, packed_a: np.ndarray | None, packed_b: np.ndarray | None) -> bool:
    """alike() of two lines' shingles, by numbers where both are packed."""
    if packed_a is None or packed_b is None:
        return alike(shingles(a), shingles(b))
    if min(len(packed_a), len(packed_b)) < ALIKE * max(len(packed_a), len(packed_b)):
        return False
    every = np.concatenate((packed_a, packed_b))
    every.sort()
    both = np.count_nonzero(every[1:] == every[:-1])
    return both >= ALIKE * (len(every) - both)


def band_keys(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) keys; equal keys in a column are a shared bucket. Lines aren't empty."""
    out = np.empty((len(lines), BANDS), np.int64)
    at = 0
    while at < len(lines):
        to, size = at, 0
        while to < len(lines) and (to == at or size + len(lines[to]) <= CHUNK):
            size += len(lines[to]) + SHINGLE
            to += 1
        out[at:to] = _band_keys(lines[at:to])
        at = to
    return out


def _shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each SHINGLE characters in a row of all lines together, and where each line's begin and end."""
    # a line shorter than a shingle is padded by a character that no text has, so that it has one shingle
    padded = [x if len(x) >= SHINGLE else x + "\x00" * (SHINGLE - len(x)) for x in lines]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(x) for x in padded])
    n = len(codes) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[j : j + n]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    starts = np.cumsum(lengths) - lengths
    return h ^ (h >> np.uint64(32)), starts, starts + lengths - SHINGLE + 1


def _band_keys(lines: list[str]) -> np.ndarray:
    h, starts, ends = _shingle_hashes(lines)
    n, h = len(h), h.astype(np.uint32)
    # shingles across the bound of two lines are left out
    bounds = np.column_stack([starts, np.minimum(ends, n)]).ravel()
    last = bounds[-1] == n
    bounds = bounds[:-1] if last else bounds
    least = np.empty((len(lines), BANDS * ROWS), np.uint32)
    buffer = np.empty(n, np.uint32)
    for i, (a, b) in enumerate(_FACTORS):
        np.multiply(h, a, out=buffer)
        np.add(buffer, b, out=buffer)
        least[:, i] = np.minimum.reduceat(buffer, bounds)[::2]
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for r in range(ROWS):
        keys = (keys ^ least[:, r::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return (keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def bit_maps(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lines, MAP bits) maps of the lines' shingles by hash, and an upper bound of how many shingles each has."""
    maps, most = np.zeros((len(lines), MAP // 64), np.uint64), np.empty(len(lines), np.int64)
    at = 0
    while at < len(lines):
        to, size = at, 0
        while to < len(lines) and (to == at or (size + len(lines[to]) <= CHUNK and to - at < 1024)):
            size += len(lines[to]) + SHINGLE
            to += 1
        h, starts, ends = _shingle_hashes(lines[at:to])
        most[at:to] = ends - starts
        flat = np.zeros((to - at) * MAP, bool)
        size = ends - starts
        own = np.arange(size.sum()) + np.repeat(starts - (np.cumsum(size) - size), size)
        flat[np.repeat(np.arange(to - at) * MAP, size) + (h[own] & np.uint64(MAP - 1)).astype(np.int64)] = True
        maps[at:to] = np.packbits(flat.reshape(-1, MAP), axis=1, bitorder="little").view(np.uint64)
        at = to
    return maps, most


def may_be_alike(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """False only where the maps prove a similarity below ALIKE: bits of one map that the other lacks are shingles that
    the lines do not share, and J >= ALIKE allows (1 / ALIKE - 1) of these for each that they share."""
    apart = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return apart <= (1 / ALIKE - 1) * np.minimum(n_a, n_b) + 1e-9


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _line_id(line: str) -> int:
    return _signed(xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, text hash) -> a struct for each line that isn't blank; keys only where the task first sees the line, so
    that a line that is everywhere sends its keys once a task."""
    seen: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [(t or "").split("\n") for t in part.column(1).to_pylist()]
            full = [[(k, x) for k, x in enumerate(t) if x.strip()] for t in texts]
            numbers = [k for t in full for k, _ in t]
            lines = [x for t in full for _, x in t]
            ids = [_line_id(x) for x in lines]
            new = []
            for i, line in enumerate(ids):
                if line not in seen:
                    new.append(i)
                    if len(seen) < REMEMBERED:
                        seen.add(line)
            fresh = np.zeros(len(ids), bool)
            fresh[new] = True
            bounds = pa.array(np.cumsum([0, *np.where(fresh, BANDS, 0)]), pa.int32())
            keys = pa.ListArray.from_arrays(bounds, pa.array(band_keys([lines[i] for i in new]).ravel()), mask=pa.array(~fresh))
            rows = pa.StructArray.from_arrays(
                [pa.array(numbers, pa.int32()), pa.array(ids, pa.int64()), keys], ["line_no", "line", "keys"]
            )
            found = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, full)]), pa.int32()), rows)
            cols = [part.column(0), part.column(2), pa.array([len(t) for t in texts], pa.int32()), found]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "n_lines", "lines"])


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line, text) of each different line whose id is in wanted; a bit map of bounded size thins the lines first."""
    from .decontam import _bit_map, _inside

    known = docs.sparkSession.sparkContext.broadcast(_bit_map(wanted, wanted.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = known.value, set()
        for batch in batches:
            lines = [x for t in batch.column(0).to_pylist() for x in (t or "").split("\n") if x.strip()]
            ids = np.array([_line_id(x) for x in lines], np.int64)
            at = np.flatnonzero(_inside(bits, ids.view(np.uint64))) if len(ids) else []
            at = [i for i in at if not (ids[i] in seen or (len(seen) < 1 << 20 and seen.add(ids[i])))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at] if len(at) else [], pa.int64()), pa.array([lines[i] for i in at], pa.string())], ["line", "text"]
            )

    found = docs.mapInArrow(run, "line long, text string").join(wanted, "line", "left_semi")
    return found.dropDuplicates(["line"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, line) in order of bucket -> those of buckets with two different lines or more, a row once for each
    batch at least once in all."""
    held, known = None, False  # a line of the last bucket so far that isn't out, and whether others are
    last = None
    for batch in batches:
        b, line = (np.asarray(c) for c in batch.columns)
        if last is not None:
            b, line = np.r_[last, b], np.r_[held, line]
        if not len(b):
            continue
        # lines in order within their buckets, of which rows that are equal stay once
        if (b[1:] == b[:-1]).any():
            order = np.lexsort((line, b))
            b, line = b[order], line[order]
            new = np.r_[True, (b[1:] != b[:-1]) | (line[1:] != line[:-1])]
            b, line = b[new], line[new]
        like = b[1:] == b[:-1]
        shared = np.r_[False, like] | np.r_[like, False]
        if known:
            shared |= b == last
        # the last bucket may go on: one of its lines is held back, unless that is known to be in company
        held, known, last = line[-1], bool(shared[-1]), b[-1]
        yield pa.RecordBatch.from_arrays([pa.array(b[shared]), pa.array(line[shared])], ["bucket", "line"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple[int, str]]]]:
    """Rows (key..., line, text) sorted by key -> (key, row) one by one."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


class _Links:
    """Links between roots that connect lines as all links do. Maps leave few pairs of lines, and the exact similarity
    decides on those that nothing connects yet."""

    def __init__(self, texts: list[str], roots: list[int]):
        self.texts, self.roots, self.maps, self.most = texts, roots, *bit_maps(texts)
        self.up: dict[int, int] = {}
        self.packed: dict[str, np.ndarray | None] = {}
        self.found: list[tuple[int, int]] = []

    def _find(self, x: int) -> int:
        up = self.up
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    def _packed(self, text: str) -> np.ndarray | None:
        if text not in self.packed:
            self.packed[text] = packed(text)
        return self.packed[text]

    def hold(self, i: np.ndarray, j: np.ndarray) -> None:
        """Holds lines i against lines j, pair by pair."""
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            left = may_be_alike(self.maps[a], self.maps[b], self.most[a], self.most[b])
            for x, y in zip(a[left].tolist(), b[left].tolist()):
                if (p := self._find(self.roots[x])) == (q := self._find(self.roots[y])):
                    continue
                s, t = self.texts[x], self.texts[y]
                if similar(s, t, self._packed(s), self._packed(t)):
                    self.up[max(p, q)] = min(p, q)
                    self.found.append((self.roots[x], self.roots[y]))


def _compare_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, line, root, text) sorted by bucket, buckets being of bounded size: links between roots that connect
    each bucket as all its links do. Lines of one root are connected already. Some buckets are looked at together."""

    def links(rows: list[tuple], sizes: list[int]) -> pa.RecordBatch:
        found = _Links([r[3] for r in rows], [r[2] for r in rows])
        start, i, j = 0, [], []
        for n in sizes:
            a, b = np.tril_indices(n, -1)
            i.append(a + start)
            j.append(b + start)
            start += n
            if sum(map(len, i)) > PAIRS:
                found.hold(np.concatenate(i), np.concatenate(j))
                i, j = [], []
        if i:
            found.hold(np.concatenate(i), np.concatenate(j))
        return _edges(found.found)

    rows, sizes = [], []
    for _, own in groupby(_groups(batches), key=itemgetter(0)):
        before = len(rows)
        rows += own
        sizes.append(len(rows) - before)
        if len(rows) >= TOGETHER:
            yield links(rows, sizes)
            rows, sizes = [], []
    if rows:
        yield links(rows, sizes)


def _compare_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, block, order, root, text) sorted so: those with order 0 are the block, the others pass by in
    parts of its size. Links between different roots."""
    for _, rows in groupby(_groups(batches), key=lambda r: r[:2]):
        held, passing = ([], []), ([], [])
        for _, _, order, root, text in rows:
            to = passing if order else held
            to[0].append(text)
            to[1].append(root)
            if order and len(passing[0]) >= BLOCK:
                yield _edges(_block_links(*held, *passing))
                passing = [], []
        if passing[0]:
            yield _edges(_block_links(*held, *passing))


def _block_links(texts: list[str], roots: list[int], others: list[str], their_roots: list[int]) -> list[tuple[int, int]]:
    """Links between texts and others."""
    found = _Links([*texts, *others], [*roots, *their_roots])
    theirs = np.arange(len(texts), len(texts) + len(others))
    for i in range(len(texts)):
        found.hold(np.full(len(others), i), theirs)
    return found.found


def _edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*out) if out else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (line, least, text, least's text) -> (a, b) of those that are alike."""
    for batch in batches:
        line, least, text, other = (c.to_pylist() for c in batch.columns)
        _, first, which = np.unique(np.array(least, np.int64), return_index=True, return_inverse=True)
        (a, n_a), (b, n_b) = bit_maps(text), bit_maps([other[i] for i in first.tolist()])
        left = np.flatnonzero(may_be_alike(a, b[which], n_a, n_b[which]))
        out, held, its = [], None, None
        for i in left[np.argsort(which[left], kind="stable")].tolist():
            if held != least[i]:
                held, its = least[i], packed(other[i])
            if similar(text[i], other[i], packed(text[i]), its):
                out.append((line[i], least[i]))
        yield _edges(out)


def _line_roots(docs: DataFrame, lines: DataFrame, block: int) -> DataFrame:
    """(line, root) of the lines that are connected with others by links of similar lines in a bucket.

    First each line is held against the least line of each of its buckets, a pair once however many buckets it
    shares. Buckets whose lines are not connected by that are compared in full, between what isn't connected."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # work for Python, so not joined by size
    pairs = lines.select(F.explode("keys").alias("bucket"), "line").repartition("bucket")
    # by one long alone, which Spark sorts by radix
    pairs = pairs.sortWithinPartitions("bucket").mapInArrow(_shared, "bucket long, line long")
    members = durable(pairs.distinct(), "shared-buckets")
    marks = [F.min("line").alias("least"), F.max("line").alias("most"), F.count("*").alias("n")]
    marks += [F.bit_xor("line").alias("x"), F.bit_xor(F.xxhash64("line")).alias("y")]
    buckets = members.groupBy("bucket").agg(*marks)
    buckets = buckets.groupBy("least", "most", "n", "x", "y").agg(F.min("bucket").alias("bucket"))
    buckets = durable(buckets.select("bucket", "least", "n"), "line-buckets")
    members = durable(members.join(buckets, "bucket"), "bucket-members")
    texts = durable(_texts_of(view(docs, text="text"), members.select("line").distinct()), "bucket-texts")

    # a least line of a large bucket stands in several parts, each with its share of the bucket's lines
    spread = lambda n: F.ceil(F.col(n) / block).cast("int")
    pairs = members.filter("line != least").groupBy("line", "least").agg(F.max("n").alias("n"))
    least = pairs.groupBy("least").agg(F.max("n").alias("n")).select("least", F.explode(F.sequence(F.lit(0), spread("n") - 1)).alias("part"))
    least = least.join(texts.withColumnsRenamed({"line": "least", "text": "least_text"}), "least")
    pairs = pairs.select("line", "least", F.pmod("line", spread("n")).cast("int").alias("part"))
    pairs = pairs.join(texts, "line").repartition(parts, "least", "part").join(least, ["least", "part"])
    pairs = pairs.select("line", "least", "text", "least_text")
    roots = connected_components(pairs.mapInArrow(_linked, "a long, b long"))
    roots = durable(roots.withColumnRenamed("node", "line"), "line-roots")

    members = members.join(roots, "line", "left").withColumn("root", F.coalesce("root", "line"))
    # pairs with the least line are settled
    members = durable(members.filter("n > 2 and line != least").select("bucket", "line", "root", "n"), "rooted-members")
    open_ = members.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 != r1")
    rest = durable(members.join(open_.select("bucket"), "bucket"), "open-buckets")
    small = rest.filter(F.col("n") <= block).join(texts, "line").select("bucket", "line", "root", "text")
    edges = small.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_compare_small, "a long, b long")
    large = rest.filter(F.col("n") > block)
    if not large.isEmpty():
        edges = edges.union(_large_links(large, texts, block))
    joined = connected_components(edges).select(F.col("node").alias("root"), F.col("root").alias("last"))
    every = roots.select("root").union(joined.select("root")).distinct().select(F.col("root").alias("line"), "root")
    every = roots.union(every).dropDuplicates(["line"])
    return every.join(joined, "root", "left").select("line", F.coalesce("last", "root").alias("root"))


def _large_links(large: DataFrame, texts: DataFrame, block: int) -> DataFrame:
    """Links between the roots of large buckets' rows (bucket, line, root): all rows pass by blocks of those that
    aren't of the bucket's most frequent root, as of any link one end is not."""
    counts = large.groupBy("bucket", "root").agg(F.count("*").alias("rows"))
    most = counts.groupBy("bucket").agg(F.max_by("root", F.struct("rows", "root")).alias("most"))
    order = Window.partitionBy("bucket").orderBy("line")
    apart = large.join(most, "bucket").filter("root != most")
    apart = durable(
        apart.withColumn("block", F.floor((F.row_number().over(order) - 1) / block).cast("int")).select("bucket", "block", "line", "root"),
        "line-blocks",
    )
    blocks = apart.groupBy("bucket").agg((F.max("block") + 1).alias("blocks"))
    passing = large.join(blocks, "bucket").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("order"), "line", "root"
    )
    both = apart.select("bucket", "block", F.lit(0).alias("order"), "line", "root").union(passing).join(texts, "line")
    return (
        both.select("bucket", "block", "order", "root", "text")
        .repartition(int(large.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", "block")
        .sortWithinPartitions("bucket", "block", "order")
        .mapInArrow(_compare_block, "a long, b long")
    )


def find_kept_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(row, doc_id, n_lines, kept): for each row of docs its lines and the numbers, from 0, of those it keeps.

    Lines end at a line feed. Blank lines are always kept. Of each component of similar lines, among all
    documents, the line that comes first by document id (nulls last), hash of the text, row and number is kept. A null
    text is one blank line; rows repeated are rows of their own, so the later ones keep only blank lines. An empty
    table gives an empty result.
    """
    rows = view(docs, doc_id=id_col, text=text_col, text_hash=F.xxhash64(docs[text_col]))
    kind = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("text_hash bigint, n_lines int, lines array<struct<line_no:int,line:bigint,keys:array<bigint>>>").fields])
    scanned = durable(rows.mapInArrow(_scan, kind).withColumn("row", F.monotonically_increasing_id()), "lines")
    lines = scanned.select("doc_id", "text_hash", "row", F.inline("lines"))
    roots = durable(_line_roots(rows, lines.select("line", "keys"), block), "all-line-roots")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "row", "line_no")
    first = lines.groupBy("line").agg(F.min(place).alias("place"))
    first = first.join(roots, "line", "left")
    kept = first.groupBy(F.coalesce("root", "line").alias("root")).agg(F.min("place").alias("place"))
    kept = kept.groupBy("place.row").agg(F.collect_list("place.line_no").alias("numbers"))
    blank = F.expr(
        "filter(sequence(0, n_lines - 1), i -> not array_contains(transform(lines, x -> x.line_no), i))"
    )
    full = F.size("lines") == F.col("n_lines")  # then there are no blank lines to look for
    none = F.expr("cast(array() as array<int>)")
    return scanned.join(kept, "row", "left").select(
        "row",
        "doc_id",
        "n_lines",
        F.array_sort(F.concat(F.coalesce("numbers", none), F.when(full, none).otherwise(blank))).alias("kept"),
    )


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines of each text that :func:`find_kept_lines` keeps; a null text stays null. The input
    is written once, so that rows are told apart even if they are equal."""
    docs = durable(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    who = F.struct(docs[id_col].isNull().alias("no_id"), docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("hash"), "__row")
    kept = find_kept_lines(docs.select(who.alias("doc_id"), docs[text_col].alias("text")))
    kept = kept.select(F.col("doc_id.__row").alias("__row"), "kept")
    text = F.expr(f"array_join(transform(kept, i -> split(`{text_col}`, '\\n', -1)[i]), '\\n')")
    return docs.join(kept, "__row").withColumn(text_col, text).select(*[c for c in docs.columns if c != "__row"])


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = find_kept_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("kept").cast("long").alias("n_kept"), "kept"
    )
