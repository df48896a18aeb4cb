"""Benchmark decontamination by winnowing.

The hash of every 4-gram of words is taken, and the least of each 5 in a row is a fingerprint: of any span of
8 words that a document shares with an item, both keep a common fingerprint. Documents' fingerprints are
first held against a bit map of the items' fingerprints, of bounded size; around those that are left, the
spans of 8 words are rebuilt and joined, word for word, with the items' spans. Items of fewer than 8 words are
one span each; as no fingerprint is certain to fall in a shorter span, each place of a document is tried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, power_of_two, view

#: Words in a span, and in a gram. Any SPAN words in a row hold KEEP grams, of which the least is a fingerprint.
SPAN, GRAM = 8, 4
KEEP = SPAN - GRAM + 1
#: Bits of a bit map: 16 for each entry, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
#: Bytes of text that are hashed at a time; a longer text is hashed whole.
CHUNK = 1 << 20

#: a-z and 0-9 as they are, A-Z in lower case, bytes beyond ASCII as they are; 0 between words.
_WORD = np.array(
    [c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8
)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_ODD = np.array([(0xD6E8FEB86659FD93 * (2 * i + 1) ^ (i << 40)) % (1 << 64) | 1 for i in range(SPAN)], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of some texts, their bounds in the folded bytes, and a hash of each."""

    def __init__(self, texts: list[bytes], powers: tuple[np.ndarray, np.ndarray]):
        lengths = np.array([len(t) + 1 for t in texts])  # a null byte ends each text and its last word
        self.bytes = _WORD[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
        inside = self.bytes != 0
        edge = np.flatnonzero(np.diff(np.r_[False, inside].astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.text = np.searchsorted(np.cumsum(lengths), self.start, "right")
        self.n = np.bincount(self.text, minlength=len(texts))
        self.first = np.cumsum(self.n) - self.n
        up, down = powers
        if len(up) < len(self.bytes):
            up, down = _powers(_BASE, len(self.bytes)), _powers(_INVERSE, len(self.bytes))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.bytes * up[: len(self.bytes)])])
        self.hash = _mix((sums[self.end] - sums[self.start]) * down[self.start])

    def grams(self, k: int) -> np.ndarray:
        """A hash of each k words in a row, across the bounds of texts too."""
        n = max(0, len(self.hash) - k + 1)
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out += self.hash[j : j + n] * _ODD[j]
        return _mix(out)

    def whole(self, k: int) -> np.ndarray:
        """Whether each k words in a row are of one text."""
        n = max(0, len(self.hash) - k + 1)
        return self.text[:n] == self.text[k - 1 : k - 1 + n]

    def span(self, at: int, k: int) -> bytes:
        b = self.bytes
        return b" ".join(b[self.start[i] : self.end[i]].tobytes() for i in range(at, at + k))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Words]]:
    """The ids and the words of a bounded number of texts at a time, each row (id, UTF-8 text)."""
    powers = _powers(_BASE, 2 * CHUNK), _powers(_INVERSE, 2 * CHUNK)
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = t.as_py() or b""
            if texts and size + len(t) > CHUNK:
                yield ids, Words(texts, powers)
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t) + 1
    if texts:
        yield ids, Words(texts, powers)


def _item_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, w in chunks(batches):
        full, grams, whole = w.grams(SPAN), w.grams(GRAM), w.whole(SPAN)
        out = [
            (ids[w.text[s]], w.span(s, SPAN), SPAN, int(full[s]), int(grams[s : s + KEEP].min()))
            for s in np.flatnonzero(whole)
        ]
        for i in np.flatnonzero((w.n > 0) & (w.n < SPAN)):
            k, s = int(w.n[i]), int(w.first[i])
            out.append((ids[i], w.span(s, k), k, int(w.grams(k)[s]), None))
        cols = list(zip(*out)) or [()] * 5
        signed = [pa.array([None if v is None else v - (v >> 63 << 64) for v in c], pa.int64()) for c in cols[3:]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int32()), *signed],
            ["item_id", "words", "k", "hash", "fingerprint"],
        )


def _bit_map(hashes: DataFrame, n: int) -> np.ndarray:
    """A bit map of the hashes in the only column; of bounded size, and so gathered on the driver."""
    bits = power_of_two(16 * n, LEAST_BITS, MOST_BITS)
    at = hashes.toDF("h").select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("i")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("w")
    )
    out = np.zeros(bits >> 6, np.int64)
    got = words.toPandas()
    out[got["i"].to_numpy(np.int64)] = got["w"].to_numpy(np.int64)
    return out.view(np.uint64)


def _inside(bit_map: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bit_map) * 64 - 1)
    return (bit_map[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def apart(docs: DataFrame, keys: list[Column], wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs in two: the rows whose first key is surely not among the longs in wanted, where they are and as they are,
    and the others as (keys, row). A bit map of bounded size tells them apart, so that only the latter have to be
    shuffled for an exact decision; with more keys than it has bits those are all rows."""
    known = docs.sparkSession.sparkContext.broadcast(_bit_map(wanted, wanted.count()))

    @F.pandas_udf("boolean")  # Python sees the keys alone, rows stay in the JVM
    def inside(key: pd.Series) -> pd.Series:
        return pd.Series(_inside(known.value, key.to_numpy(np.int64).view(np.uint64)))

    named = docs.select(*keys, F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    found = inside(named[named.columns[0]])
    return named.filter(~found).select("row.*"), named.filter(found)


def candidates(w: Words, short: list[int], marks: np.ndarray, spans: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first word, number of words) of the spans that the bit maps leave."""
    grams, whole = w.grams(GRAM), w.whole(SPAN)
    n = len(whole)
    if n:
        least = grams[:n].copy()
        for j in range(1, KEEP):
            np.minimum(least, grams[j : j + n], out=least)
        kept = np.zeros(len(grams), bool)
        for j in range(KEEP):
            kept[j : j + n] |= (grams[j : j + n] == least) & whole
        at = np.flatnonzero(kept)
        at = at[_inside(marks, grams[at])]
        if len(at):  # extend each fingerprint to the spans that hold it
            starts = np.unique(at[:, None] - np.arange(KEEP))
            starts = starts[(starts >= 0) & (starts < n)]
            starts = starts[whole[starts]]
            hashes = np.full(len(starts), SPAN, np.uint64)
            for j in range(SPAN):
                hashes += w.hash[starts + j] * _ODD[j]
            yield from ((int(s), SPAN) for s in starts[_inside(spans, _mix(hashes))])
    for k in short:
        yield from ((int(s), k) for s in np.flatnonzero(w.whole(k) & _inside(spans, w.grams(k))))


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans): for each row of docs, its words, those inside an occurrence of a
    span of an item, the ids of such items as sorted strings, and the (at, k) of the spans found.

    Null and empty texts have no words. Items with a null id or without words are left out. Rows repeated
    are kept, each with its own result; items of one id count as one. Empty tables give no rows or no hits.
    """
    spark = docs.sparkSession
    items = view(benchmark, item_id=benchmark[item_col].cast("string"), text=benchmark[item_text_col].cast("binary"))
    found = durable(
        items.filter("item_id is not null").mapInArrow(
            _item_spans, "item_id string, words binary, k int, hash long, fingerprint long"
        ),
        "item-spans",
    )
    index = durable(found.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("items")), "spans")
    hashes = found.select("hash").distinct()
    prints = found.select("fingerprint").filter("fingerprint is not null").distinct()
    marks, spans = _bit_map(prints, prints.count()), _bit_map(hashes, hashes.count())
    short = sorted(r.k for r in found.filter(F.col("k") < SPAN).select("k").distinct().collect())
    known = spark.sparkContext.broadcast((short, marks, spans))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, w in chunks(batches):
            hits: list[list] = [[] for _ in ids]
            for at, k in candidates(w, *known.value):
                i = w.text[at]
                hits[i].append({"at": int(at - w.first[i]), "k": k, "words": w.span(at, k)})
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array(w.n, pa.int64()), pa.array(hits, hit_type)],
                ["doc_id", "n_words", "hits"],
            )

    hit_type = pa.list_(pa.struct([("at", pa.int32()), ("k", pa.int32()), ("words", pa.binary())]))
    rows = view(docs, doc_id=id_col, text=docs[text_col].cast("binary"))
    id_kind = rows.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(id_kind)
    scanned = rows.mapInArrow(
        scan, f"doc_id {id_kind.simpleString()}, n_words long, hits array<struct<at:int,k:int,words:binary>>"
    )
    scanned = durable(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")
    hits = (
        scanned.filter(F.size("hits") > 0)
        .select("row", F.inline("hits"))
        .join(index, "words")
        .groupBy("row")
        .agg(
            F.sort_array(F.collect_set(F.struct("at", "k"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        )
    )
    step = "named_struct('upto', greatest(a.upto, s.at + s.k), 'n', a.n + greatest(0, s.at + s.k - greatest(a.upto, s.at)))"
    covered = f"aggregate(spans, named_struct('upto', 0, 'n', 0), (a, s) -> {step}, a -> cast(a.n as long))"
    return scanned.join(hits, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce(F.expr(covered), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<at:int,k:int>>)")).alias("spans"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, least_items: int = 1, **how) -> DataFrame:
    """docs without those in which spans of at least so many items occur, all their columns kept. A single item of
    fewer than SPAN words is no evidence by itself: then a second item or a full span has to occur too. Rows with
    the same id are kept or dropped together; rows with a null id are judged together too. Null and empty texts
    stay, repeated rows stay repeated; without items all rows stay."""
    id_col = how.get("id_col", "doc_id")
    full = F.exists("spans", lambda s: s["k"] >= SPAN)
    bad = find_overlaps(docs, benchmark, **how).filter((F.size("items") >= least_items) & (full | (F.size("items") > 1)))
    bad = durable(bad.select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    outside, inside = apart(docs, [F.xxhash64(docs[id_col]).alias("k1")], bad.select(F.xxhash64("__bad")))
    return outside.union(inside.join(bad, inside["row"][id_col].eqNullSafe(bad["__bad"]), "left_anti").select("row.*"))


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_overlaps(
        spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


#: Items' windows and the documents' words, window for window.
OP9_SQL = r"""
with iw as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark),
dw as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from documents),
iu as (
  select distinct item_id, least(len(w), 8) k, array_to_string(w[s:s + least(len(w), 8) - 1], ' ') g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) s from iw where len(w) > 0)),
ks as (select distinct k from iu),
du as (
  select doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) s from dw, ks where len(w) >= k)),
hit as (select doc_id, k, s, item_id from du join iu using (k, g)),
words as (
  select doc_id, count(distinct p) n from (select doc_id, unnest(range(s, s + k)) p from (select distinct doc_id, k, s from hit))
  group by doc_id),
items as (
  select doc_id, count(*) n, string_agg(i, ',' order by i) ids from (select distinct doc_id, cast(item_id as varchar) i from hit) group by doc_id)
select d.doc_id, coalesce(len(d.w), 0) n_words, coalesce(words.n, 0) n_hit, coalesce(items.n, 0) n_items,
  sha256(coalesce(items.ids, '')) items_sha256, coalesce(items.n, 0) >= 2 contaminated
from dw d left join words using (doc_id) left join items using (doc_id)
"""
