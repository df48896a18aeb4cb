"""Exact top-k search: BM25 over an inverted index in shards, with block-max pruning.

Each task packs its documents into shards of a bounded number of postings, without moving them. Within a shard they
are ordered by their most frequent term and length, so that a block of 64 documents is of one kind. N, document
frequencies and the average length are those of all documents, so the shards' lists merge exactly.

A shard keeps terms in a good part of its documents as rows of a matrix, in single precision, and the postings of the
others by term. Queries that a task takes together have their rare terms added up for every document, which is exact
and takes few postings. That, its greatest in a block, and the matrix' greatest impacts in a block sum to a bound for
each block: the pruning of block-max WAND, a block of documents at a time. For the blocks whose bound reaches the k-th
best score so far, common terms are one matrix product over the queries. Rounding is bounded, and what it leaves near
the k-th best is scored again in double precision.

The shards of some partitions (the square root of their number) are searched first, and the k-th best score of each
query there is what all others start from; so the lists that tasks give hardly grow with the number of tasks.

Queries go in blocks of bounded size, each broadcast and run against all shards. Only terms that occur in some
query are indexed (a bit map of bounded size tells); terms are known by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, view
from .decontam import Words, _bit_map, _inside, chunks

K1, B = 1.2, 0.75
#: Documents in a block; postings in a shard and query terms in a query block, about.
BLOCK, POSTINGS, QUERY_TERMS = 64, 1 << 22, 1 << 21
#: Queries that are run together, while they have so many scores; postings that are gathered at a time; blocks whose
#: rare terms are looked at for a first bar; a term in at least 1 of so many documents has a row in the matrix, which
#: has so many cells at most.
TOGETHER, SCORES, WORK, FIRST, COMMON, CELLS = 128, 1 << 21, 1 << 18, 2, 20, 1 << 23
#: Documents in a shard, about: many of them have few words, or none.
DOCUMENTS = 1 << 16
#: Postings that make a list long.
LONG = 128
#: Scores are compared and reported to so many decimals; equal ones go by document id.
DECIMALS = 6
_NONE = np.iinfo(np.int64).max


def _term_counts(w: Words, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of each term in each text, ordered by text and term."""
    text, term = w.text, w.hash
    if bits is not None:
        keep = _inside(bits, term)
        text, term = text[keep], term[keep]
    terms, place = np.unique(term, return_inverse=True)
    key, count = np.unique(text * len(terms) + place, return_counts=True)  # one number for both sorts much faster
    text, place = np.divmod(key, max(1, len(terms)))
    return text, terms[place], count


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, w in chunks(batches):
        text, term, count = _term_counts(w, None)
        bounds = np.searchsorted(text, np.arange(len(ids) + 1))
        terms = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(term.view(np.int64)))
        top = pa.array(_top_terms(text, term, count, len(ids)).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), top, terms], ["query_id", "top", "terms"])


def _top_terms(text: np.ndarray, term: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """The most frequent term of each of n texts, of least hash among equals; 0 if it has none. In order of
    :func:`_term_counts`."""
    out = np.zeros(n, np.uint64)
    if not len(text):
        return out
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    most = np.repeat(np.maximum.reduceat(count, first), np.diff(np.r_[first, len(text)]))
    best = np.flatnonzero(count == most)
    best = best[np.r_[True, text[best[1:]] != text[best[:-1]]]]
    out[text[best]] = term[best]
    return out


def _shards(batches: Iterator[pa.RecordBatch], bits: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = n = 0

    def shard() -> pa.RecordBatch:
        ids, lengths, tops, doc, term, count = (np.concatenate(x) for x in zip(*held))
        held.clear()
        kind = np.lexsort((lengths, tops))  # documents of a kind side by side
        ids, lengths, place = ids[kind], lengths[kind], np.argsort(kind)
        terms, inverse = np.unique(term, return_inverse=True)
        del term
        freqs = np.bincount(inverse, minlength=len(terms))
        key = inverse * max(1, len(ids)) + place[doc]
        del inverse, doc
        order = np.argsort(key)
        doc, count = (key[order] % max(1, len(ids))).astype("<i4"), count[order]
        del key, order
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (terms.view(np.int64), freqs)]
        blobs = [ids.astype("<i8"), lengths.astype("<i8"), doc, count.astype("<i4")]
        cols = [pa.array([len(ids)], pa.int64()), pa.array([int(lengths.sum())], pa.int64()), *lists]
        cols += [pa.array([x.tobytes()], pa.binary()) for x in blobs]
        return pa.RecordBatch.from_arrays(cols, ["n_docs", "n_words", "terms", "freqs", "ids", "lengths", "docs", "counts"])

    for ids, w in chunks(batches):
        text, term, count = _term_counts(w, bits)
        named = np.array([_NONE if i is None else i for i in ids], np.int64)
        held.append((named, w.n, _top_terms(text, term, count, len(ids)), (text + n).astype(np.int32), term, count.astype(np.int32)))
        size, n = size + len(term), n + len(ids)
        if size >= most or n >= DOCUMENTS:
            yield shard()
            size = n = 0
    if held:
        yield shard()


def _expand(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each pair, one after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


class Shard:
    """A shard's postings with their impacts: of rare terms by term, of common ones as a matrix and by document. Columns
    are the places of documents, up to a whole number of blocks. With weights, one for each term of the shard, impacts
    are multiplied by them."""

    def __init__(self, terms, freqs, ids, lengths, docs, counts, mean_length: float, n_shard_docs: int, weights: np.ndarray | None = None):
        self.terms = np.asarray(terms, np.int64).view(np.uint64)
        self.ids, lengths = np.frombuffer(ids, "<i8"), np.frombuffer(lengths, "<i8")
        docs, counts, freqs = np.frombuffer(docs, "<i4"), np.frombuffer(counts, "<i4"), np.asarray(freqs, np.int64)
        self.n_blocks = -(-n_shard_docs // BLOCK)
        self.width = self.n_blocks * BLOCK
        norm = K1 * (1 - B + B * lengths / mean_length)
        common = np.flatnonzero(freqs * COMMON >= n_shard_docs)
        common = common[np.argsort(-freqs[common], kind="stable")][: CELLS // max(1, n_shard_docs)]
        self.row = np.full(len(self.terms), -1)
        self.row[common] = np.arange(len(common))
        rare = self.row < 0

        def impacts(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(document, impact) of each posting of the terms that of marks."""
            mine = np.repeat(of, freqs)
            doc, tf = docs[mine], counts[mine].astype(float)
            impact = tf * (K1 + 1) / (tf + norm[doc])
            if weights is not None:
                impact *= np.repeat(weights[of], freqs[of])
            return doc, impact

        self.docs, self.impact = impacts(rare)
        self.freqs = np.where(rare, freqs, 0)
        self.start = np.cumsum(self.freqs) - self.freqs

        long = np.flatnonzero(self.freqs >= LONG)
        self.long = np.full(len(self.terms), -1)
        self.long[long] = np.arange(len(long))
        ends = zip(self.start[long].tolist(), (self.start + self.freqs)[long].tolist())
        self.lists = [(self.docs[i:j], self.impact[i:j]) for i, j in ends]

        doc, impact = impacts(~rare)
        row = np.repeat(self.row[~rare], freqs[~rare])
        self.matrix = np.zeros((len(common), self.width), np.float32)
        self.matrix[row, doc] = impact
        self.matrix_most = self.matrix.reshape(len(common), self.n_blocks, BLOCK).max(axis=2)
        order = np.argsort(doc.astype(np.uint16) if n_shard_docs <= 1 << 16 else doc, kind="stable")
        self.doc_row, self.doc_impact = row[order].astype(np.int32), impact[order]
        self.doc_start = np.searchsorted(doc[order], np.arange(n_shard_docs + 1))

    def search(self, slots: np.ndarray, weights: np.ndarray, best: list, k: int) -> tuple[list, int]:
        """:meth:`search_all` of one query, best and its result as (-rounded score, id) in order."""
        scores, ids = np.full((1, k), -np.inf), np.full((1, k), _NONE)
        for i, (s, d) in enumerate(best):
            scores[0, i], ids[0, i] = -s, d
        scored = self.search_all(np.zeros(len(slots), np.int64), slots, weights, scores, ids)
        return [(-s, d) for s, d in zip(scores[0].tolist(), ids[0].tolist()) if s > -np.inf], scored

    def _rare(self, n: int, query: np.ndarray, slots: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
        """What the rare terms add to the score of each document for each of n queries."""
        out, bounds = np.empty((n, self.width)), np.searchsorted(query, np.arange(n + 1))
        long = self.long[slots]
        spent = np.concatenate([[0], np.cumsum(np.where(long < 0, self.freqs[slots], 0))])
        q = 0
        while q < n:
            to = max(q + 1, int(np.searchsorted(spent[bounds], spent[bounds[q]] + WORK, "right")) - 1)
            mine = np.arange(bounds[q], bounds[to])
            few, many = mine[long[mine] < 0], mine[long[mine] >= 0]
            posting = _expand(self.start[slots[few]], self.freqs[slots[few]])
            doc, gain = self.docs[posting], self.impact[posting]
            if weights is not None:
                gain *= np.repeat(weights[few], self.freqs[slots[few]])
            ends = (spent[bounds[q : to + 1]] - spent[bounds[q]]).tolist()
            stops, lists = np.searchsorted(many, bounds[q : to + 1]).tolist(), [self.lists[i] for i in long[many].tolist()]
            if weights is not None:
                lists = [(d, g * w) for (d, g), w in zip(lists, weights[many].tolist())]
            for i in range(to - q):  # long lists are copied as they are, which is faster than to gather their postings
                docs = [d for d, _ in lists[stops[i] : stops[i + 1]]]
                gains = [g for _, g in lists[stops[i] : stops[i + 1]]]
                docs.append(doc[ends[i] : ends[i + 1]])
                gains.append(gain[ends[i] : ends[i + 1]])
                out[q + i] = np.bincount(np.concatenate(docs), np.concatenate(gains), self.width)
            q = to
        return out

    def _exact(self, partial: np.ndarray, dense: np.ndarray, query: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The scores of the (query, document) pairs, in doubles."""
        out = partial[query, doc]
        first = self.doc_start[doc]
        length = self.doc_start[doc + 1] - first
        spent = np.concatenate([[0], np.cumsum(length)])
        i = 0
        while i < len(doc):
            to = max(i + 1, int(np.searchsorted(spent, spent[i] + WORK, "right")) - 1)
            posting, pair = _expand(first[i:to], length[i:to]), np.repeat(np.arange(to - i), length[i:to])
            gain = dense[query[i:to][pair], self.doc_row[posting]] * self.doc_impact[posting]
            out[i:to] += np.bincount(pair, gain, to - i)
            i = to
        return out

    def search_all(self, query: np.ndarray, slots: np.ndarray, weights: np.ndarray | None, scores: np.ndarray, ids: np.ndarray) -> int:
        """Takes the documents of this shard into the best of each query, a row of rounded scores and one of ids, in
        order, -inf where there is none yet; returns for how many (query, block) pairs the bound reached the k-th best.
        Each (query, slot, weight) is a term of a query that the shard has, by query; no weights are ones."""
        (n, k), n_docs = scores.shape, len(self.ids)
        row = self.row[slots]
        common = row >= 0
        rare = ~common
        partial = self._rare(n, query[rare], slots[rare], None if weights is None else weights[rare])
        dense = np.zeros((n, len(self.matrix)))
        dense[query[common], row[common]] = 1 if weights is None else weights[common]
        single = dense.astype(np.float32)
        #: no sum of single precision is off by more than this part of it: all that is added up is positive
        off = (np.count_nonzero(dense, axis=1).max(initial=0) + 8) * 2.0**-24

        most = _block_max(partial)
        bound = most + (1 + off) * (single @ self.matrix_most)
        tie = 2 * 10**-DECIMALS
        top = np.argpartition(most, max(0, self.n_blocks - FIRST), axis=1)[:, -FIRST:]
        near = np.take_along_axis(partial.reshape(n, self.n_blocks, BLOCK), top[:, :, None], axis=1).reshape(n, -1)
        bar = np.maximum(scores[:, -1], np.maximum(_kth(most, k), _kth(near, k))) - tie
        chosen = (bound > 0) & (bound * (1 + off) >= bar[:, None])
        blocks = np.flatnonzero(chosen.any(axis=0))
        if not len(blocks):
            return 0
        if 4 * len(blocks) > 3 * self.n_blocks:
            place, score = np.arange(self.width), single @ self.matrix
            score += partial
        else:
            used = np.flatnonzero(single.any(axis=0))
            place = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            cube = self.matrix.reshape(-1, self.n_blocks, BLOCK)
            score = single[:, used] @ cube[np.ix_(used, blocks)].reshape(len(used), -1)
            score += partial.reshape(n, self.n_blocks, BLOCK)[:, blocks].reshape(n, -1)
        most = _block_max(score)
        bar = np.maximum(bar, (1 - 2 * off) * _kth(most if most.shape[1] >= k else score, k) - tie)
        bar = (np.where(bar > 0, bar * (1 - off), 0)).astype(np.float32)
        bar = np.nextafter(bar, np.float32(0))
        found = np.flatnonzero((score >= bar[:, None]) & (score > 0))
        q, doc, value = found // score.shape[1], found % score.shape[1], score.ravel()[found]
        order = np.lexsort((-value, q))  # blocks have several of the best: now that there are few, the k-th of all
        first = np.searchsorted(q, np.arange(n + 1))
        full = np.flatnonzero(np.diff(first) >= k)
        bar[full] = (1 - 4 * off) * value[order][first[full] + k - 1] - tie
        keep = value >= bar[q]
        q, doc = q[keep], place[doc[keep]]
        value = np.round(self._exact(partial, dense, q, doc), DECIMALS)
        keep = value >= scores[q, -1]
        q, doc, value = q[keep], doc[keep], value[keep]
        q, value = np.concatenate([np.repeat(np.arange(n), k), q]), np.concatenate([scores.ravel(), value])
        names = np.concatenate([ids.ravel(), self.ids[doc]])
        order = np.lexsort((names, -value, q))
        first = np.searchsorted(q[order], np.arange(n))
        order = order[first[:, None] + np.arange(k)]
        scores[:], ids[:] = value[order], names[order]
        return int(chosen.sum())


def _block_max(x: np.ndarray) -> np.ndarray:
    """The greatest of each BLOCK columns."""
    x = x.reshape(len(x), -1, BLOCK)
    while x.shape[2] > 1:  # by halves: far faster than a reduction along a short axis
        half = x.shape[2] // 2
        x = np.maximum(x[:, :, :half], x[:, :, half:])
    return x[:, :, 0]


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row, -inf if there are fewer."""
    n = x.shape[1]
    return np.partition(x, n - k, axis=1)[:, n - k].astype(float) if n >= k else np.full(len(x), -np.inf)


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 10,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_id_col: str = "doc_id",
    query_text_col: str = "text",
    postings: int = POSTINGS,
    query_terms: int = QUERY_TERMS,
) -> DataFrame:
    """(query_id, doc_id, score, rank): the k documents of highest BM25 for each row of queries.

    Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case; each different word of a
    query counts once. Documents without a word of the query aren't found. Equal scores (to 6 decimals) go by
    id, null ids last. Ids are integers. Rows repeated are documents, or queries, of their own. Null and empty
    texts have no words; empty tables give no rows.
    """
    spark = docs.sparkSession
    asked = view(queries, id=queries[query_id_col].cast("long"), text=queries[query_text_col].cast("binary"))
    asked = asked.mapInArrow(_queries, "query_id long, top long, terms array<long>").filter(F.size("terms") > 0)
    asked = durable(asked.withColumn("row", F.monotonically_increasing_id()), "queries")
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    bits = spark.sparkContext.broadcast(_bit_map(wanted, wanted.count()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _shards(batches, bits.value, postings)

    shards = durable(
        view(docs, id=docs[id_col].cast("long"), text=docs[text_col].cast("binary")).mapInArrow(
            build,
            "n_docs long, n_words long, terms array<long>, freqs array<long>, ids binary, lengths binary, docs binary, counts binary",
        ).withColumn("part", F.spark_partition_id()),
        "shards",
    )
    parts = sorted(r["part"] for r in shards.select("part").distinct().collect())
    first_parts = parts[:: isqrt(len(parts)) or 1]
    first_shards, other_shards = shards, None
    if len(first_parts) < len(parts):
        chosen = F.col("part").isin(first_parts)
        first_shards, other_shards = durable(shards.filter(chosen), "first-shards"), shards.filter(~chosen)
    n_docs, n_words = shards.agg(F.sum("n_docs"), F.sum("n_words")).first()
    n_docs, mean = n_docs or 0, max(1.0, (n_words or 0) / max(1, n_docs or 0))

    freqs = shards.select(F.explode(F.arrays_zip("terms", "freqs")).alias("x")).groupBy(F.col("x.terms").alias("term"))
    freqs = freqs.agg(F.sum("x.freqs").alias("df"))
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = (
        asked.select("row", "query_id", "top", F.explode("terms").alias("term"))
        .join(freqs, "term")
        .groupBy("row", "query_id", "top")
        .agg(F.sort_array(F.collect_list(F.struct("term", idf.alias("idf")))).alias("terms"))
    )
    # query blocks: consecutive rows with so many terms in sum; the sums are taken by partition, then over partitions
    weighted = durable(weighted.withColumn("part", F.spark_partition_id()), "weighted-queries")
    sizes = weighted.groupBy("part").agg(F.sum(F.size("terms")).alias("n")).orderBy("part").collect()
    before, at = {}, 0
    for r in sizes:
        before[r["part"]], at = at, at + r["n"]
    starts = spark.createDataFrame(list(before.items()), "part int, before long")
    upto = F.sum(F.size("terms")).over(Window.partitionBy("part").orderBy("row"))
    blocks = weighted.join(starts, "part").withColumn("block", F.floor((F.col("before") + upto - 1) / query_terms).cast("int"))
    blocks = durable(blocks.select("block", "row", "query_id", "top", "terms"), "query-blocks")

    out = None
    for number in range(-(-at // query_terms)):
        table = blocks.filter(F.col("block") == number).orderBy("top", "row").select("row", "query_id", "terms.term", "terms.idf").toArrow()
        if not table.num_rows:
            continue
        flat = lambda name: table[name].combine_chunks()  # noqa: B023, E731
        terms, first, place = np.unique(np.asarray(flat("term").values).view(np.uint64), return_index=True, return_inverse=True)
        known = spark.sparkContext.broadcast(
            (
                np.asarray(flat("row")),
                np.asarray(flat("query_id")),
                np.asarray(flat("term").offsets),
                place.astype(np.int32),
                terms,
                np.asarray(flat("idf").values)[first],
            )
        )

        def run(batches: Iterator[pa.RecordBatch], known=known, least=None) -> Iterator[pa.RecordBatch]:
            rows, ids, bounds, place, terms, idf = known.value
            floor = np.full(len(rows), -np.inf) if least is None else least.value
            scores, found = np.repeat(floor[:, None], k, axis=1), np.full((len(rows), k), _NONE)
            for batch in batches:
                for i in range(batch.num_rows):
                    held, freqs = (batch[c][i].values.to_numpy() for c in ("terms", "freqs"))
                    if not len(held):
                        continue
                    slot = np.minimum(np.searchsorted(held.view(np.uint64), terms), len(held) - 1)
                    there = held.view(np.uint64)[slot] == terms
                    weights = np.zeros(len(held))
                    weights[slot[there]] = idf[there]
                    blobs = (batch[c][i].as_buffer() for c in ("ids", "lengths", "docs", "counts"))
                    shard = Shard(held, freqs, *blobs, mean, batch["n_docs"][i].as_py(), weights)
                    together = max(1, min(TOGETHER, SCORES // shard.width))
                    for q in range(0, len(rows), together):
                        to = min(q + together, len(rows))
                        mine = place[bounds[q] : bounds[to]]
                        has = there[mine]
                        which = np.repeat(np.arange(to - q), np.diff(bounds[q : to + 1]))[has]
                        shard.search_all(which, slot[mine[has]], None, scores[q:to], found[q:to])
            q, at = np.nonzero(scores > floor[:, None])
            docs = found[q, at]
            cols = [pa.array(rows[q]), pa.array(ids[q]), pa.array(docs, mask=docs == _NONE), pa.array(scores[q, at])]
            yield pa.RecordBatch.from_arrays(cols, ["row", "query_id", "doc_id", "score"])

        result = "row long, query_id long, doc_id long, score double"
        part = durable(first_shards.mapInArrow(run, result), "found-first")
        out = part if out is None else out.union(part)
        if other_shards is None:
            continue
        kth = part.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"))))
        kth = kth.filter(F.col("rank") == k).select("row", "score").toArrow()
        by_row = np.argsort(known.value[0])
        least = np.full(len(by_row), -np.inf)
        at = by_row[np.searchsorted(known.value[0][by_row], kth["row"].to_numpy())]
        least[at] = kth["score"].to_numpy() - 1.5 * 10**-DECIMALS  # below all that tie with it, and no score itself
        least = spark.sparkContext.broadcast(least)
        part = other_shards.mapInArrow(lambda b, run=run, least=least: run(b, least=least), result)
        out = out.union(durable(part, "found"))
    if out is None:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "doc_id", "score", "rank")


def op4_topk_search(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search(docs, docs.filter("doc_id % 100 = 0"), 10)


#: The same scores without an index.
OP4_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from documents),
size as (select count(*) n, sum(coalesce(len(w), 0)) / cast(count(*) as double) mean from w),
tf as (
  select doc_id, term, count(*) tf, any_value(dl) dl from (select doc_id, unnest(w) term, len(w) dl from w) group by doc_id, term),
df as (select term, count(*) df from tf group by term),
scored as (
  select q.doc_id query_id, tf.doc_id doc_id,
    round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.dl / mean))), 6) score
  from (select doc_id, term from tf where doc_id % 100 = 0) q join tf on q.term = tf.term join df on df.term = q.term, size
  group by q.doc_id, tf.doc_id)
select query_id, doc_id, score, cast(rank as int) rank from (
  select *, row_number() over (partition by query_id order by score desc, doc_id) rank from scored) where rank <= 10
"""
