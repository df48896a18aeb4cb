"""Language-model scores by masked pseudo-likelihood.

A bidirectional window network predicts every token of a text from the tokens on both of its sides; the sum of the
conditional log-probabilities scores the text. All words of all documents are counted, and all positions of all
documents train the network, once. A token is masked by being left out of its own window.

Training is dealt to *trainers*: documents go to one by a hash of id and text, in an order by that hash, and the number
of trainers follows from the count of all words. In each round its trainers start from the same weights, take their
documents' positions in blocks of numpy arithmetic, and the weights they end with are averaged. So the model depends
on the documents alone and not on how they are partitioned.

The output is a two-level softmax: a token's class given its context, and the token given class and context, classes
being runs of the vocabulary in order of frequency. That costs two products with 64 columns for a token in place of one
with 4096, and the probabilities still sum to 1. Words outside the vocabulary share a token by their length. Each has
a probability within that token: by its count in the corpus, if it is among the COUNTED most frequent of them, else
byte by byte. Over all words, of which there is no end, the probabilities sum to 1 at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, view
from .decontam import _BASE, _INVERSE, _mix, _powers

#: Classes of the vocabulary, tokens in each, tokens for words outside it, tokens seen on each side, width.
CLASSES, MEMBERS, RARE, SIDE, WIDTH = 64, 64, 16, 2, 24
VOCABULARY = CLASSES * MEMBERS
#: Stands beside the ends of a text.
PAD = VOCABULARY
#: Rounds; positions of a trainer, about; trainers in a round at most.
ROUNDS, PER_TRAINER, TRAINERS = 3, 1 << 21, 4096
#: Positions in a block, in training and in scoring; pieces in which weights are averaged.
BLOCK, PIECES = 8192, 16
RATE = 0.1
#: Words outside the vocabulary whose counts are kept, at most; weight of a byte's frequency against pairs of bytes.
COUNTED, SMOOTH = 1 << 19, 32.0
#: Counts from here on are one in the histogram that bounds COUNTED.
TOP_COUNT = 1 << 16
#: Bytes of text that are cut into tokens at a time; a longer text is cut whole.
CHUNK = 1 << 20
#: 1 letters (a-z and all bytes beyond ASCII), 2 tokens by themselves (digits, marks), 0 between tokens.
_KIND = np.array([1 if 97 <= c <= 122 or c >= 128 else 0 if c <= 32 or c == 127 else 2 for c in range(256)], np.uint8)
_POWERS = [np.zeros(0, np.uint64)] * 2


class Tokens:
    """The tokens of some texts in lower case: runs of letters, and each digit or mark by itself."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
        self.bytes = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        kind = _KIND[self.bytes]
        letter = kind == 1
        before = np.r_[False, letter[:-1]]
        self.start = np.flatnonzero((kind == 2) | (letter & ~before))
        self.end = self.start + 1
        # a space ends the last text, so each run of letters has an end
        self.end[letter[self.start]] = np.flatnonzero(~letter & before)
        bounds = np.cumsum([len(t) + 1 for t in raw]) if raw else np.zeros(0, np.int64)
        self.n = np.diff(np.searchsorted(self.start, bounds), prepend=0)
        self.hash = self._hashes()

    def __len__(self) -> int:
        return len(self.start)

    def _hashes(self) -> np.ndarray:
        n = len(self.bytes)
        if len(_POWERS[0]) < n:
            _POWERS[:] = _powers(_BASE, max(n, 2 * CHUNK)), _powers(_INVERSE, max(n, 2 * CHUNK))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.bytes * _POWERS[0][:n])])
        return _mix((sums[self.end] - sums[self.start]) * _POWERS[1][self.start])

    def words(self, at: np.ndarray) -> pa.Array:
        """The bytes of the tokens at these positions."""
        size = self.end[at] - self.start[at]
        upto = np.cumsum(size)
        flat = np.repeat(self.start[at] - (upto - size), size) + np.arange(size.sum())
        bounds = np.concatenate([[0], upto]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(self.bytes[flat].tobytes())])


def hash_of(word: bytes) -> int:
    return int(Tokens([word.decode("utf-8", "replace")]).hash[0])


def chunks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """Some rows together, CHUNK bytes or so, and their tokens."""
    for batch in batches:
        texts = batch.column(text_at)
        at = 0
        while at < batch.num_rows:
            to, held, size = at, [], 0
            while to < batch.num_rows and (to == at or size < CHUNK):
                held.append(texts[to].as_py())
                size += len(held[-1] or "") + 1
                to += 1
            yield batch.slice(at, to - at), Tokens(held)
            at = to


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n): each token of all documents and how often it occurs, a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}  # hash -> count, word; bounded

        def flush():
            words, n = [w for _, w in seen.values()], [k for k, _ in seen.values()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], ["word", "n"])

        for _, tokens in chunks(batches, 0):
            hashes, first, n = np.unique(tokens.hash, return_index=True, return_counts=True)
            for h, k, w in zip(hashes.tolist(), n.tolist(), tokens.words(first).to_pylist()):
                if (known := seen.get(h)) is not None:
                    known[0] += k
                else:
                    seen[h] = [k, w]
            if len(seen) > 300_000:
                yield flush()
        yield flush()

    counts = view(docs, text=text_col).mapInArrow(run, "word binary, n long")
    return durable(counts.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


class Vocabulary:
    """The frequent words as tokens by descending frequency, and probabilities for all others."""

    def __init__(self, top: list[tuple[bytes, int]], rare_total: np.ndarray, rare_hash: np.ndarray, rare_n: np.ndarray,
                 rare_class: np.ndarray, pairs: np.ndarray, long: tuple[int, int]):
        """top: (word, count); rare_total: count of all other words by class; rare_*: those of them that are kept;
        pairs: counts of (byte before, byte) in the others, 0 before the first; long: words of the last class and
        their bytes beyond its least."""
        # the tokens for rare words stand first: together they are frequent
        self.ids = {w: i + RARE for i, (w, _) in enumerate(top)}
        self.counts = np.ones(VOCABULARY)
        self.counts[:RARE] = rare_total + 1
        self.counts[RARE : RARE + len(top)] = [n for _, n in top]
        self.hash = np.array([hash_of(w) for w, _ in top], np.uint64)
        self.id = np.arange(RARE, RARE + len(top), dtype=np.uint16)
        order = np.argsort(self.hash)
        self.hash, self.id = self.hash[order], self.id[order]
        order = np.argsort(rare_hash)
        self.rare_hash = rare_hash[order]
        self.rare_log = np.log(rare_n / (rare_total[rare_class] + 1.0))[order].astype(np.float32)
        kept = np.bincount(rare_class, rare_n, RARE)
        self.other = np.log((rare_total - kept + 1) / (rare_total + 1.0))
        by_byte, before = pairs.sum(axis=0), pairs.sum(axis=1, keepdims=True)
        share = (by_byte + 0.5) / (by_byte.sum() + 128)
        self.pairs = np.log((pairs + SMOOTH * share) / (before + SMOOTH)).ravel()
        stop = (long[0] + 1) / (long[0] + long[1] + 2)
        self.stop, self.more = np.log(stop), np.log(1 - stop)

    def encode(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The token ids, and the log-probability of each word given its token (0 for words of the vocabulary)."""
        own = np.zeros(len(tokens))
        ids = np.minimum(tokens.end - tokens.start, RARE).astype(np.uint16) - np.uint16(1)
        if len(self.hash) and len(tokens):
            at = np.minimum(np.searchsorted(self.hash, tokens.hash), len(self.hash) - 1)
            known = self.hash[at] == tokens.hash
            ids[known] = self.id[at[known]]
        rare = np.flatnonzero(ids < RARE)
        if len(self.rare_hash) and len(rare):
            h = tokens.hash[rare]
            at = np.minimum(np.searchsorted(self.rare_hash, h), len(self.rare_hash) - 1)
            counted = self.rare_hash[at] == h
            own[rare[counted]] = self.rare_log[at[counted]]
            rare = rare[~counted]
        if len(rare):
            start, end = tokens.start[rare], tokens.end[rare]
            before = np.r_[np.uint8(0), tokens.bytes[:-1]]
            before[start] = 0
            sums = np.concatenate([[0.0], np.cumsum(self.pairs[before.astype(np.uint16) << np.uint16(8) | tokens.bytes])])
            own[rare] = sums[end] - sums[start] + self.other[ids[rare]]
            over = end - start - RARE
            own[rare[over >= 0]] += self.stop + over[over >= 0] * self.more
        return ids, own


def vocabulary_of(counts: DataFrame) -> tuple[Vocabulary, int]:
    """From (word, n); and the number of all tokens. The driver gets the frequent words, COUNTED others at most as
    hashes, and sums by byte and by length."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = [(bytes(r["word"]), r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(VOCABULARY - RARE).collect()]
    known = counts.sparkSession.createDataFrame([(w,) for w, _ in top], "word binary")
    rare = counts.join(F.broadcast(known), "word", "left_anti")
    size = F.octet_length("word")
    class_ = F.least(size, F.lit(RARE)) - 1
    rare_total, long = np.zeros(RARE), (0, 0)
    for r in rare.groupBy(class_.alias("c")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * (size - RARE)).alias("over")).collect():
        rare_total[r["c"]] = r["n"]
        if r["c"] == RARE - 1:
            long = (r["n"], r["over"])
    # the least count of which COUNTED words or fewer have as much
    seen, least = 0, TOP_COUNT + 1
    for r in sorted(rare.groupBy(F.least("n", F.lit(TOP_COUNT)).alias("k")).agg(F.count("*").alias("words")).collect(), reverse=True):
        seen += r["words"]
        if seen > COUNTED:
            break
        least = r["k"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            tokens = Tokens([w.decode("utf-8", "replace") for w in words])
            yield pa.RecordBatch.from_arrays([pa.array(tokens.hash.view(np.int64)), batch.column(1), batch.column(2)], ["h", "n", "c"])

    kept = rare.filter(F.col("n") >= least).select("word", "n", class_.alias("c")).mapInArrow(hashed, "h long, n long, c int").toArrow()

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << 16, np.int64)
        for batch in batches:
            words, n = batch.column(0).to_pylist(), np.asarray(batch.column(1))
            sizes = np.array([len(w) for w in words])
            flat = np.frombuffer(b"".join(words), np.uint8)
            before = np.r_[np.uint8(0), flat[:-1]]
            before[np.cumsum(sizes) - sizes] = 0
            # products of counts below 2 ** 53 are exact as doubles
            sums += np.bincount(before.astype(np.int64) << 8 | flat, np.repeat(n, sizes), 1 << 16).astype(np.int64)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["pair", "n"])

    pairs = np.zeros(1 << 16)
    for r in rare.select("word", "n").mapInArrow(paired, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"]] = r["n"]
    column = lambda name, kind: kept[name].to_numpy().astype(kind)
    made = Vocabulary(top, rare_total, column("h", np.int64).view(np.uint64), column("n", float), column("c", np.int64), pairs.reshape(256, 256), long)
    return made, total


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, n_tokens, own, ids): ids are 2 bytes each, little-endian; own is the sum of the words' log-probabilities
    given their tokens; key a hash of id and text."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, tokens in chunks(batches, 2):
            ids, own = known.value.encode(tokens)
            ends = np.cumsum(tokens.n)
            sums = np.concatenate([[0.0], np.cumsum(own)])
            bounds = pa.py_buffer((2 * np.concatenate([[0], ends])).astype(np.int32))
            packed = pa.Array.from_buffers(pa.binary(), len(ends), [None, bounds, pa.py_buffer(ids.astype("<u2").tobytes())])
            cols = [part.column(0), part.column(1), pa.array(tokens.n, pa.int64()), pa.array(sums[ends] - sums[ends - tokens.n]), packed]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "n_tokens", "own", "ids"])

    rows = view(docs, doc_id=id_col, key=F.xxhash64(docs[id_col], docs[text_col]), text=text_col)
    fields = T._parse_datatype_string("key long, n_tokens long, own double, ids binary").fields
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *fields]))


def initial(vocabulary: Vocabulary, seed: int = 0) -> dict[str, np.ndarray]:
    """Weights that predict each token by its frequency alone."""
    rng = np.random.default_rng(seed)
    counts = vocabulary.counts.reshape(CLASSES, MEMBERS)
    w = {
        "embed": rng.normal(0, 0.3, (VOCABULARY + 1, WIDTH)),
        "place": np.ones((2 * SIDE, WIDTH)),
        "bias": np.zeros(WIDTH),
        "class_w": rng.normal(0, 0.05, (WIDTH, CLASSES)),
        "class_b": np.log(counts.sum(axis=1) / counts.sum()),
        "member_w": rng.normal(0, 0.05, (CLASSES, WIDTH, MEMBERS)),
        "member_b": np.log(counts / counts.sum(axis=1, keepdims=True)),
    }
    return {k: v.astype(np.float32) for k, v in w.items()}


#: Where the tokens beside a position stand, from SIDE before it on.
_BESIDE = [o for o in range(2 * SIDE + 1) if o != SIDE]


class Pass:
    """A block of token ids through the network; ids has SIDE more at each end, which are context only."""

    def __init__(self, w: dict, ids: np.ndarray):
        self.w, self.ids, self.size = w, ids, len(ids) - 2 * SIDE
        self.e = w["embed"].take(ids, axis=0)
        x = np.repeat(w["bias"][None], self.size, axis=0)
        for k, o in enumerate(_BESIDE):
            x += self.e[o : o + self.size] * w["place"][k]
        goal = ids[SIDE : SIDE + self.size]
        # positions by token, so that those of a class are in a row; pads, which come last, are no goal
        order = np.argsort(goal, kind="stable")
        self.order = order = order[: np.searchsorted(goal[order], PAD)]
        self.h = np.tanh(x).take(order, axis=0)
        goal = goal[order].astype(np.int64)
        self.class_, self.member, self.row = goal // MEMBERS, goal % MEMBERS, np.arange(len(goal))
        at = np.searchsorted(self.class_, np.arange(CLASSES + 1))
        self.spans = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(at, at[1:])) if a < b]
        self.by_class = self._exp(self.h @ w["class_w"] + w["class_b"], self.class_)
        z = np.empty((len(goal), MEMBERS), self.h.dtype)
        for k, s in self.spans:
            np.matmul(self.h[s], w["member_w"][k], out=z[s])
            z[s] += w["member_b"][k]
        self.by_member = self._exp(z, self.member)

    def _exp(self, z: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """exp(z), its sums by row, and z at the goals; bounds keep float32 from overflow, and it is a softmax still."""
        np.clip(z, -60, 60, out=z)
        at_goal = z[self.row, goal]
        np.exp(z, out=z)
        return z, z @ np.ones(z.shape[1], z.dtype), at_goal

    def log_probabilities(self) -> np.ndarray:
        """log P(token | tokens beside it) of each position; 0 at pads."""
        out = np.zeros(self.size)
        (_, ps, p), (_, qs, q) = self.by_class, self.by_member
        out[self.order] = p - np.log(ps) + q - np.log(qs)
        return out

    def gradients(self) -> dict[str, tuple]:
        """Of the mean of -log P: name -> (rows that it touches, their gradient). Uses the pass up."""
        w, n, every = self.w, len(self.row), slice(None)
        (p, ps, _), (q, qs, _) = self.by_class, self.by_member
        one = np.ones(n, self.h.dtype)
        for z, s, goal in ((p, ps, self.class_), (q, qs, self.member)):
            z *= (1 / s / n)[:, None]
            z[self.row, goal] -= z.dtype.type(1 / n)
        out = {"class_w": (every, self.h.T @ p), "class_b": (every, one @ p)}
        dh = p @ w["class_w"].T
        by_weight, by_bias = np.zeros_like(w["member_w"]), np.zeros_like(w["member_b"])
        for k, s in self.spans:
            dh[s] += q[s] @ w["member_w"][k].T
            np.matmul(self.h[s].T, q[s], out=by_weight[k])
            np.matmul(one[s], q[s], out=by_bias[k])
        out |= {"member_w": (every, by_weight), "member_b": (every, by_bias)}
        dh *= 1 - self.h * self.h
        out["bias"] = every, one @ dh
        dx = np.zeros((self.size, WIDTH), dh.dtype)
        dx[self.order] = dh
        de, place = np.zeros_like(self.e), np.empty_like(w["place"])
        for k, o in enumerate(_BESIDE):
            de[o : o + self.size] += dx * w["place"][k]
            place[k] = np.einsum("ij,ij->j", dx, self.e[o : o + self.size])
        out["place"] = every, place
        order = np.argsort(self.ids, kind="stable")
        first = np.flatnonzero(np.diff(self.ids[order].astype(np.int32), prepend=-1))
        out["embed"] = self.ids[order][first], np.add.reduceat(de.take(order, axis=0), first, axis=0)
        return out


def train(w: dict, blocks: Iterator[np.ndarray]) -> tuple[dict, int]:
    """Weights after Adagrad steps over blocks of ids, and the positions seen."""
    w = {k: v.copy() for k, v in w.items()}
    squares = {k: np.full_like(v, 1e-6) for k, v in w.items()}
    n = 0
    for ids in blocks:
        step = Pass(w, ids)
        if not len(step.row):
            continue
        n += len(step.row)
        for name, (rows, g) in step.gradients().items():
            squares[name][rows] += g * g
            w[name][rows] -= RATE * g / np.sqrt(squares[name][rows])
    return w, n


def blocks_of(texts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Ids of texts, pads between them, in blocks of BLOCK positions, each with SIDE of context around; the last may
    be shorter. Every position is in one block."""
    pad = np.full(SIDE, PAD, np.uint16)
    held, size = [pad], SIDE
    for ids in texts:
        held += [ids, pad]
        size += len(ids) + SIDE
        if size >= BLOCK + 2 * SIDE:
            flat = np.concatenate(held)
            at = 0
            while at + BLOCK + 2 * SIDE <= size:
                yield flat[at : at + BLOCK + 2 * SIDE]
                at += BLOCK
            held, size = [flat[at:]], size - at
    if size > 2 * SIDE:
        yield np.concatenate(held)


def _pack(w: dict) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def _unpack(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _trained(batches: Iterator[pa.RecordBatch], w: dict) -> Iterator[pa.RecordBatch]:
    """Rows (trainer, key, ids) sorted by trainer and key -> weights in pieces, a trainer at a time."""
    rows = ((t, np.frombuffer(x.as_buffer(), "<u2")) for b in batches for t, x in zip(b.column(0).to_pylist(), b.column(2)))
    row = next(rows, None)
    while row is not None:
        trainer = row[0]

        def own() -> Iterator[np.ndarray]:
            nonlocal row
            while row is not None and row[0] == trainer:  # noqa: B023
                yield row[1]
                row = next(rows, None)

        end, n = train(w, blocks_of(own()))
        flat = np.array_split(_pack(end), PIECES)
        cols = [pa.array(range(PIECES), pa.int32()), pa.array([trainer] * PIECES, pa.int32())]
        cols += [pa.array([n] * PIECES, pa.int64()), pa.array([x.tobytes() for x in flat], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["piece", "trainer", "n", "data"])


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for piece, n, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            x = np.frombuffer(data.as_buffer(), np.float32).astype(np.float64) * n
            sums[piece] = [sums[piece][0] + x, sums[piece][1] + n] if piece in sums else [x, n]
    cols = [pa.array(list(sums), pa.int32()), pa.array([(x / n).tobytes() for x, n in sums.values()], pa.binary())]
    yield pa.RecordBatch.from_arrays(cols, ["piece", "data"])


def fit_weights(coded: DataFrame, vocabulary: Vocabulary, total: int, rounds: int = ROUNDS, seed: int = 0) -> dict:
    """The network's weights from all rows of :func:`encode_documents`. Only averages of weights reach the driver."""
    spark, weights = coded.sparkSession, initial(vocabulary, seed)
    each = min(TRAINERS, max(1, round(total / PER_TRAINER / rounds)))  # trainers in a round
    place = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(each * rounds)).cast("int")
    for turn in range(rounds):
        known = spark.sparkContext.broadcast(weights)
        share = coded.filter("n_tokens > 0").withColumn("trainer", place)
        share = share.filter(F.col("trainer") % rounds == turn).select((F.col("trainer") / rounds).cast("int").alias("trainer"), "key", "ids")
        share = share.repartitionById(each, "trainer").sortWithinPartitions("trainer", "key")
        trained = share.mapInArrow(lambda b, known=known: _trained(b, known.value), "piece int, trainer int, n long, data binary")
        trained = trained.repartition(PIECES, "piece").sortWithinPartitions("piece", "trainer")
        got = trained.mapInArrow(_average, "piece int, data binary").collect()
        if got:
            flat = np.concatenate([np.frombuffer(r["data"], np.float64) for r in sorted(got, key=lambda r: r["piece"])])
            weights = _unpack(flat, weights)
        known.unpersist()
    return weights


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, seed: int = 0) -> dict:
    """{vocabulary, weights}, from all documents. Null and empty texts teach nothing; without any words the weights
    are the initial ones. Repeated rows count as often as they stand. Documents of equal id and text have one trainer."""
    vocabulary, total = vocabulary_of(count_words(docs, text_col))
    coded = durable(encode_documents(docs, vocabulary, id_col=id_col, text_col=text_col), "lm-ids")
    return {"vocabulary": vocabulary, "weights": fit_weights(coded, vocabulary, total, rounds, seed)}


def score_ids(texts: list[np.ndarray], w: dict) -> np.ndarray:
    """Pseudo-log-likelihood of the tokens of each text."""
    parts = [Pass(w, ids).log_probabilities() for ids in blocks_of(iter(texts))]
    sizes = np.array([len(t) for t in texts], np.int64)
    sums = np.concatenate([[0.0], np.cumsum(np.concatenate(parts))]) if parts else np.zeros(1)
    # the first pads are context only, so a text starts after the texts and pads before it; pads at the end add nothing
    start = np.cumsum(sizes + SIDE) - sizes - SIDE
    last = len(sums) - 1
    return sums[np.minimum(start + sizes, last)] - sums[np.minimum(start, last)]


def score_coded(coded: DataFrame, weights: dict) -> DataFrame:
    known = coded.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                total = score_ids([np.frombuffer(x.as_buffer(), "<u2") for x in part.column(3)], known.value)
                n, own = np.asarray(part.column(1)), np.asarray(part.column(2))
                cols = [part.column(0), part.column(1), pa.array(np.where(n > 0, total + own, 0.0))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "log_likelihood"])

    rows = coded.select("doc_id", "n_tokens", "own", "ids")
    kind = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string("n_tokens long, log_likelihood double").fields])
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return rows.mapInArrow(run, kind).withColumn("mean", mean)


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean): one row for each row of docs. Null and empty texts have no
    tokens, a sum of 0 and a null mean. Whole texts are scored. An empty table gives no rows."""
    return score_coded(encode_documents(docs, model["vocabulary"], id_col=id_col, text_col=text_col), model["weights"])


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    vocabulary, total = vocabulary_of(count_words(docs, "text"))
    coded = durable(encode_documents(docs, vocabulary), "lm-ids")  # trained on and scored
    return score_coded(coded, fit_weights(coded, vocabulary, total))
