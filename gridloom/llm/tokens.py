"""Token ids in binary segments with Elias-Fano document boundaries.

The documents are range-sorted by id, encoded, and packed into segments of a bounded number of ids. A segment
is a self-contained binary image:

    header   magic, version, bytes per id, documents (with and without id), ids, least document id
    ends     Elias-Fano: for each document the ids up to its end
    doc ids  Elias-Fano: differences from the least
    ids      one array of little-endian unsigned integers of 2 or 4 bytes

Elias-Fano keeps the lower bits of each number packed and the upper bits as gaps in unary, with the place of
every 256th number sampled, so that any number is read in constant time (:meth:`EliasFano.select`) from about
2 + log2(mean gap) bits each, without a table of 64-bit offsets. A dataset is a Parquet folder of segments, so
that writing follows Spark's commit protocol and any store that Spark reaches will do.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import pairwise
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_path, view

#: Ids in a segment at most, but for a single longer document.
SEGMENT_IDS = 1 << 22
#: Words whose ids each Python worker remembers at most; words encoded in one call; characters of texts at a time.
REMEMBERED, TOGETHER, CHUNK = 400_000, 2048, 1 << 23
#: Marks that often follow a word.
MARKS = tuple(".,;:!?")
_HEAD = "<4sHHQQQq"
_PART = "<QQB7xQQQ"
_RATE = 256


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        gap = int(values[-1]) // n if n else 0
        bits = max(0, gap.bit_length() - 1)
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        pack = lambda x: np.packbits(x, bitorder="little")
        return cls(n, bits, pack(low.astype(np.uint8).ravel()), pack(high), ones[::_RATE].astype("<u4"))

    def all(self) -> np.ndarray:
        """The whole sequence."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, -1)
            out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def select(self, i: int) -> int:
        """The i-th number alone: from the sample before it, at most _RATE ones on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // _RATE]), i % _RATE
        byte, skip = place >> 3, place & 7
        word = int(self.high[byte]) >> skip << skip
        while word.bit_count() <= left:
            left -= word.bit_count()
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = (byte << 3) + (word & -word).bit_length() - 1
        at, low = i * self.low_bits, 0
        if self.low_bits:
            piece = int.from_bytes(self.low[at >> 3 : (at + self.low_bits + 7) >> 3].tobytes(), "little")
            low = piece >> (at & 7) & ((1 << self.low_bits) - 1)
        return (place - i) << self.low_bits | low

    def pack(self) -> bytes:
        head = struct.pack(_PART, self.n, len(self.low), self.low_bits, len(self.high), len(self.samples), 0)
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def unpack(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, n_low, bits, n_high, n_samples, _ = struct.unpack_from(_PART, data, at)
        at += struct.calcsize(_PART)
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        samples = np.frombuffer(data, "<u4", n_samples, at + n_low + n_high)
        return cls(n, bits, low, high, samples), at + n_low + n_high + 4 * n_samples


class Segment:
    """A segment, read in place."""

    MAGIC, VERSION = b"GLTS", 1

    def __init__(self, data: bytes):
        data = memoryview(data)
        magic, version, self.width, self.n_docs, self.n_null, self.n_ids, self.least = struct.unpack_from(_HEAD, data)
        if (magic, version) != (self.MAGIC, self.VERSION):
            raise ValueError("not a token segment")
        self.ends, at = EliasFano.unpack(data, struct.calcsize(_HEAD))
        self._doc_ids, at = EliasFano.unpack(data, at)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at)

    @staticmethod
    def build(doc_ids: list[int | None], parts: list[bytes], width: int) -> bytes:
        """Documents in ascending order of id, those without one first; parts: their ids as stored."""
        ends = np.cumsum([len(p) // width for p in parts])
        known = [d for d in doc_ids if d is not None]
        least = known[0] if known else 0
        offsets = np.array([d - least for d in known], np.uint64)
        head = struct.pack(
            _HEAD,
            Segment.MAGIC, Segment.VERSION, width, len(parts), len(parts) - len(known), int(ends[-1]), least
        )
        return b"".join([head, EliasFano.encode(ends).pack(), EliasFano.encode(offsets).pack(), *parts])

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + [int(x) + self.least for x in self._doc_ids.all()]

    def bounds(self, i: int) -> tuple[int, int]:
        """First id and end of the i-th document, from the select structure alone."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        start, end = self.bounds(i)
        return self.ids[start:end]


class Encoder:
    """The stored ids of texts: little-endian unsigned integers of so many bytes.

    A tokenizer that marks the ends of words, drops white space and never joins across it has each word between
    spaces encoded once, and remembers a bounded number of them; any other encodes text by text. Where the tokenizer
    folds case, which is tried on every letter of Latin-1, texts are folded before, so that fewer words differ. A text
    with the opening of a special token is encoded as it is, as folding could make one."""

    def __init__(self, tokenizer, width: int):
        self.tokenizer, self.kind = tokenizer, np.dtype(f"<u{width}")
        self.known: dict[str, bytes] = {}
        suffix = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if suffix and x.endswith(suffix)]] = True
        self.openings = tuple({x.content[:2] for x in tokenizer.get_added_tokens_decoder().values()})
        parts = ["One", "two", ",", "three", "."]
        self.by_word = bool(suffix) and self._ids("One \n two,  three.") == [i for x in parts for i in self._ids(x)]
        # a mark is a token of its own also where a letter is before it
        self.by_word = self.by_word and all(self._ids(f"one{m}") == self._ids("one") + self._ids(m) for m in MARKS)
        upper = [c for c in map(chr, range(256)) if c != c.lower()]
        self.folds = all(self._ids(f"{c}a{c} a{c}") == self._ids(f"{c}a{c} a{c}".lower()) for c in upper)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return np.array(self._ids(text), self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self.whole(x) for x in texts]
        special = {i for i, x in enumerate(texts) if any(o in x for o in self.openings)}
        folded = pa.array(["" if i in special else (_folded(x) if self.folds else x).replace("\n", " ") for i, x in enumerate(texts)], pa.large_string())
        words = pc.split_pattern(folded, " ")
        each = words.flatten().dictionary_encode()
        parts = self._parts(each.dictionary.to_pylist())
        # the stored ids of all words in a row, from those of each different one
        ids = np.frombuffer(b"".join(parts), self.kind)
        size = np.array([len(x) for x in parts], np.int64) // self.kind.itemsize
        at = np.asarray(each.indices)
        taken = size[at]
        ends = np.cumsum(taken)
        out = ids[np.repeat((np.cumsum(size) - size)[at] - (ends - taken), taken) + np.arange(taken.sum())]
        bounds = np.concatenate([[0], ends])[np.asarray(words.offsets)].tolist()
        return [self.whole(texts[i]) if i in special else out[a:b].tobytes() for i, (a, b) in enumerate(pairwise(bounds))]

    def _parts(self, words: list[str]) -> list[bytes]:
        """The ids of different words. Letters and a mark that follows them are separate tokens."""
        out = list(map(self.known.get, words))
        odd, plain = [], []
        for i, part in enumerate(out):
            if part is None:
                word = words[i]
                letters = word[:-1] if word[-1:] in MARKS else word
                if _only_letters(letters):
                    plain.append((i, letters))
                else:
                    odd.append(i)
        new = {x: self.known.get(x) for _, x in plain}
        letters = [x for x, part in new.items() if part is None]
        for k in range(0, len(letters), TOGETHER):
            new |= self._together(letters[k : k + TOGETHER])
        for i, x in plain:
            out[i] = new[x] if words[i] == x else new[x] + self._mark(words[i][-1])
        for i, x in zip(odd, self.tokenizer.encode_batch_fast([words[i] for i in odd], add_special_tokens=False)):
            out[i] = np.array(x.ids, self.kind).tobytes()
        free = max(0, REMEMBERED - len(self.known))
        self.known |= {words[i]: out[i] for i in sorted([*odd, *(i for i, _ in plain)])[:free]}
        return out

    def _mark(self, mark: str) -> bytes:
        if mark not in self.known:
            self.known[mark] = self.whole(mark)
        return self.known[mark]

    def _together(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters alone in one call. Each has one token that ends a word, and so shows where to cut."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return {w: self.whole(w) for w in words}
        data, size = ids.astype(self.kind).tobytes(), self.kind.itemsize
        return {w: data[a * size : b * size] for w, a, b in zip(words, [0, *ends.tolist()], ends.tolist())}


def _folded(text: str) -> str:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def _only_letters(word: str) -> bool:
    """Whether it is of letters, and stays so when its characters are composed and folded."""
    return word.isalpha() and (word.isascii() or normalize("NFC", word).lower().isalpha())


def _encoder(path: str, width: int) -> Encoder:
    """The worker's own tokenizer, kept from task to task."""
    from tokenizers import Tokenizer

    kept = sys.modules.setdefault("_gridloom_kept", types.ModuleType("_gridloom_kept")).__dict__
    if ("ids", path, width) not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        kept["ids", path, width] = Encoder(Tokenizer.from_file(path), width)
    return kept["ids", path, width]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of so many characters together, or of one longer text."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = t.as_py() or ""
            if texts and size + len(t) > CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(d)
            texts.append(t)
            size += len(t) + 1
    if texts:
        yield ids, texts


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    *,
    end_id: int = 1,
    width: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Writes docs as a dataset of segments in ascending order of id (nulls first; equal ids by text).

    A null or empty text has only the end id. Rows repeated are written as often. Ids are integers. width
    is the bytes per id: 2 while the vocabulary has at most 65536. An empty table gives a dataset without
    segments. tokenizer is the path of a file of the tokenizers library, there on every executor.
    """
    kind = f"<u{width}"
    end = np.array([end_id], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, width)
        task, number = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        parts: list[bytes] = []
        size = 0

        def segment() -> pa.RecordBatch:
            blob = Segment.build(doc_ids, parts, width)
            cols = [[task], [number], [len(parts)], [size // width], [blob]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)], ["task", "number", "n_docs", "n_ids", "blob"]
            )

        for ids, texts in _chunks(batches):
            for d, part in zip(ids, encoder.encode(texts)):
                part += end
                if parts and size + len(part) > segment_ids * width:
                    yield segment()
                    doc_ids, parts, size, number = [], [], 0, number + 1
                doc_ids.append(d)
                parts.append(part)
                size += len(part)
        if parts:
            yield segment()

    rows = view(docs, doc_id=docs[id_col].cast("long"), text=text_col)
    (
        rows.repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, "task int, number int, n_docs long, n_ids long, blob binary")
        .write.option("compression", "uncompressed")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document of a dataset: the ids of all documents
    before it, its own with the end id, and the CRC-32 of them as little-endian 32-bit integers."""
    columns = ["task", "number", "doc_id", "first", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task, number, blob in zip(*(c.to_pylist() for c in batch.columns)):
                s = Segment(blob)
                ends = s.ends.all().astype(np.int64)
                starts = np.r_[np.int64(0), ends[:-1]]
                wide = s.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(starts, ends)]
                same = lambda x, k: pa.array(np.full(s.n_docs, x), k)
                cols = [same(task, pa.int32()), same(number, pa.int32()), pa.array(s.doc_ids(), pa.int64())]
                cols += [pa.array(x, pa.int64()) for x in (starts, ends - starts, crc)]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[starts, ends[-1:]], pa.int32()), pa.array(wide.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, columns)

    segments = spark.read.schema("task int, number int, n_docs long, n_ids long, blob binary").parquet(path)
    before = Window.orderBy("task", "number").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select(  # a row for each segment of millions of ids
        "task", "number", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("at")
    )
    docs = segments.select("task", "number", "blob").mapInArrow(
        run,
        "task int, number int, doc_id long, first long, n_tokens long, ids_crc32 long"
        + ", ids array<int>" * with_ids,
    )
    return docs.join(starts, ["task", "number"]).select(
        "doc_id", (F.col("at") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )


def op8_token_binary(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = scratch_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer)
    return read_tokens(spark, path, with_ids=False)
