"""Matrix products.

Two lowerings of alpha * A B + beta * C. In coordinate form it is an equi-join on the contracted index and a sum,
which stays in generated code and takes sparse operands as they are; it makes a row for each product before
the partial sums, so it suits sparse or thin matrices. In block form tasks multiply dense blocks with BLAS and the
exchange moves blocks; prepared blocks can be kept for several products. Where the contracted axis is short, strips of whole
rows meet instead, and the result, far larger than its operands, is never exchanged.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import NDFrame
from .views import transpose

#: Bytes of an operand below which it is broadcast.
BROADCAST_BYTES = 8 << 20
#: Products beyond which :func:`gemm` takes blocks for dense matrices of doubles.
DENSE_OPS = 1 << 27
#: Blocks to a side of the square of result blocks that is one meeting of rows and columns.
SPAN = 16
#: Rows of a strip at most, and its values at most, if that leaves 16 rows.
STRIP_ROWS, STRIP_VALUES = 1024, 1 << 20
#: The longest contracted axis that goes by strips.
STRIP_WIDTH = 1 << 16


def out_shape(a: Sequence[int], b: Sequence[int]) -> tuple[int, int]:
    if len(a) != 2 or len(b) != 2 or a[1] != b[0]:
        raise ValueError(f"{tuple(a)} times {tuple(b)}")
    return a[0], b[1]


def required_ops(a: Sequence[int], b: Sequence[int]) -> int:
    m, n = out_shape(a, b)
    return 2 * m * n * a[1]


def required_data(a: Sequence[int], b: Sequence[int]) -> int:
    """Elements read."""
    out_shape(a, b)
    return a[0] * a[1] + b[0] * b[1]


def _small(x: NDFrame) -> bool:
    return x.size * 8 <= BROADCAST_BYTES


def _hint(x: NDFrame, df: DataFrame) -> DataFrame:
    """Broadcasts an operand whose static shape bounds its size."""
    return F.broadcast(df) if _small(x) else df


def _by_blocks(a: NDFrame, b: NDFrame) -> bool:
    """Whether A B is a dense product of doubles, large enough for blocks."""
    dense = not a.sparse and not b.sparse and {a.dtype, b.dtype} <= {"double", "float"}
    return dense and a.rank == b.rank == 2 and required_ops(a.shape, b.shape) > 2 * DENSE_OPS


def gemm(
    a: NDFrame,
    b: NDFrame,
    alpha=1,
    beta=0,
    c: NDFrame | None = None,
    *,
    batch: int = 0,
    prologue: tuple[Callable[[Column], Column], Callable[[Column], Column]] | None = None,
    epilogue: Callable[[Column], Column] | None = None,
) -> NDFrame:
    """alpha * A B + beta * C, for each index of the first batch axes, which A and B share (B may lack them).

    Dense operands give a dense result. With beta = 0, C isn't read. The sum over an empty index is 0, so then
    beta * C is what is left. Integer products are BIGINT and raise on overflow. The prologue's two functions run on the
    cells of A and B in the projection before they meet, the epilogue in the one after the sum. Large dense products of
    doubles go by blocks.
    """
    if prologue is not None:
        a, b = a.map(prologue[0]), b.map(prologue[1])
    m, n = out_shape(a.shape[batch:], b.shape[b.rank - 2 :])
    shared = batch if b.rank > 2 else 0
    if shared and b.shape[:batch] != a.shape[:batch]:
        raise ValueError(f"batches {a.shape} and {b.shape}")
    wide = (lambda x: F.col(x).cast("long")) if a.dtype in ("int", "bigint") else F.col
    keys = [f"i{k}" for k in range(batch)]
    left = a.df.select(*keys, F.col(f"i{batch}").alias("m"), F.col(f"i{batch + 1}").alias("k"), wide("v").alias("x"))
    right = b.df.select(*keys[:shared], F.col(f"i{b.rank - 2}").alias("k"), F.col(f"i{b.rank - 1}").alias("n"), wide("v").alias("y"))
    if _small(b):
        right = F.broadcast(right)
    elif _small(a):
        left = F.broadcast(left)
    if not batch and _by_blocks(a, b):
        made = gemm_nt(a, transpose(b))
        terms = made.df.select(F.col("i0").alias("m"), F.col("i1").alias("n"), F.col("v").alias("s"))
    else:
        terms = left.join(right, [*keys[:shared], "k"]).groupBy(*keys, "m", "n").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    shape = (*a.shape[:batch], m, n)
    sparse = a.sparse or b.sparse or not a.shape[batch + 1]
    at = [*keys, F.col("m").alias(f"i{batch}"), F.col("n").alias(f"i{batch + 1}")]
    v = F.col("s") if alpha == 1 else F.lit(alpha) * F.col("s")
    if c is not None and beta != 0:
        if c.shape != shape:
            raise ValueError(f"C is {c.shape}, the product {shape}")
        own = c.df.select(*keys, F.col(f"i{batch}").alias("m"), F.col(f"i{batch + 1}").alias("n"), F.col("v").alias("c"))
        terms = terms.join(own, [*keys, "m", "n"], "full")
        v = F.lit(alpha) * F.coalesce("s", F.lit(0)) + F.lit(beta) * F.coalesce("c", F.lit(0))
        sparse = sparse and c.sparse
    if epilogue is not None:
        v = epilogue(v)
    out = NDFrame(terms.select(*at, v.alias("v")), shape, sparse)
    return out.dense() if sparse and not (a.sparse or b.sparse) else out


# ---- block layout


@dataclass(frozen=True)
class Blocks:
    """A matrix in dense blocks: (bi, bj, nr, nc, data), data being the block's doubles in C order."""

    df: DataFrame
    shape: tuple[int, int]
    edge: int

    def persist(self) -> Blocks:
        """Keeps the blocks for several products."""
        return Blocks(self.df.persist(), self.shape, self.edge)


def block_edge(*extents: int) -> int:
    """Edge of the blocks: 256, or less for smaller matrices; a block is at most half a megabyte."""
    return max(1, min(256, *(max(1, n) for n in extents)))


def to_blocks(x: NDFrame, edge: int | None = None) -> Blocks:
    """Packs a matrix into blocks; cells without a row are 0, blocks at the edge are cut to the shape."""
    rows, cols = x.shape
    edge = edge or block_edge(*x.shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def block():
            bi, bj = key
            one = [[bi], [bj], [held.shape[0]], [held.shape[1]], [held.tobytes()]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(one, kinds)], ["bi", "bj", "nr", "nc", "data"])

        for batch in batches:
            bi, bj, i, j, v = (np.asarray(c) for c in batch.columns)
            cuts = np.flatnonzero((bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(bi)]):
                if a == b:
                    continue
                if key != (bi[a], bj[a]):
                    if key is not None:
                        yield block()
                    key = bi[a], bj[a]
                    held = np.zeros((min(edge, rows - int(bi[a]) * edge), min(edge, cols - int(bj[a]) * edge)))
                held[i[a:b] % edge, j[a:b] % edge] = v[a:b]
        if key is not None:
            yield block()

    cells = x.df.select(
        F.expr(f"i0 div {edge}").alias("bi"), F.expr(f"i1 div {edge}").alias("bj"), "i0", "i1", F.col("v").cast("double").alias("v")
    )
    cells = cells.repartition("bi", "bj").sortWithinPartitions("bi", "bj")
    return Blocks(cells.mapInArrow(run, "bi long, bj long, nr int, nc int, data binary"), (rows, cols), edge)


def from_blocks(b: Blocks) -> NDFrame:
    edge = b.edge

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, nr, nc, data in _rows(batch):
                i, j = np.divmod(np.arange(nr * nc), nc)
                cols = [pa.array(i + bi * edge), pa.array(j + bj * edge), pa.array(np.frombuffer(data))]
                yield pa.RecordBatch.from_arrays(cols, ["i0", "i1", "v"])

    return NDFrame(b.df.mapInArrow(run, "i0 long, i1 long, v double"), b.shape, sparse=True)


def gemm_blocks(a: Blocks, b: Blocks) -> Blocks:
    """A B of matrices in blocks. Pairs of blocks meet on the contracted block index and the square of SPAN * SPAN result
    blocks that they are for, so that a short contracted axis makes tasks enough; each task multiplies its pairs and adds
    up the products that belong to one block of the result before they are exchanged."""
    if a.edge != b.edge:
        raise ValueError("block edges differ")
    shape = out_shape(a.shape, b.shape)
    kinds = "bi long, bj long, nr int, nc int, data binary"

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for bi, bj, m, k, n, x, y in _rows(batch):
                product = np.frombuffer(x).reshape(m, k) @ np.frombuffer(y).reshape(k, n)
                if (bi, bj) in held:
                    held[bi, bj] += product
                else:
                    held[bi, bj] = product
                if len(held) > 128:
                    yield _block_batch(held)
                    held = {}
        if held:
            yield _block_batch(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for bi, bj, nr, nc, data in _rows(batch):
                part = np.frombuffer(data).reshape(nr, nc)
                if key == (bi, bj):
                    total += part
                else:
                    if key is not None:
                        yield _block_batch({key: total})
                    key, total = (bi, bj), part.copy()
        if key is not None:
            yield _block_batch({key: total})

    left = a.df.select("bi", F.col("bj").alias("bk"), F.col("nr").alias("m"), F.col("nc").alias("k"), F.col("data").alias("x"))
    right = b.df.select(F.col("bi").alias("bk"), "bj", F.col("nc").alias("n"), F.col("data").alias("y"))
    on = ["bk"]
    if b.shape[0] * b.shape[1] * 8 <= BROADCAST_BYTES:
        right = F.broadcast(right)
    else:
        squares = lambda extent: F.explode(F.sequence(F.lit(0), F.lit((extent - 1) // (a.edge * SPAN))))
        left = left.withColumn("gi", F.expr(f"int(bi div {SPAN})")).withColumn("gj", squares(b.shape[1]))
        right = right.withColumn("gj", F.expr(f"int(bj div {SPAN})")).withColumn("gi", squares(a.shape[0]))
        on += ["gi", "gj"]
    pairs = left.join(right, on).select("bi", "bj", "m", "k", "n", "x", "y")
    parts = pairs.mapInArrow(multiply, kinds).repartition("bi", "bj").sortWithinPartitions("bi", "bj")
    return Blocks(parts.mapInArrow(add, kinds), shape, a.edge)


# ---- strips


def gemm_nt(a: NDFrame, b: NDFrame) -> NDFrame:
    """A B^T of matrices taken as doubles, for large results: by strips if the operands have no more values than the
    result and short rows, else by blocks. Cells without a row are 0; those of the result whose row of A or of B has no
    cell at all may be missing. Pass the same frame twice for A A^T: it is then packed once."""
    m, n = out_shape(a.shape, b.shape[::-1])
    k = a.shape[1]
    if k <= STRIP_WIDTH and (m + n) * k <= m * n:
        return _by_strips(a, b)
    edge = block_edge(m, n, k)
    return from_blocks(gemm_blocks(to_blocks(a, edge), to_blocks(transpose(b), edge)))


def strip_edge(rows: int, width: int) -> int:
    """Rows of a strip; a small matrix has 16 strips."""
    return max(1, min(STRIP_ROWS, max(16, STRIP_VALUES // max(1, width)), -(-rows // 16)))


def _strips(x: NDFrame, edge: int) -> DataFrame:
    """(ids, kind, data): strips of the rows that have cells, their numbers and values as bytes, the latter of the
    smallest kind that holds them exactly. Cells of the same place add up, as the terms of their products do."""
    k = x.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, seen = None, None, None

        def strip():
            at = np.flatnonzero(seen)
            data, kind = held[at], "<f8"
            with np.errstate(invalid="ignore"):
                for small in ("<i4", "<i2"):
                    if np.array_equal(data.astype(small), data):
                        kind = small
            cols = [[(at + key * edge).tobytes()], [kind], [data.astype(kind).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.string(), pa.binary()))], ["ids", "kind", "data"])

        for batch in batches:
            s, i, j, v = (np.asarray(c) for c in batch.columns)
            cuts = np.flatnonzero(s[1:] != s[:-1]) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(s)]):
                if lo == hi:
                    continue
                if key != s[lo]:
                    if key is not None:
                        yield strip()
                    key, held, seen = int(s[lo]), np.zeros((edge, k)), np.zeros(edge, bool)
                row = i[lo:hi] % edge
                seen[row] = True
                np.add.at(held.reshape(-1), row * k + j[lo:hi], v[lo:hi])
        if key is not None:
            yield strip()

    cells = x.df.filter("v is not null").select(F.expr(f"i0 div {edge}").alias("s"), "i0", "i1", F.col("v").cast("double").alias("v"))
    return cells.repartition("s").sortWithinPartitions("s").mapInArrow(run, "ids binary, kind string, data binary")


def _by_strips(a: NDFrame, b: NDFrame) -> NDFrame:
    """A B^T: every strip of A meets every one of B by a product of their partitions, which reads exchanged strips again
    rather than copying them, so that only the operands are on disk, once. A row of the result leaves Python as arrays
    of neighbouring cells."""
    (m, k), n = a.shape, b.shape[0]
    left = _strips(a, strip_edge(m, k))
    right = left if a is b else _strips(b, strip_edge(n, k))
    most = [max(1, -(-x // strip_edge(x, k))) for x in (m, n)]
    tasks = min(4096, max(16, m * n >> 21))
    p = min(most[0], math.isqrt(tasks - 1) + 1)
    q = min(most[1], -(-tasks // p))
    p = min(most[0], -(-tasks // q))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, kind, x, other, their, y in _rows(batch):
                i, j = np.frombuffer(own, np.int64), np.frombuffer(other, np.int64)
                x, y = (np.frombuffer(d, t).reshape(-1, k).astype(float) for d, t in ((x, kind), (y, their)))
                runs = np.r_[0, np.flatnonzero(np.diff(j) != 1) + 1]
                step = max(1, (1 << 18) // len(j))
                for at in range(0, len(i), step):
                    product = x[at : at + step] @ y.T
                    rows = len(product)
                    cuts = np.r_[(np.arange(rows)[:, None] * len(j) + runs).ravel(), rows * len(j)]
                    cells = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(product.reshape(-1)))
                    cols = [pa.array(np.repeat(i[at : at + step], len(runs))), pa.array(np.tile(j[runs], rows)), cells]
                    yield pa.RecordBatch.from_arrays(cols, ["i0", "first", "cells"])

    left, right = left.repartition(p), right.repartition(q).toDF("other", "their", "y")
    made = left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(multiply, "i0 long, first long, cells array<double>")
    cells = made.select("i0", "first", F.posexplode("cells").alias("at", "v"))
    return NDFrame(cells.select("i0", (F.col("first") + F.col("at")).alias("i1"), "v"), (m, n), sparse=True)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch; bytes as views of its memory."""
    return zip(*([x.as_buffer() for x in c] if pa.types.is_binary(c.type) else c.to_pylist() for c in batch.columns))


def _block_batch(held: dict[tuple, np.ndarray]) -> pa.RecordBatch:
    keys = list(held)
    cols = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())]
    cols += [pa.array([held[k].shape[d] for k in keys], pa.int32()) for d in (0, 1)]
    cols.append(pa.array([held[k].tobytes() for k in keys], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, ["bi", "bj", "nr", "nc", "data"])


def matmul(a: NDFrame, b: NDFrame) -> NDFrame:
    """A B of two matrices, by the lowering that suits their static shapes (see :func:`gemm`)."""
    return gemm(a, b)


def chain_order(shapes: Sequence[Sequence[int]]) -> tuple | int:
    """The cheapest bracketing of a product of matrices, as nested pairs of positions."""
    n = len(shapes)
    dims = [shapes[0][0], *(s[1] for s in shapes)]
    cost = {(i, i): (0, i) for i in range(n)}
    for span in range(1, n):
        for i in range(n - span):
            j = i + span
            cost[i, j] = min(
                (
                    (cost[i, k][0] + cost[k + 1, j][0] + dims[i] * dims[k + 1] * dims[j + 1], (cost[i, k][1], cost[k + 1, j][1]))
                    for k in range(i, j)
                ),
                key=lambda c: c[0],
            )
    return cost[0, n - 1][1]


def chain(*xs: NDFrame) -> NDFrame:
    """The product of several matrices in the cheapest order of their static shapes."""

    def go(node):
        return xs[node] if isinstance(node, int) else gemm(go(node[0]), go(node[1]))

    return go(chain_order([x.shape for x in xs]))
