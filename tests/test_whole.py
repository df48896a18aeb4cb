"""The queries over whole tables against brute force, on small tables whose ids go beyond those of the slices."""

import math
from collections import defaultdict

import numpy as np
import pytest

from gridloom import catalogue
from gridloom.operators import linalg
from gridloom.plans import einsum as E
from gridloom.sources.arrays import to_tensor


def test_products_read_every_part_and_supplier(spark, tmp_path):
    lines = [(p, s, 1.0 + (p * s) % 7) for p in range(0, 1200, 7) for s in (p % 31, 5 + p % 97, 300)]
    parts = [(k, k % 3) for k in range(6000)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_size long").write.parquet(f"{tmp_path}/part.parquet")
    m = defaultdict(int)
    for p, s, q in lines:
        m[p % 500, s] += int(q)
    want = defaultdict(int)
    for (p, s), v in m.items():
        for (q, t), w in m.items():
            if p == q:
                want[s, t] += v * w
    got = {(r["s"], r["t"]): r["v"] for r in catalogue.QUERIES["gemm_part_supp"](spark, str(tmp_path)).collect()}
    assert got == want and (300, 300) in got

    logs, signs = defaultdict(float), defaultdict(lambda: 1)
    for k, size in parts:
        logs[size] += math.log(1 + k % 3)
        signs[size] *= k % 2 * 2 - 1
    got = {r["p_size"]: (r["ln_v"], r["sign"]) for r in catalogue.QUERIES["reduce_product"](spark, str(tmp_path)).collect()}
    assert got.keys() == logs.keys() and all(abs(got[k][0] - logs[k]) < 1e-5 and got[k][1] == signs[k] for k in logs)
    assert max(v for v, _ in got.values()) > 710  # beyond what a double holds as a product


N = 130


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """The quantised values of N vectors, more than any of the slices takes, and the folder of their table."""
    folder = tmp_path_factory.mktemp("vectors")
    x = np.random.default_rng(3).integers(-2000, 2000, (N, 64))
    rows = [(i, (v / 1024).tolist(), i % 10) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return x, str(folder)


def _cells(y):
    return {(*map(int, at), int(v)) for at, v in np.ndenumerate(y)}


def test_queries_read_every_vector(spark, vectors):
    x, folder = vectors
    cdf = np.cumsum(abs(x), axis=1)
    probes = np.arange(64) * 77 + abs(x)
    want = {
        "enumerate_cells": {(k, int(v)) for k, v in enumerate(x.ravel())},
        "slice_reversed": _cells(x[:, ::-1]),
        "concat": _cells(np.concatenate([x, 2 * x])),
        "broadcast_view": _cells(np.stack([x] * 3)),
        "gemm_xxt_slice": _cells(x[::2] @ x[::2].T),
        "gemm_chain": _cells(x @ x.T @ x),
        "einsum_matmul": _cells(x @ x.T),
        "searchsorted_left": _cells(np.array([np.searchsorted(c, p, "left") for c, p in zip(cdf, probes)])),
        "searchsorted_right": _cells(np.array([np.searchsorted(c, p, "right") for c, p in zip(cdf, probes)])),
    }
    for name, cells in want.items():
        got = [tuple(int(v) for v in r) for r in catalogue.QUERIES[name](spark, folder).collect()]
        assert len(got) == len(cells) and set(got) == cells, name


@pytest.mark.parametrize("spec", ["ij,jk->ik", "ij,kj->ik", "ji,jk->ki", "ij,kj->ki"])
def test_large_products_in_index_notation_go_by_blocks(spark, monkeypatch, spec):
    monkeypatch.setattr(E, "DENSE_OPS", 1)
    monkeypatch.setattr(linalg, "DENSE_OPS", 1)
    a, b = np.arange(25.0).reshape(5, 5), np.arange(25.0).reshape(5, 5) ** 2
    made = E.einsum(spec, to_tensor(spark, a.tolist(), "double"), to_tensor(spark, b.tolist(), "double"))
    assert "MapInArrow" in made.df._jdf.queryExecution().toString()
    assert (made.to_numpy() == np.einsum(spec, a, b)).all()
