"""Products whose result is far larger than their operands: right, and only the operands are exchanged."""

import re

import numpy as np
import pytest

from gridloom import catalogue
from gridloom.frame import NDFrame
from gridloom.operators import linalg
from gridloom.operators.views import transpose
from gridloom.plans import einsum as E
from gridloom.sources.arrays import to_tensor


def _exchanged_after(df) -> bool:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Exchange" in re.split("CartesianProduct|Join", plan)[0]


def _vectors(spark, folder, ids):
    x = np.random.default_rng(5).integers(-2000, 2000, (len(ids), 64))
    rows = [(int(i), (v / 1024).tolist(), 0) for i, v in zip(ids, x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return x


def _ints(df):
    return sorted(tuple(map(int, r)) for r in df.collect())


def test_einsum_matmul_exchanges_no_product(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(E, "DENSE_OPS", 1)
    x = _vectors(spark, tmp_path, range(300))
    df = catalogue.QUERIES["einsum_matmul"](spark, str(tmp_path))
    assert not _exchanged_after(df)
    assert _ints(df) == [(*at, int(v)) for at, v in np.ndenumerate(x @ x.T)]


@pytest.mark.parametrize("k", [1, 3])
def test_strips_of_two_matrices(spark, k):
    rng = np.random.default_rng(k)
    a, b = rng.integers(-(10**6), 10**6, (40, k)), rng.normal(size=(170, k))
    left, right = to_tensor(spark, a.tolist(), "double"), to_tensor(spark, b.tolist(), "double")
    made = linalg.gemm_nt(left, right)
    assert made.shape == (40, 170) and not _exchanged_after(made.df) and np.allclose(made.to_numpy(), a @ b.T)
    assert np.allclose(linalg.gemm_nt(right, left).to_numpy(), b @ a.T)
    with pytest.raises(ValueError):
        linalg.gemm_nt(left, transpose(right))


def test_strips_skip_absent_rows_and_add_up_repeated_cells(spark):
    rows = [(0, 0, 2.0), (0, 0, 3.0), (5, 1, 7.0), (5, 0, None), (9, 0, 1.0)]
    x = NDFrame(spark.createDataFrame(rows, "i0 long, i1 long, v double"), (10, 2), sparse=True)
    got = {(r["i0"], r["i1"]): r["v"] for r in linalg.gemm_nt(x, x).df.collect()}
    dense = {0: (5, 0), 5: (0, 7), 9: (1, 0)}
    assert got == {(p, q): a[0] * b[0] + a[1] * b[1] for p, a in dense.items() for q, b in dense.items()}


def test_strips_of_nothing(spark):
    x = NDFrame(spark.createDataFrame([], "i0 long, i1 long, v double"), (0, 5), sparse=True)
    assert linalg.gemm_nt(x, x).df.count() == 0


def test_many_strips_of_uneven_length(spark, monkeypatch):
    monkeypatch.setattr(linalg, "STRIP_ROWS", 7)
    a = np.random.default_rng(1).integers(-9, 9, (200, 2))
    x = to_tensor(spark, a.tolist(), "double")
    assert (linalg.gemm_nt(x, x).to_numpy() == a @ a.T).all()


def test_gemm_part_supp_exchanges_no_product(spark, tmp_path):
    lines = [(p, s, 1.0 + (p * s) % 50) for s in (0, 1, *range(2, 1200, 23), 1300) for p in range(s % 37, 2500, 41 + s % 5)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = catalogue.QUERIES["gemm_part_supp"](spark, str(tmp_path))
    assert not _exchanged_after(df)
    m = np.zeros((1301, 500), int)
    for p, s, q in lines:
        m[s, p % 500] += int(q)
    assert _ints(df) == [(*at, int(v)) for at, v in np.ndenumerate(m @ m.T) if v]


def test_gemm_xxt_slice_exchanges_no_product(spark, tmp_path):
    x = _vectors(spark, tmp_path, range(301))[::2]
    df = catalogue.QUERIES["gemm_xxt_slice"](spark, str(tmp_path))
    assert not _exchanged_after(df)
    assert _ints(df) == [(*at, int(v)) for at, v in np.ndenumerate(x @ x.T)]
