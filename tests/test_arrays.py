"""Construction, views, elementwise loops, reductions, sampling, stencils and small functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.frame import NDFrame, strides_of
from gridloom.functions import chunking, tape
from gridloom.functions import math as M
from gridloom.operators import elementwise, reduce, sampling, stencil, views
from gridloom.sources import arrays as S


def frame(spark, a, dtype="double"):
    return S.to_tensor(spark, np.asarray(a).tolist(), dtype)


def test_construction(spark, tmp_path):
    zero = S.new_tensor(spark, 2, 3)
    assert zero.to_numpy().tolist() == [[0, 0, 0], [0, 0, 0]] and zero.rank == 2 and zero.size == 6
    assert zero.set((0, 0), 100).to_numpy()[0].tolist() == [100, 0, 0] and zero.to_numpy()[0, 0] == 0
    assert strides_of((2, 3)) == (3, 1) and strides_of((4, 2, 3)) == (6, 3, 1)
    for ragged in ([[1, 2], [3]], [[1, 2, 3], [4]], [[1], 2]):
        with pytest.raises(IndexError):
            S.to_tensor(spark, ragged)
    with pytest.raises(ValueError):
        S.from_values(spark, [1, 2, 3], (2, 2))
    with pytest.raises(ValueError):
        S.new_tensor(spark, 1, 1, 1, 1, 1, 1, 1)
    x = frame(spark, [[1, 2], [3, 4]])
    S.to_parquet(x, str(tmp_path / "x"), order=True)
    assert S.from_parquet(spark, str(tmp_path / "x"), (2, 2)).to_numpy().tolist() == [[1, 2], [3, 4]]
    assert S.copy_from(S.new_tensor(spark, 3, 3), x, (1, 1)).to_numpy().tolist() == [[0, 0, 0], [0, 1, 2], [0, 3, 4]]
    assert (S.deep_copy(x).to_numpy() == x.to_numpy()).all() and not S.set_zero(x).to_numpy().any()
    assert S.to_tensor(spark, ["ab", "c"], "string").shape == (2,)
    assert "1." in S.pretty(x)
    got = spark.range(1).select(S.to_hex(F.lit(b"\x01\xab").cast("binary")).alias("h")).first()["h"]
    assert got == "01 ab"


def test_views(spark):
    a = np.arange(24).reshape(2, 3, 4)
    x = frame(spark, a, "bigint")
    same = lambda y, b: np.testing.assert_array_equal(y.to_numpy(), b)
    same(views.transpose(x), a.T)
    same(views.transpose(views.transpose(x)), a)
    same(views.slice_(x, 1, slice(None, None, 2), slice(3, None, -2)), a[1:2, ::2, 3::-2])
    same(views.slice_(x, slice(5, 9)), a[5:9])
    same(views.reshape(x, 4, 6), a.reshape(4, 6))
    same(views.concat([x, x], 1), np.concatenate([a, a], 1))
    four = frame(spark, np.arange(36).reshape(1, 2, 3, 6), "bigint")
    same(views.nhwc_to_nchw(views.nchw_to_nhwc(four)), np.arange(36).reshape(1, 2, 3, 6))
    assert x.is_c_contiguous() and not views.transpose(x).is_c_contiguous()
    assert views.materialise(views.transpose(x)).is_c_contiguous()
    row = frame(spark, [[1, 2, 3]], "bigint")
    same(views.broadcast_to(row, (2, 2, 3)), np.broadcast_to([[1, 2, 3]], (2, 2, 3)))
    assert views.broadcast_shape((1, 2, 3), (5, 2), align="left") == (5, 2, 3)
    with pytest.raises(ValueError):
        views.broadcast_shape((2, 3), (4, 3))
    with pytest.raises(IndexError):
        x.get(2, 0, 0)


def test_elementwise(spark):
    a, b = frame(spark, [[3, 2, 1], [1, 2, 3]]), frame(spark, [[1, 2, 3]])
    assert elementwise.broadcast(lambda x, y: x + y, a, b).to_numpy().tolist() == [[4, 4, 4], [2, 4, 6]]
    x, z = np.arange(15.0).reshape(5, 3), np.arange(15.0).reshape(3, 5)
    got = elementwise.for_each(lambda p, q: p + q, frame(spark, x), views.transpose(frame(spark, z))).to_numpy()
    np.testing.assert_array_equal(got, x + z.T)
    got = elementwise.for_each(lambda p, q, r: p + q - F.sin(r), *(frame(spark, x),) * 3)
    np.testing.assert_allclose(got.to_numpy(), 2 * x - np.sin(x))
    outer = elementwise.broadcast(lambda p, q: p * q, frame(spark, [[1], [2]]), frame(spark, [[3, 4]]))
    assert outer.to_numpy().tolist() == [[3, 4], [6, 8]]
    with pytest.raises(ValueError):
        elementwise.for_each(lambda p, q: p + q, a, b)
    assert elementwise.scal(2.0, elementwise.axpy(3.0, a, a)).to_numpy()[0].tolist() == [24, 16, 8]


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17, 100])
def test_reductions_agree_with_numpy(spark, n):
    v = np.random.default_rng(n).uniform(-2, -1, n)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i0 long, v double")
    x = NDFrame(df, (n,))
    want = (v.sum(), v.min(initial=math.inf), v.max(initial=-math.inf), v.prod())
    for kind, w in zip(("sum", "min", "max", "product"), want):
        assert reduce.reduce_all(x, kind).first()["v"] == pytest.approx(w, rel=1e-5)


def test_more_reductions(spark):
    a = np.random.default_rng(0).normal(size=(3, 5))
    x = frame(spark, a)
    e = np.exp(a - a.max(axis=1, keepdims=True))
    np.testing.assert_allclose(reduce.softmax(x).to_numpy(), e / e.sum(axis=1, keepdims=True))
    got = {r["i0"]: r["v"] for r in reduce.logsumexp(x.df, ["i0"], "v").collect()}
    np.testing.assert_allclose([got[i] for i in range(3)], np.log(np.exp(a).sum(axis=1)))
    top = {r["i0"]: r["i1"] for r in reduce.argmax(x.df, ["i0"], "i1", "v").collect()}
    assert [top[i] for i in range(3)] == a.argmax(axis=1).tolist()
    np.testing.assert_allclose(reduce.reduce_axes(x, [0]).to_numpy(), a.sum(axis=0))
    pairs = spark.createDataFrame([(0.0, 0.0), (1.0, 2.0), (2.0, 1.0)], "y double, t double")
    assert [r[0] for r in pairs.select(reduce.relative_error(F.col("y"), F.col("t"))).collect()] == [0, 0.5, 0.5]
    y = S.from_values(spark, range(-10000, 1), (10001,), "bigint")
    both = elementwise.for_each(lambda p, q: p + q, S.from_values(spark, range(1, 10002), (10001,), "bigint"), y)
    assert reduce.reduce_all(both).first()["v"] == 10001
    soft = spark.range(1).select(reduce.softmax_vector(F.array(F.lit(0.0), F.lit(0.0))).alias("s")).first()["s"]
    assert soft == [0.5, 0.5]


@pytest.mark.parametrize("values,probes,left,right", [
    ([1, 2, 3, 4, 5], [-10, 10, 2, 3], [0, 5, 1, 2], [0, 5, 2, 3]),
    ([0, 3, 9, 9, 10], [2, 4, 9], [1, 2, 2], [1, 2, 4]),
    ([1, 2, 3, 4, 5], [0, 2, 6], [0, 1, 5], [0, 2, 5]),
])
def test_searchsorted(spark, values, probes, left, right):
    rows = spark.createDataFrame([(0, float(v)) for v in values], "r int, v double")
    asked = spark.createDataFrame([(0, i, float(p)) for i, p in enumerate(probes)], "r int, id int, p double")
    for side, want in ((True, left), (False, right)):
        got = {r["id"]: r["position"] for r in sampling.searchsorted(rows, asked, ["r"], "v", "p", side).collect()}
        assert [got[i] for i in range(len(probes))] == want


def test_sampling(spark):
    w = views.broadcast_to(frame(spark, [[0.1, 0.4, 0.3, 0.2]]), (8000, 4))
    n = {r["i1"]: r["count"] for r in sampling.draw_seeded(w, 1).groupBy("i1").count().collect()}
    assert sum((n[i] - 8000 * p) ** 2 / (8000 * p) for i, p in enumerate((0.1, 0.4, 0.3, 0.2))) < 16.3
    n = {r["i1"]: r["count"] for r in sampling.sample_without_replacement(w, 1, seed=2).groupBy("i1").count().collect()}
    assert sum((n[i] - 8000 * p) ** 2 / (8000 * p) for i, p in enumerate((0.1, 0.4, 0.3, 0.2))) < 16.3
    eight = frame(spark, [[0.3, 1.5, 0.4, 0.3, 0.3, 1.5, 0.4, 0.0]])
    drawn = [r["i1"] for r in sampling.sample_without_replacement(eight, 9).orderBy("draw").collect()]
    assert sorted(drawn) == list(range(7))
    u = spark.createDataFrame([(0, 0.25)], "i0 long, u double")
    assert sampling.draw(frame(spark, [[3, 3, 1, 5]]), u).first()["i1"] == 1  # a tie goes to the next item
    _, left = sampling.draw_and_remove(frame(spark, [[3, 3, 1, 5]]), u)
    assert left.to_numpy().tolist() == [[3, 0, 1, 5]]
    df = spark.range(1000).withColumn("v", F.lit(1))
    total = sampling.cumsum_long(df, "id", "v", 64)
    assert total.filter("cdf != id + 1").count() == 0
    t = sampling.alias_table([1, 2, 3, 4])
    share = [sum((p if i == k else 0) + (1 - p if a == k else 0) for i, (p, a) in enumerate(t)) / 4 for k in range(4)]
    assert share == pytest.approx([0.1, 0.2, 0.3, 0.4])


@pytest.mark.parametrize("combine", ["sum", "prod"])
def test_stencils(spark, combine):
    a = np.random.default_rng(3).normal(size=(1, 6, 7))
    join = (lambda *n: sum(n)) if combine == "sum" else (lambda *n: math.prod(n))
    want, slow = a[0].copy(), a[0].copy()
    for i in range(1, 5):
        for j in range(1, 6):
            near = [(i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)]
            want[i, j] = 0.25 * join(*(a[0][p] for p in near))
            slow[i, j] = 0.25 * join(*(slow[p] for p in near))
    np.testing.assert_allclose(stencil.jacobi(frame(spark, a), 1, combine).to_numpy()[0], want)
    np.testing.assert_allclose(stencil.gauss_seidel(frame(spark, a), 1, combine).to_numpy()[0], slow)


def test_functions(spark):
    k = spark.createDataFrame([(10, 4), (65, 64), (1, 3), (19, 24), (8, 4)], "x long, s long").collect()
    up = {(10, 4): 12, (65, 64): 128, (1, 3): 3, (19, 24): 24, (8, 4): 8}
    for x, s in k:
        row = spark.range(1).select(chunking.round_up(F.lit(x), s).alias("u"), chunking.round_down(F.lit(x), s).alias("d")).first()
        assert (row["u"], row["d"]) == (up[x, s], x // s * s)
    assert chunking.chunk_sizes(40, 12) == [4] * 4 + [3] * 8
    n = spark.range(40).select(chunking.chunk_of(F.col("id"), 40, 12).alias("c")).groupBy("c").count().orderBy("c").collect()
    assert [r["count"] for r in n] == [4] * 4 + [3] * 8
    p = spark.createDataFrame([(x,) for x in (0, 1, 2, 3, 4, 5, 1 << 40)], "x long").select(chunking.next_power_of_two(F.col("x")))
    assert [r[0] for r in p.collect()] == [1, 1, 2, 4, 4, 8, 1 << 40]
    v = spark.createDataFrame([(200.0,), (-200.0,), (0.0,)], "x double")
    got = [r[0] for r in v.select(M.exp_clamped(F.col("x"))).collect()]
    assert got == pytest.approx([math.exp(88), math.exp(-88), 1])
    got = [r[0] for r in v.select(M.sigmoid(F.col("x"))).collect()]
    assert got == pytest.approx([1, 0, 0.5])
    assert tape.execute("+++>++++[<+>-]<.") == b"\x07"
    with pytest.raises(ValueError):
        tape.execute("[[]")


def test_stream(spark, tmp_path):
    from gridloom.streaming.reductions import reduce_stream

    df = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("a", 3.0)], "k string, v double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = reduce_stream(stream, ["k"], "v").writeStream.outputMode("complete").format("memory").queryName("reduced").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["k"], r["sum"], r["min"], r["max"]) for r in spark.table("reduced").collect()} == {("a", 4, 1, 3), ("b", 5, 5, 5)}
