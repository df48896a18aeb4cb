"""Weight trees, recurrent cells, convolution paths and block products against brute force."""

import numpy as np
import pytest

from gridloom.frame import NDFrame
from gridloom.operators import conv, linalg, recurrent, sampling
from gridloom.plans import einsum as E
from gridloom.sources.arrays import new_tensor, pretty_images, random_tensor, to_tensor


def _drawn(weights, u):
    sums = np.cumsum(weights)
    return int(np.searchsorted(sums, u * sums[-1], "right"))


@pytest.mark.parametrize("n", [1, 5, 8, 13])
def test_weight_tree(spark, n):
    rng = np.random.default_rng(n)
    w = rng.integers(0, 9, (4, n))
    w[0] += 1
    w[3] = 0
    tree = sampling.weight_tree(to_tensor(spark, w.tolist(), "bigint"))
    us = [k / 16 for k in range(16)]
    u = spark.createDataFrame([(r, x, f"{r}-{x}") for r in range(4) for x in us], "i0 long, u double, tag string")

    def check(tree, w):
        assert {(r["i0"], r["i1"]): r["v"] for r in tree.weights().collect()} == {(i, j): w[i, j] for i, j in np.ndindex(w.shape)}
        assert {r["i0"]: r["total"] for r in tree.total().collect()} == dict(enumerate(w.sum(axis=1)))
        got = {r["tag"]: r["i1"] for r in tree.draw(u).collect()}
        assert got == {f"{r}-{x}": _drawn(w[r], x) for r in range(4) for x in us if w[r].sum()}

    check(tree, w)
    changes = [(0, j, int(j * 3)) for j in range(0, n, 2)] + [(1, n - 1, 4)]
    for i, j, v in changes:
        w[i, j] = v
    tree = tree.update(spark.createDataFrame(changes, "i0 long, i1 long, w long"))
    check(tree, w)
    drawn, rest = tree.draw_and_remove(u.filter("u = 0.5"))
    for r in drawn.collect():
        w[r["i0"], r["i1"]] = 0
    check(rest, w)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def test_recurrent_cells(spark):
    rng = np.random.default_rng(1)
    gates = [recurrent.Gate(rng.normal(size=(3, 2)).tolist(), rng.normal(size=(3, 3)).tolist(), rng.normal(size=3).tolist()) for _ in range(3)]
    seqs = [rng.normal(size=(t, 2)).tolist() for t in (0, 1, 7)]
    df = spark.createDataFrame([*enumerate(seqs), (9, None)], "id int, s array<array<double>>")
    got = {r["id"]: r for r in df.select("id", recurrent.rnn(df.s, gates[0], [0.5, 0.0, 0.1]).alias("rnn"), recurrent.gru(df.s, *gates).alias("gru")).collect()}
    of = lambda g, x, h: np.array(g.w) @ x + np.array(g.u) @ h + np.array(g.b)
    for k, seq in enumerate(seqs):
        h, q = np.array([0.5, 0.0, 0.1]), np.zeros(3)
        for x in seq:
            h = np.tanh(of(gates[0], x, h))
            z, r = _sigmoid(of(gates[0], x, q)), _sigmoid(of(gates[1], x, q))
            q = z * q + (1 - z) * np.tanh(of(gates[2], x, r * q))
        assert np.allclose(got[k]["rnn"], h) and np.allclose(got[k]["gru"], q)
    assert got[9]["rnn"] is None and got[9]["gru"] is None
    with pytest.raises(ValueError):
        recurrent.Gate([[1.0]], [[1.0, 2.0]], [0.0])


@pytest.mark.parametrize("padding,stride", [("valid", (1, 1)), ((1, 2), (2, 1)), ("same", (2, 3))])
def test_convolution_paths_agree(spark, padding, stride):
    rng = np.random.default_rng(2)
    image = to_tensor(spark, rng.integers(-5, 5, (2, 3, 5, 6)).tolist(), "bigint")
    kernel = to_tensor(spark, rng.integers(-3, 4, (4, 3, 3, 2)).tolist(), "bigint")
    want = conv.conv2d(image, kernel, padding, stride).to_numpy()
    for path in (conv.conv2d_strips, conv.conv2d_shifted):
        assert (path(image, kernel, padding, stride).to_numpy() == want).all(), path


def test_separable(spark):
    rng = np.random.default_rng(3)
    column, row = rng.integers(-3, 4, (2, 3)), rng.integers(-3, 4, (2, 2))
    image = to_tensor(spark, rng.integers(-5, 5, (2, 2, 5, 6)).tolist(), "bigint")
    as_kernel = lambda k, at: to_tensor(spark, np.expand_dims(k, at).tolist(), "bigint")
    whole = np.einsum("ch,cw->chw", column, row)
    want = conv.conv2d(image, as_kernel(whole, 1), (1, 0), (2, 1), groups=2).to_numpy()
    made = conv.conv2d_separable(image, as_kernel(column, (1, 3)), as_kernel(row, (1, 2)), (1, 0), (2, 1))
    assert (made.to_numpy() == want).all()


def test_large_dense_products_go_by_blocks_and_squares(spark, monkeypatch):
    rng = np.random.default_rng(4)
    a, b, c = rng.normal(size=(7, 3)), rng.normal(size=(3, 9)), rng.normal(size=(7, 9))
    monkeypatch.setattr(linalg, "DENSE_OPS", 1)
    monkeypatch.setattr(linalg, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(linalg, "SPAN", 2)
    monkeypatch.setattr(linalg, "block_edge", lambda *_: 2)
    x, y, z = (to_tensor(spark, m.tolist()) for m in (a, b, c))
    made = linalg.gemm(x, y, 2.0, 3.0, z, prologue=(lambda v: v + 1, lambda v: -v), epilogue=lambda v: v * 0.5)
    assert "MapInArrow" in made.df._jdf.queryExecution().toString()
    assert np.allclose(made.to_numpy(), 0.5 * (2 * (a + 1) @ -b + 3 * c))


def test_expressions_that_read_an_array_twice(spark):
    x = to_tensor(spark, [[1, 2], [3, 4]], "bigint")
    a = E.Fn(x, "a")
    made = E.assign(("i", "j"), a["i", "j"] * a["i", "j"] + a["j", "i"])
    assert made.to_numpy().tolist() == [[2, 7], [11, 20]]
    assert made.df._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_random_values_depend_on_seed_and_index_alone(spark):
    x = random_tensor(spark, 40, 5, low=2.0, high=4.0, seed=3)
    again = NDFrame(x.df.repartition(7), x.shape)
    assert (x.to_numpy() == again.to_numpy()).all() and 2 <= x.to_numpy().min() < 2.2 and 3.8 < x.to_numpy().max() < 4
    assert not (x.to_numpy() == random_tensor(spark, 40, 5, low=2.0, high=4.0, seed=4).to_numpy()).any()


def test_images_as_text(spark):
    x = to_tensor(spark, [[[[1, 2], [3, 4]], [[50, 6], [7, 8]]]], "bigint")
    assert pretty_images(x) == " 1  2 | 50  6\n 3  4 |  7  8"
    with pytest.raises(ValueError):
        pretty_images(new_tensor(spark, 2, 2))
