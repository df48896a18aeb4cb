"""Matrix products and convolutions against golden values and NumPy."""

import numpy as np
import pytest

from gridloom.operators import conv, linalg, views
from gridloom.plans.einsum import Fn, assign, einsum, tree
from gridloom.sources.arrays import to_tensor

G8A = [[2,4,3,1,3,1,3,1],[1,2,1,1,2,0,4,3],[2,0,0,3,0,4,4,1],[1,1,4,0,3,1,3,0],[3,4,1,1,4,2,3,4],[2,4,0,2,3,3,3,4],[3,0,0,3,1,4,3,1],[4,3,2,4,1,0,0,0]]
G8B = [[2,2,0,4,0,0,4,2],[2,0,0,1,1,1,3,1],[0,2,2,0,2,2,3,3],[0,0,1,0,4,2,4,1],[0,0,1,3,4,2,4,2],[4,3,4,1,4,4,0,3],[3,3,0,2,1,2,3,3],[2,1,2,1,2,4,4,1]]
GOLDEN = [
    ("double", [[1, 2, 3], [1, 1, 1], [1, 1, 1]], [[1, 1], [1, 1], [1, 1]], [[6, 6], [3, 3], [3, 3]]),
    ("double", [[1, 2, 3], [4, 5, 6]], [[7, 8], [9, 10], [11, 12]], [[58, 64], [139, 154]]),
    ("bigint", [[-2, -3, -1], [3, 0, 4]], [[1, 5, 2, -1], [-3, 0, 3, 4], [6, -2, 7, -4]], [[1, -8, -20, -6], [27, 7, 34, -19]]),
    ("bigint", [[5, 6, 5, 8], [8, 2, 8, 8], [0, 5, 4, 0], [4, 0, 5, 6], [4, 5, 0, 3]], [[5, 3, 6, 0], [5, 2, 3, 3], [8, 8, 2, 0], [7, 7, 0, 0]],
     [[151, 123, 58, 18], [170, 148, 70, 6], [57, 42, 23, 15], [102, 94, 34, 0], [66, 43, 39, 15]]),
    ("bigint", G8A, G8B, (np.array(G8A) @ np.array(G8B)).tolist()),
]


@pytest.mark.parametrize("dtype,a,b,c", GOLDEN)
def test_golden_products(spark, dtype, a, b, c):
    x, y = to_tensor(spark, a, dtype), to_tensor(spark, b, dtype)
    assert linalg.gemm(x, y).to_numpy().tolist() == c
    assert einsum("ij,jk->ik", x, y).to_numpy().tolist() == c


def test_scaling_and_epilogue(spark):
    a, b, c = (to_tensor(spark, v) for v in ([[1, 2], [3, 4]], [[1, 0], [0, 1]], [[1, 1], [1, 1]]))
    assert linalg.gemm(a, b, 2, 3, c).to_numpy().tolist() == [[5, 7], [9, 11]]
    nan = c.map(lambda v: v * float("nan"))
    assert linalg.gemm(a, b, 1, 0, nan).to_numpy().tolist() == [[1, 2], [3, 4]]
    assert linalg.gemm(a, b, -1, epilogue=lambda v: v + 4).to_numpy().tolist() == [[3, 2], [1, 0]]


def test_empty_contraction_leaves_scaled_c(spark):
    from gridloom.frame import NDFrame

    none = NDFrame(spark.createDataFrame([], "i0 long, i1 long, v double"), (2, 0))
    other = NDFrame(spark.createDataFrame([], "i0 long, i1 long, v double"), (0, 2))
    c = to_tensor(spark, [[1, 2], [3, 4]])
    assert linalg.gemm(none, other, 1, 3, c).to_numpy().tolist() == [[3, 6], [9, 12]]
    assert linalg.gemm(none, other).to_numpy().tolist() == [[0, 0], [0, 0]]


@pytest.mark.parametrize("m,k,n,edge", [(1, 1, 1, 4), (17, 16, 15, 4), (40, 600, 23, 64)])
def test_blocks_agree_with_numpy(spark, m, k, n, edge):
    rng = np.random.default_rng(m)
    a, b = rng.normal(size=(m, k)), rng.normal(size=(k, n))
    made = linalg.gemm_blocks(linalg.to_blocks(to_tensor(spark, a.tolist()), edge), linalg.to_blocks(to_tensor(spark, b.tolist()), edge))
    np.testing.assert_allclose(linalg.from_blocks(made).to_numpy(), a @ b, rtol=1e-5, atol=1e-9)


def test_strided_transposed_batched_chain(spark):
    a = np.arange(24).reshape(2, 3, 4)
    x = to_tensor(spark, a.tolist(), "bigint")
    y = views.transpose_batched(x)
    assert (linalg.gemm(x, y, batch=1).to_numpy() == a @ a.transpose(0, 2, 1)).all()
    m = to_tensor(spark, a[0].tolist(), "bigint")
    half = views.slice_(m, slice(None, None, 2))
    assert (linalg.gemm(half, views.transpose(m)).to_numpy() == a[0][::2] @ a[0].T).all()
    assert linalg.chain_order([(10, 30), (30, 5), (5, 60)]) == ((0, 1), 2)
    assert (linalg.chain(m, views.transpose(m), m).to_numpy() == a[0] @ a[0].T @ a[0]).all()
    with pytest.raises(ValueError):
        linalg.gemm(m, m)


IMAGE = [[[[1, 2, 0, 0], [5, 3, 0, 4], [0, 0, 0, 7], [9, 3, 0, 0]]]]
KERNEL = [[[[1, 1, 1], [1, 1, 0], [1, 0, 0]]]]
WIDE = [[[[2,2,0,2,1],[0,1,1,0,2],[1,2,1,2,1],[2,2,0,0,2],[2,1,1,1,2]],[[2,0,1,1,1],[2,2,0,0,2],[2,2,1,0,0],[1,1,2,2,0],[2,1,1,1,0]],[[0,1,2,2,0],[1,1,1,1,0],[2,1,2,2,0],[0,2,2,2,1],[0,0,2,2,1]]]]
TWO = [[[[-1,-1,-1],[1,0,1],[0,-1,0]],[[1,0,-1],[1,-1,1],[0,1,0]],[[0,0,1],[-1,-1,-1],[-1,0,0]]],[[[0,1,0],[1,-1,-1],[1,1,-1]],[[-1,0,1],[-1,-1,1],[1,1,0]],[[0,1,1],[-1,1,-1],[-1,-1,0]]]]


@pytest.mark.parametrize("how", [conv.conv2d, conv.conv2d_im2col])
def test_golden_convolutions(spark, how):
    out = how(to_tensor(spark, IMAGE), to_tensor(spark, KERNEL), (1, 1), (1, 1)).to_numpy()
    assert out.tolist() == [[[[1, 8, 5, 0], [8, 11, 5, 4], [8, 17, 10, 11], [9, 12, 10, 7]]]]
    out = how(to_tensor(spark, WIDE), to_tensor(spark, TWO), (1, 1), (2, 2)).to_numpy()
    assert out.tolist() == [[[[1, -3, -1], [-4, 1, -6], [-3, -2, -1]], [[-7, 1, 0], [3, -3, 2], [1, 3, -2]]]]


def _direct(x, k, pads, stride, dilation):
    (t, b), (l, r) = pads
    x = np.pad(x, ((0, 0), (0, 0), (t, b), (l, r)))
    n, _, h, w = x.shape
    o, _, kh, kw = k.shape
    oh = 1 + (h - (kh - 1) * dilation[0] - 1) // stride[0]
    ow = 1 + (w - (kw - 1) * dilation[1] - 1) // stride[1]
    out = np.zeros((n, o, oh, ow))
    for y in range(oh):
        for z in range(ow):
            rows = slice(y * stride[0], y * stride[0] + (kh - 1) * dilation[0] + 1, dilation[0])
            cols = slice(z * stride[1], z * stride[1] + (kw - 1) * dilation[1] + 1, dilation[1])
            out[:, :, y, z] = np.einsum("nchw,ochw->no", x[:, :, rows, cols], k)
    return out


@pytest.mark.parametrize("padding,stride,dilation", [("same", (2, 1), (1, 1)), ("causal", (1, 2), (2, 1)), ((2, 0), (3, 2), (1, 1)), ("valid", (1, 1), (1, 1))])
def test_convolution_agrees_with_numpy(spark, padding, stride, dilation):
    rng = np.random.default_rng(0)
    x, k = rng.integers(-3, 4, (2, 2, 6, 5)), rng.integers(-2, 3, (3, 2, 3, 2))
    got = conv.conv2d(to_tensor(spark, x.tolist()), to_tensor(spark, k.tolist()), padding, stride, dilation).to_numpy()
    np.testing.assert_allclose(got, _direct(x, k, conv.paddings(padding, k.shape, dilation), stride, dilation))


def test_convolution_of_padding_alone_is_zero_and_shapes(spark):
    out = conv.conv2d(to_tensor(spark, [[[[1.0]]]]), to_tensor(spark, [[[[2.0]]]]), (1, 1)).to_numpy()
    assert out[0, 0].tolist() == [[0, 0, 0], [0, 2, 0], [0, 0, 0]]
    assert conv.conv_out_shape((16, 3, 224, 224), (20, 3, 3, 3)) == (16, 20, 222, 222)
    with pytest.raises(ValueError):
        conv.conv_out_shape((1, 1, 2, 2), (1, 1, 3, 3))


def test_index_notation(spark):
    a = Fn(to_tensor(spark, [[0, 1, 2], [3, 4, 5]], "bigint"), "a")
    assert assign(("j", "i"), a["i", "j"]).to_numpy().tolist() == [[0, 3], [1, 4], [2, 5]]
    one, two, three = (Fn(to_tensor(spark, [[k] * 3] * 3, "bigint")) for k in (1, 2, 3))
    assert (assign(("i", "j"), one["i", "j"] + two["i", "j"] + three["i", "j"]).to_numpy() == 6).all()
    assert assign(("i", "j"), one["i", "j"] * 3).to_numpy()[0, 0] == 3
    assert "BinOp mul" in tree(a["i", "j"] * 2) and a.dim_size(1) == 3
    with pytest.raises(ValueError):
        assign(("i", "k"), a["i", "j"])
    with pytest.raises(ValueError):
        assign(("i",), a["i", "j"] * one["i", "j"])
