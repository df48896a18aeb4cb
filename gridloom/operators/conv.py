"""2-D convolution in the sense of deep learning (cross-correlation); images are (n, c, h, w), kernels (o, c, kh, kw).

The scatter form: each pixel meets the kernel's weights of its channel by a broadcast join, its output cell follows by
arithmetic, and products are summed by output cell. The kernel is small by nature and its size is checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import NDFrame, coordinates
from .linalg import _hint, gemm

Pair = tuple[int, int]


def paddings(kind: str | Pair, kernel: tuple[int, ...], dilation: Pair = (1, 1)) -> tuple[Pair, Pair]:
    """((top, bottom), (left, right)): none ("valid"), so that the extent stays ("same"), or before only ("causal")."""
    spans = [(k - 1) * d for k, d in zip(kernel[2:], dilation)]
    if kind == "valid":
        return (0, 0), (0, 0)
    if kind == "same":
        return tuple((s // 2, s - s // 2) for s in spans)
    if kind == "causal":
        return tuple((s, 0) for s in spans)
    return (kind[0], kind[0]), (kind[1], kind[1])


def conv_out_shape(image, kernel, padding="valid", stride: Pair = (1, 1), dilation: Pair = (1, 1), groups: int = 1):
    """(n, o, oh, ow); oh = 1 + (h + padding - span) div stride."""
    n, c, h, w = image
    o, kc, kh, kw = kernel
    if kc * groups != c or o % groups:
        raise ValueError(f"kernel {tuple(kernel)} with {groups} groups on {c} channels")
    if min(stride) <= 0 or min(dilation) <= 0:
        raise ValueError("strides and dilations are positive")
    extents = []
    for i, k, p, s, d in zip((h, w), (kh, kw), paddings(padding, kernel, dilation), stride, dilation):
        room = i + sum(p) - ((k - 1) * d + 1)
        if room < 0:
            raise ValueError(f"kernel {tuple(kernel)} is larger than image {tuple(image)}")
        extents.append(1 + room // s)
    return (n, o, *extents)


def conv_required_ops(image, kernel, padding="valid", stride: Pair = (1, 1)) -> int:
    n, o, oh, ow = conv_out_shape(image, kernel, padding, stride)
    return 2 * n * o * oh * ow * kernel[1] * kernel[2] * kernel[3]


def conv_required_data(image, kernel) -> int:
    from math import prod

    return prod(image) + prod(kernel)


def _taps(image: NDFrame, kernel_shape, padding, stride: Pair, dilation: Pair) -> DataFrame:
    """Each pixel with each tap (kh, kw) for which it falls into an output cell (oh, ow)."""
    _, _, kh, kw = kernel_shape
    _, _, oh, ow = conv_out_shape(image.shape, (1, image.shape[1], kh, kw), padding, stride, dilation)
    (top, _), (left, _) = paddings(padding, kernel_shape, dilation)
    taps = F.explode(F.array(*(F.struct(F.lit(y).alias("kh"), F.lit(x).alias("kw")) for y in range(kh) for x in range(kw))))
    df = image.df.select("i0", "i1", "i2", "i3", "v", taps.alias("t"))
    df = df.select("i0", "i1", "v", F.col("t.kh").alias("kh"), F.col("t.kw").alias("kw"),
                   (F.col("i2") + top - F.col("t.kh") * dilation[0]).alias("rh"), (F.col("i3") + left - F.col("t.kw") * dilation[1]).alias("rw"))
    df = df.filter((F.col("rh") >= 0) & (F.col("rw") >= 0) & (F.col("rh") % stride[0] == 0) & (F.col("rw") % stride[1] == 0))
    df = df.select("i0", "i1", "v", "kh", "kw", F.expr(f"rh div {stride[0]}").alias("oh"), F.expr(f"rw div {stride[1]}").alias("ow"))
    return df.filter((F.col("oh") < oh) & (F.col("ow") < ow))


def conv2d(image: NDFrame, kernel: NDFrame, padding="valid", stride: Pair = (1, 1), dilation: Pair = (1, 1), groups: int = 1) -> NDFrame:
    """The convolution. Output cells whose window lies in the padding alone are 0, and there."""
    shape = conv_out_shape(image.shape, kernel.shape, padding, stride, dilation, groups)
    per = image.shape[1] // groups
    if kernel.shape[2:] == (1, 1) and groups == 1 and stride == (1, 1) and padding in ("valid", (0, 0), "same"):
        return _pointwise(image, kernel, shape)
    taps = _taps(image, kernel.shape, padding, stride, dilation)
    weights = kernel.df.select(F.col("i0").alias("o"), F.col("i1").alias("kc"), F.col("i2").cast("int").alias("kh"),
                               F.col("i3").cast("int").alias("kw"), F.col("v").alias("k"))
    taps = taps.withColumn("kc", F.col("i1") % per).withColumn("g", F.expr(f"i1 div {per}"))
    weights = weights.withColumn("g", F.expr(f"o div {kernel.shape[0] // groups}"))
    terms = taps.join(_hint(kernel, weights), ["g", "kc", "kh", "kw"])
    out = terms.groupBy(F.col("i0"), F.col("o").alias("i1"), F.col("oh").alias("i2"), F.col("ow").alias("i3"))
    made = NDFrame(out.agg(F.sum(F.col("v") * F.col("k")).alias("v")), shape, sparse=True)
    no_gap = all(sum(p) == 0 for p in paddings(padding, kernel.shape, dilation)) and not image.sparse and not kernel.sparse
    return NDFrame(made.df, shape) if no_gap else made.dense()


def _pointwise(image: NDFrame, kernel: NDFrame, shape) -> NDFrame:
    """A 1 x 1 kernel mixes channels: a join on the channel alone."""
    weights = kernel.df.select(F.col("i0").alias("o"), F.col("i1"), F.col("v").alias("k"))
    terms = image.df.join(_hint(kernel, weights), "i1").groupBy("i0", F.col("o").alias("i1"), "i2", "i3")
    return NDFrame(terms.agg(F.sum(F.col("v") * F.col("k")).alias("v")), shape, image.sparse or kernel.sparse)


def im2col(image: NDFrame, kernel_shape, padding="valid", stride: Pair = (1, 1), dilation: Pair = (1, 1)) -> NDFrame:
    """(n, c * kh * kw, oh * ow): the windows as columns, with the padding's zeros."""
    n, c, _, _ = image.shape
    _, _, kh, kw = kernel_shape
    _, _, oh, ow = conv_out_shape(image.shape, (1, c, kh, kw), padding, stride, dilation)
    df = _taps(image, kernel_shape, padding, stride, dilation).select(
        "i0",
        ((F.col("i1") * kh + F.col("kh")) * kw + F.col("kw")).cast("long").alias("i1"),
        (F.col("oh") * ow + F.col("ow")).cast("long").alias("i2"),
        "v",
    )
    return NDFrame(df, (n, c * kh * kw, oh * ow), sparse=True).dense()


def im2col_workspace(image, kernel, padding="valid", stride: Pair = (1, 1)) -> int:
    _, _, oh, ow = conv_out_shape(image, kernel, padding, stride)
    return kernel[1] * kernel[2] * kernel[3] * oh * ow


def conv2d_im2col(image: NDFrame, kernel: NDFrame, padding="valid", stride: Pair = (1, 1)) -> NDFrame:
    """The convolution as a product of the kernel's rows with the windows of each image."""
    n, o, oh, ow = conv_out_shape(image.shape, kernel.shape, padding, stride)
    _, c, kh, kw = kernel.shape
    columns = im2col(image, kernel.shape, padding, stride)
    flat = kernel.df.select("i0", ((F.col("i1") * kh + F.col("i2")) * kw + F.col("i3")).alias("i1"), "v")
    rows = NDFrame(flat.select(F.col("i1").alias("i0"), F.col("i0").alias("i1"), "v"), (c * kh * kw, o))
    swapped = NDFrame(columns.df.select("i0", F.col("i2").alias("i1"), F.col("i1").alias("i2"), "v"), (n, oh * ow, c * kh * kw))
    made = gemm(swapped, rows, batch=1)
    at = [F.col("i2").alias("o"), F.expr(f"i1 div {ow}").alias("oh"), (F.col("i1") % ow).alias("ow")]
    df = made.df.select("i0", *at, "v").toDF("i0", "i1", "i2", "i3", "v")
    return NDFrame(df, (n, o, oh, ow))


def _dot(cells: str, weights: str, kind: str):
    """The sum over cells (at, v) of v times the weight at at."""
    return F.aggregate(cells, F.lit(0).cast(kind), lambda s, c: (s + c["v"] * F.get(weights, c["at"])).cast(kind))


def _kind(image: NDFrame, kernel: NDFrame) -> str:
    return "bigint" if {image.dtype, kernel.dtype} <= {"tinyint", "smallint", "int", "bigint"} else "double"


def conv2d_strips(image: NDFrame, kernel: NDFrame, padding="valid", stride: Pair = (1, 1)) -> NDFrame:
    """The convolution with images lowered along their width alone: a pixel is copied kw times, not kh * kw times as by
    :func:`im2col`. What a window holds of one image row is an array; it meets the kernel rows that fall on it, and
    the products are added up by output cell."""
    n, o, oh, ow = conv_out_shape(image.shape, kernel.shape, padding, stride)
    _, _, kh, kw = kernel.shape
    (top, _), (left, _) = paddings(padding, kernel.shape)
    wide = image.df.select("i0", "i1", "i2", "i3", "v", F.explode(F.array(*map(F.lit, range(kw)))).alias("kw"))
    wide = wide.withColumn("rw", F.col("i3") + left - F.col("kw")).filter(f"rw >= 0 and rw % {stride[1]} = 0")
    cell = F.struct((F.col("i1") * kw + F.col("kw")).cast("int").alias("at"), "v")
    strips = wide.groupBy("i0", "i2", F.expr(f"rw div {stride[1]}").alias("ow")).agg(F.collect_list(cell).alias("strip")).filter(F.col("ow") < ow)
    rows = F.sort_array(F.collect_list(F.struct("i1", "i3", "v")))
    rows = kernel.dense().df.groupBy(F.col("i0").alias("o"), F.col("i2").cast("int").alias("kh")).agg(F.transform(rows, lambda r: r["v"]).alias("k"))
    met = strips.withColumn("kh", F.explode(F.array(*map(F.lit, range(kh))))).withColumn("rh", F.col("i2") + top - F.col("kh"))
    met = met.filter(f"rh >= 0 and rh % {stride[0]} = 0").withColumn("oh", F.expr(f"rh div {stride[0]}")).filter(F.col("oh") < oh)
    met = met.join(_hint(kernel, rows), "kh").select("i0", "o", "oh", "ow", _dot("strip", "k", _kind(image, kernel)).alias("x"))
    out = met.groupBy("i0", F.col("o").alias("i1"), F.col("oh").alias("i2"), F.col("ow").alias("i3")).agg(F.sum("x").alias("v"))
    return NDFrame(out, (n, o, oh, ow), sparse=True).dense()


def conv2d_shifted(image: NDFrame, kernel: NDFrame, padding="valid", stride: Pair = (1, 1)) -> NDFrame:
    """The convolution as one pointwise product for each tap of the kernel, shifted and added: a pixel's channels are an
    array that meets the taps' arrays, so nothing is lowered."""
    n, o, oh, ow = conv_out_shape(image.shape, kernel.shape, padding, stride)
    (top, _), (left, _) = paddings(padding, kernel.shape)
    cell = F.struct(F.col("i1").cast("int").alias("at"), "v")
    pixels = image.df.groupBy("i0", "i2", "i3").agg(F.collect_list(cell).alias("pixel"))
    taps = F.sort_array(F.collect_list(F.struct("i1", "v")))
    taps = kernel.dense().df.groupBy(F.col("i0").alias("o"), F.col("i2").alias("kh"), F.col("i3").alias("kw")).agg(F.transform(taps, lambda r: r["v"]).alias("k"))
    taps = taps.groupBy("kh", "kw").agg(F.collect_list(F.struct("o", "k")).alias("maps"))
    each = F.array(*(F.struct(F.lit(y).alias("kh"), F.lit(x).alias("kw")) for y in range(kernel.shape[2]) for x in range(kernel.shape[3])))
    met = pixels.withColumn("t", F.explode(each)).select(
        "i0", "pixel", "t.kh", "t.kw", (F.col("i2") + top - F.col("t.kh")).alias("rh"), (F.col("i3") + left - F.col("t.kw")).alias("rw")
    )
    met = met.filter(f"rh >= 0 and rw >= 0 and rh % {stride[0]} = 0 and rw % {stride[1]} = 0")
    met = met.withColumn("oh", F.expr(f"rh div {stride[0]}")).withColumn("ow", F.expr(f"rw div {stride[1]}"))
    met = met.filter((F.col("oh") < oh) & (F.col("ow") < ow)).join(_hint(kernel, taps), ["kh", "kw"])
    met = met.select("i0", "oh", "ow", "pixel", F.explode("maps").alias("m")).select("i0", "oh", "ow", "pixel", "m.o", "m.k")
    met = met.select("i0", "o", "oh", "ow", _dot("pixel", "k", _kind(image, kernel)).alias("x"))
    out = met.groupBy("i0", F.col("o").alias("i1"), F.col("oh").alias("i2"), F.col("ow").alias("i3")).agg(F.sum("x").alias("v"))
    return NDFrame(out, (n, o, oh, ow), sparse=True).dense()


def conv2d_separable(image: NDFrame, column: NDFrame, row: NDFrame, padding="valid", stride: Pair = (1, 1)) -> NDFrame:
    """The convolution, channel by channel, with kernels that are a column (c, 1, kh, 1) times a row (c, 1, 1, kw)."""
    channels = image.shape[1]
    down, across = (padding, padding) if isinstance(padding, str) else ((padding[0], 0), (0, padding[1]))
    half = conv2d(image, column, down, (stride[0], 1), groups=channels)
    return conv2d(half, row, across, (1, stride[1]), groups=channels)


def full_grid(x: NDFrame) -> DataFrame:
    return coordinates(x.spark, x.shape)
