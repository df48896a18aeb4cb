"""Queries of the array operators on the driver's tables, each with its SQL where SQL can say it.

Values are quantised to integers where sums have to be exact, or rounded after arithmetic within a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import NDFrame
from .functions import arrays as A
from .functions import chunking, tape
from .functions import math as M
from .operators import conv, elementwise, linalg, recurrent, reduce, sampling, stencil, views
from .plans import einsum as E
from .sources import arrays as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Cells (i, j, v) of the embeddings, quantised; by position p of the vector.
_X = """X as (select vec_id i, j - 1 j, cast(round(f::double * 1024) as bigint) v
  from (select vec_id, generate_subscripts(embedding, 1) j, unnest(embedding) f from embeddings))"""
SCALE = 1024


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql if "from X" not in sql and "X a" not in sql else _with_x(sql)
        return f

    return add


def _with_x(sql: str) -> str:
    if sql.startswith("with recursive "):
        return f"with recursive {_X}, {sql[15:]}"
    return f"with {_X}, {sql[5:]}" if sql.startswith("with ") else f"with {_X} {sql}"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _x(spark: SparkSession, sf_dir: str, *inner: int) -> NDFrame:
    """The embeddings as an array (vector, ...); vec_id runs from 0 without gaps."""
    df = _table(spark, sf_dir, "embeddings")
    inner = inner or (64,)
    n = df.agg(F.max("vec_id")).first()[0]
    return S.from_vectors(df, "vec_id", "embedding", ((n if n is not None else -1) + 1, *inner), SCALE)


def _named(x: NDFrame | DataFrame, *names: str) -> DataFrame:
    df = x.df if isinstance(x, NDFrame) else x
    return df.toDF(*names)


def _text(name: str):
    """An array column as text, so that results compare by value everywhere."""
    return F.array_join(F.col(name).cast("array<string>"), ",").alias(name)


# ---- construction


@query("select a // 3 i, a % 3 j, 0::double v from range(6) t(a)")
def new_tensor(spark, sf_dir):
    return _named(S.new_tensor(spark, 2, 3), "i", "j", "v")


@query("select * from (values (0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 4), (1, 1, 5), (1, 2, 6)) t(i, j, v)")
def to_tensor(spark, sf_dir):
    return _named(S.to_tensor(spark, [[1, 2, 3], [4, 5, 6]], "bigint"), "i", "j", "v")


@query("select i * 64 + j as position, v from X")
def enumerate_cells(spark, sf_dir):
    return _x(spark, sf_dir).enumerate()


@query("select i, j, case when i between 1 and 4 and j between 8 and 71 then -v else v end v from (select i, j, v from X)")
def copy_from(spark, sf_dir):
    x = _x(spark, sf_dir)
    src = views.slice_(x.map(lambda v: -v), slice(1, 5), slice(8, 64))
    return _named(S.copy_from(x, src, (1, 8)), "i", "j", "v")


@query("select i, j, 0::bigint v from X")
def set_zero(spark, sf_dir):
    return _named(S.set_zero(_x(spark, sf_dir)), "i", "j", "v")


@query("select i, j, case when i = 3 and j = 5 then 77 else v end v from X")
def point_set(spark, sf_dir):
    return _named(_x(spark, sf_dir).set((3, 5), 77), "i", "j", "v")


@query("select i, j, case when i = 10 and j = 10 then v + 10 else v end v from X")
def point_update(spark, sf_dir):
    return _named(E.point_update(_x(spark, sf_dir), (10, 10), lambda v: v + 10), "i", "j", "v")


@query("select vec_id i, array_to_string(list_transform(embedding, lambda f: cast(round(f::double * 1024) as bigint)), ',') as vector from embeddings")
def to_vectors(spark, sf_dir):
    out = S.to_vectors(_x(spark, sf_dir))
    return out.select(F.col("i0").alias("i"), _text("vector"))


@query("select event_id, trim(regexp_replace(lower(hex(event_type)), '(..)', '\\1 ', 'g')) hex from events")
def hex_bytes(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", S.to_hex(F.col("event_type").cast("binary")).alias("hex"))


@query("select i, j, v from X")
def deep_copy(spark, sf_dir):
    return _named(S.deep_copy(_x(spark, sf_dir)), "i", "j", "v")


@query("select a // 12 i, a // 4 % 3 j, a % 4 k, a * a v from range(24) t(a)")
def from_values(spark, sf_dir):
    return _named(S.from_values(spark, [a * a for a in range(24)], (2, 3, 4), "bigint"), "i", "j", "k", "v")


def _unit_sql(seed: int, *key: str) -> str:
    """SQL of sampling.unit."""
    return f"('0x' || substr(md5(concat_ws(':', {seed}, {', '.join(key)})), 1, 13))::bigint / 4503599627370496.0::double"


@query(f"select i, j, -1 + 2 * ({_unit_sql(7, 'i', 'j')}) v from (select a // 50 i, a % 50 j from range(5000) t(a))")
def random_tensor(spark, sf_dir):
    return _named(S.random_tensor(spark, 100, 50, low=-1.0, high=1.0, seed=7), "i", "j", "v")


# ---- views and layout


@query("select j i, i j, v from X")
def transpose2d(spark, sf_dir):
    return _named(views.transpose(_x(spark, sf_dir)), "i", "j", "v")


@query("select i n, j % 8 i, j // 8 j, v from X")
def transpose_batched(spark, sf_dir):
    return _named(views.transpose_batched(_x(spark, sf_dir, 8, 8)), "n", "i", "j", "v")


@query("select i n, ((j // 4 % 4) * 4 + j % 4) * 4 + j // 16 as position, v from X")
def nchw_to_nhwc(spark, sf_dir):
    y = views.nchw_to_nhwc(_x(spark, sf_dir, 4, 4, 4))
    return y.df.select(F.col("i0").alias("n"), ((F.col("i1") * 4 + F.col("i2")) * 4 + F.col("i3")).alias("position"), "v")


@query("select i n, j % 4 c, j // 16 h, j // 4 % 4 w, v from X")
def nhwc_to_nchw(spark, sf_dir):
    return _named(views.nhwc_to_nchw(_x(spark, sf_dir, 4, 4, 4)), "n", "c", "h", "w", "v")


@query("select j // 4 % 4 h, j % 4 w, j // 16 c, i o, v from X")
def oihw_to_hwio(spark, sf_dir):
    return _named(views.oihw_to_hwio(_x(spark, sf_dir, 4, 4, 4)), "h", "w", "c", "o", "v")


@query("select i // 2 i, (j - 1) // 3 j, v from X where i % 2 = 0 and j >= 1 and (j - 1) % 3 = 0 and j < 60")
def slice_strided(spark, sf_dir):
    return _named(views.slice_(_x(spark, sf_dir), slice(None, None, 2), slice(1, 60, 3)), "i", "j", "v")


@query("select i, 63 - j j, v from X")
def slice_reversed(spark, sf_dir):
    return _named(views.slice_(_x(spark, sf_dir), slice(None), slice(None, None, -1)), "i", "j", "v")


@query("select i - 5 i, j - 7 j, v from X where i >= 5 and j >= 7")
def sub_matrix(spark, sf_dir):
    return _named(views.sub_matrix(_x(spark, sf_dir), 5, 7), "i", "j", "v")


@query("select i, j // 16 c, j % 16 p, v from X")
def reshape(spark, sf_dir):
    x = _x(spark, sf_dir)
    return _named(views.reshape(x, x.shape[0], 4, 16), "i", "c", "p", "v")


@query("select * from (select i, j, v from X union all select i + n, j, 2 * v from X, (select max(i) + 1 n from X))")
def concat(spark, sf_dir):
    x = _x(spark, sf_dir)
    return _named(views.concat([x, x.map(lambda v: v * 2)]), "i", "j", "v")


@query("select k as n, i, j, v from X, range(3) t(k)")
def broadcast_view(spark, sf_dir):
    x = _x(spark, sf_dir)
    return _named(views.broadcast_to(x, (3, *x.shape)), "n", "i", "j", "v")


@query("""with n as (select count(*) n from embeddings) select name, rank, size, contiguous from n, lateral (values
  ('plain', 2, n * 64, true), ('transposed', 2, n * 64, n = 1), ('rows', 2, n * 32, false), ('reshaped', 3, n * 64, true), ('row', 2, 64, true)
) t(name, rank, size, contiguous)""")
def metadata(spark, sf_dir):
    """Rank, size and contiguity of an array and views of it (every second column as "rows", one row as "row")."""
    x = _x(spark, sf_dir)
    seen = {
        "plain": x, "transposed": views.transpose(x), "rows": views.slice_(x, slice(None), slice(None, None, 2)),
        "reshaped": views.reshape(x, x.shape[0], 4, 16), "row": views.slice_(x, slice(0, 1)),
    }
    rows = [(name, y.rank, y.size, y.is_c_contiguous()) for name, y in seen.items()]
    return spark.createDataFrame(rows, "name string, rank int, size long, contiguous boolean")


_MORTON = " + ".join(f"(((i >> {b}) & 1) << {2 * b}) + (((j >> {b}) & 1) << {2 * b + 1})" for b in range(31))


@query(f"select cast({_MORTON} as bigint) as key, i i0, j i1, v from X")
def morton_order(spark, sf_dir):
    return views.morton_order(_x(spark, sf_dir))


# ---- elementwise


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax - sin(l_quantity), 6) v from lineitem")
def elementwise_fused(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem")
    body = lambda p, d, t, q: F.round(p * (1 - d) + t - F.sin(q), 6)
    out = elementwise.for_each_wide(df, body, "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    return out.select("l_orderkey", "l_linenumber", "v")


@query("select a.i n, a.j // 8 i, a.j % 8 j, a.v + b.v v from X a join X b on a.i = b.i and a.j = b.j % 8 * 8 + b.j // 8")
def for_each_strided(spark, sf_dir):
    x = _x(spark, sf_dir, 8, 8)
    return _named(elementwise.for_each(lambda a, b: a + b, x, views.transpose_batched(x)), "n", "i", "j", "v")


@query(
    "select i, j, ((u * u) // 2) % (case when u - 1 = 0 then 42 else u - 1 end) v from (select i, j, abs(v) + 1 u from X)"
)
def integer_body(spark, sf_dir):
    u = _x(spark, sf_dir).map(lambda v: F.abs(v) + 1)

    def body(a, b):
        half = F.call_function("div", a * b, F.lit(2))
        return half % F.when(a - 1 == 0, F.lit(42)).otherwise(a - 1)

    return _named(elementwise.for_each(body, u, u), "i", "j", "v")


@query("with m as (select j, cast(sum(v) as bigint) s from X group by j) select i, X.j j, v + s v from X join m on m.j = X.j")
def broadcast_add_row(spark, sf_dir):
    x = _x(spark, sf_dir)
    return _named(elementwise.broadcast(lambda a, b: a + b, x, reduce.reduce_axes(x, [0])), "i", "j", "v")


@query("with m as (select i, max(v) s from X group by i) select X.i i, j, v * s v from X join m on m.i = X.i")
def broadcast_scale_col(spark, sf_dir):
    x = _x(spark, sf_dir)
    top = reduce.reduce_axes(x, [1], "max")
    col = NDFrame(top.df.select("i0", F.lit(0).cast("long").alias("i1"), F.col("v").cast("long").alias("v")), (*top.shape, 1))
    return _named(elementwise.broadcast(lambda a, b: a * b, x, col), "i", "j", "v")


@query("select event_id, round(sin(value) + cos(value), 9) v from events")
def sin_plus_cos(spark, sf_dir):
    df = _table(spark, sf_dir, "events")
    return elementwise.for_each_wide(df, lambda v: F.round(F.sin(v) + F.cos(v), 9), "value").select("event_id", "v")


@query("select a.i, a.j, 3 * a.v + b.v v from X a join X b on a.i = b.i and a.j = 63 - b.j")
def axpy(spark, sf_dir):
    x = _x(spark, sf_dir)
    y = views.slice_(x, slice(None), slice(None, None, -1))
    return _named(elementwise.for_each(lambda a, b: F.lit(3) * a + b, x, y), "i", "j", "v")


@query("select 'argmax' fold, arg_max(event_id, value) event_id, max(value) v from (select * from events order by event_id)")
def staged_fold(spark, sf_dir):
    df = _table(spark, sf_dir, "events").select("event_id", "value").filter("value is not null")

    def inside(state, pdf):
        best = pdf.sort_values(["value", "event_id"], ascending=[False, True]).iloc[0]
        return min(state, (-best["value"], int(best["event_id"])))

    merge = lambda parts: parts.agg(F.min(F.struct("neg", "event_id")).alias("b"))
    out = elementwise.staged_fold(df, lambda: (float("inf"), -1), inside, lambda s: {"neg": s[0], "event_id": s[1]}, "neg double, event_id long", merge)
    return out.select(F.lit("argmax").alias("fold"), "b.event_id", (-F.col("b.neg")).alias("v"))


@query("""select vec_id, array_to_string(list_transform(embedding, lambda f: cast(round(f::double * 1024) as bigint) * 2), ',') doubled,
  cast(list_sum(list_transform(embedding, lambda f: cast(round(f::double * 1024) as bigint))) as bigint) total from embeddings""")
def lifted(spark, sf_dir):
    ints = F.transform("embedding", lambda f: F.round(f.cast("double") * SCALE).cast("long"))
    double = elementwise.lift_unary(lambda x: x * 2)
    total = elementwise.lift_reduction(lambda a, b: a + b, F.lit(0).cast("long"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", double(ints).alias("doubled"), total(ints).alias("total")).select("vec_id", _text("doubled"), "total")


# ---- reductions

for _kind in ("sum", "min", "max"):

    def _axis(spark, sf_dir, kind=_kind):
        return _named(reduce.reduce_axes(_x(spark, sf_dir), [0], kind), "j", "v").withColumn("v", F.col("v").cast("long"))

    _axis.__name__ = f"reduce_{_kind}_axis"
    query(f"select j, cast({_kind}(v) as bigint) v from X group by j")(_axis)


@query("""select cast(sum(l_quantity) as double) s, min(l_extendedprice) lo, max(l_extendedprice) hi, count(*) n from lineitem""")
def reduce_all(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem")
    return df.agg(reduce.fold("sum", F.col("l_quantity")).alias("s"), reduce.fold("min", F.col("l_extendedprice")).alias("lo"),
                  reduce.fold("max", F.col("l_extendedprice")).alias("hi"), F.count("*").alias("n"))


@query("select cast(coalesce(sum(value), 0) as double) s, coalesce(min(value), 'Infinity'::double) lo, coalesce(max(value), '-Infinity'::double) hi from events where false")
def reduce_empty(spark, sf_dir):
    df = _table(spark, sf_dir, "events").filter("false")
    return df.agg(*(reduce.fold(k, F.col("value")).cast("double").alias(n) for k, n in (("sum", "s"), ("min", "lo"), ("max", "hi"))))


@query("select cast(sum(l_quantity + l_linenumber) as double) v from lineitem")
def fused_reduction_xy(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").agg(reduce.fold("sum", F.col("l_quantity") + F.col("l_linenumber")).alias("v"))


@query("select p_size, round(sum(ln(1 + p_partkey % 3)), 6) ln_v, product(p_partkey % 2 * 2 - 1) sign from part group by p_size")
def reduce_product(spark, sf_dir):
    """The product of (1 + key mod 3) with the key's sign by parity, over all parts: sign * exp(ln_v). A plain product
    leaves the range of a double, so its size is the sum of logarithms; the signs are multiplied."""
    ln = F.log((1 + F.col("p_partkey") % 3).cast("double"))
    sign = reduce.fold("product", F.col("p_partkey") % 2 * 2 - 1)
    return _table(spark, sf_dir, "part").groupBy("p_size").agg(F.round(reduce.fold("sum", ln), 6).alias("ln_v"), sign.alias("sign"))


@query("""with s as (select l_orderkey k, sum(cast(round(l_extendedprice * 100) as bigint)) / 100.0::double y from lineitem group by 1)
select round(avg(case when greatest(abs(o_totalprice), abs(y)) = 0 then 0 else abs(o_totalprice - y) / greatest(abs(o_totalprice), abs(y)) end), 8) mean_relative_error,
  round(avg(abs(o_totalprice - y)), 4) mean_absolute_error from orders join s on o_orderkey = k""")
def error_metrics(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    y = lines.agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / 100.0).alias("y"))
    df = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(y, "o_orderkey")
    return reduce.mean_errors(df, "y", "o_totalprice").select(
        F.round("mean_relative_error", 8).alias("mean_relative_error"), F.round("mean_absolute_error", 4).alias("mean_absolute_error")
    )


_SOFT = "exp((v - max(v) over (partition by i)) / 1024.0::double)"


@query(f"select i, j, round(e / sum(e) over (partition by i), 9) v from (select i, j, {_SOFT} e from X)")
def softmax_rows(spark, sf_dir):
    x = _x(spark, sf_dir).map(lambda v: v / float(SCALE))
    return _named(reduce.softmax(x).map(lambda v: F.round(v, 9)), "i", "j", "v")


@query("select i, m, round(sum(exp((v - m0) / 1024.0::double)), 8) s from (select i, v, max(v) over (partition by i) m0, max(v / 1024.0::double) over (partition by i) m from X) group by i, m")
def max_sumexp(spark, sf_dir):
    x = _x(spark, sf_dir).map(lambda v: v / float(SCALE))
    return reduce.max_sumexp(x.df, ["i0"], "v").select(F.col("i0").alias("i"), "m", F.round("s", 8).alias("s"))


@query("select i, round(max(m) / 1024.0::double + ln(sum(exp((v - m) / 1024.0::double))), 8) v from (select i, v, max(v) over (partition by i) m from X) group by i")
def logsumexp_rows(spark, sf_dir):
    x = _x(spark, sf_dir).map(lambda v: v / float(SCALE))
    return reduce.logsumexp(x.df, ["i0"], "v").select(F.col("i0").alias("i"), F.round("v", 8).alias("v"))


@query("select i, min(j) j, v from (select i, j, v, max(v) over (partition by i) m from X) where v = m group by i, v")
def argmax_rows(spark, sf_dir):
    x = _x(spark, sf_dir)
    return _named(reduce.argmax(x.df, ["i0"], "i1", "v"), "i", "j", "v").withColumn("v", F.col("v").cast("long"))


@query("""with l as (select i, max(m) / 1024.0::double + ln(sum(exp((v - m) / 1024.0::double))) z from (select i, v, max(v) over (partition by i) m from X) group by i)
select X.i i, round(z - v / 1024.0::double, 8) v from X join l on l.i = X.i join embeddings e on e.vec_id = X.i and e.label = X.j""")
def softmax_cross_entropy(spark, sf_dir):
    x = _x(spark, sf_dir).map(lambda v: v / float(SCALE))
    labels = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i0"), F.col("label").cast("long").alias("label"))
    return reduce.softmax_cross_entropy(x, labels).select(F.col("i0").alias("i"), F.round("v", 8).alias("v"))


# ---- linear algebra


@query("select a.j p, b.j q, cast(sum(a.v * b.v) as bigint) v from X a join X b using (i) group by all")
def gemm_gram(spark, sf_dir):
    x = _x(spark, sf_dir)
    return _named(linalg.gemm(views.transpose(x), x), "p", "q", "v")


def _outer(a: NDFrame, b: NDFrame) -> NDFrame:
    """A B^T of integer matrices, exact while every sum stays below 2 ** 53."""
    return linalg.gemm_nt(a, b).map(lambda v: v.cast("long"))


@query("select a.i // 2 p, b.i // 2 q, cast(sum(a.v * b.v) as bigint) v from X a join X b using (j) where a.i % 2 = 0 and b.i % 2 = 0 group by all")
def gemm_xxt_slice(spark, sf_dir):
    half = views.slice_(_x(spark, sf_dir), slice(None, None, 2))
    return _named(_outer(half, half), "p", "q", "v")


@query("select p, q, 2 * s + 3 * c.v v from (select a.j p, b.j q, cast(sum(a.v * b.v) as bigint) s from X a join X b using (i) group by all) join (select i p, j q, v from X) c using (p, q)")
def gemm_alpha_beta(spark, sf_dir):
    x = _x(spark, sf_dir)
    c = views.slice_(x, slice(0, 64))
    return _named(linalg.gemm(views.transpose(x), x, 2, 3, c), "p", "q", "v")


@query("select n, p, q, cast(sum(a * b) as bigint) v from (select i n, j // 8 p, j % 8 k, v a from X) join (select i n, j // 8 k, j % 8 q, v b from X) using (n, k) group by all")
def gemm_batched(spark, sf_dir):
    x = _x(spark, sf_dir, 8, 8)
    return _named(linalg.gemm(x, x, batch=1), "n", "p", "q", "v")


@query("with q as (select j p, b q, cast(sum(v * w) as bigint) v from X join (select i, j b, v w from X) using (i) group by all) select p, q, greatest(v, 0) v from q")
def gemm_relu(spark, sf_dir):
    x = _x(spark, sf_dir)
    return _named(linalg.gemm(views.transpose(x), x, epilogue=lambda v: F.greatest(v, F.lit(0).cast("long"))), "p", "q", "v")


@query("select a.j p, b.j q, cast(sum(abs(a.v) * (b.v * b.v)) as bigint) v from X a join X b using (i) group by all")
def gemm_prologue(spark, sf_dir):
    x = _x(spark, sf_dir)
    return _named(linalg.gemm(views.transpose(x), x, prologue=(F.abs, lambda v: v * v)), "p", "q", "v")


@query("""select n.n as rows, 2 * 64 * 64 * n.n gemm_ops, 2 * 64 * n.n gemm_data, 2 * n.n * 64 * 9 conv_ops, 64 * n.n + 9 conv_data, 9 * 64 workspace
from (select count(*) n from embeddings) n""")
def calculators(spark, sf_dir):
    """Operations and elements of X^T X, and of a padded 3 x 3 convolution of the vectors as 8 x 8 images."""
    n = _x(spark, sf_dir).shape[0]
    a, b, image, kernel = (64, n), (n, 64), (n, 1, 8, 8), (1, 1, 3, 3)
    row = (n, linalg.required_ops(a, b), linalg.required_data(a, b), conv.conv_required_ops(image, kernel, (1, 1)),
           conv.conv_required_data(image, kernel), conv.im2col_workspace(image, kernel, (1, 1)))
    return spark.createDataFrame([row], "rows long, gemm_ops long, gemm_data long, conv_ops long, conv_data long, workspace long")


@query("""with m as (select l_partkey % 500 p, l_suppkey s, cast(sum(cast(l_quantity as bigint)) as bigint) v from lineitem group by all)
select a.s s, b.s t, cast(sum(a.v * b.v) as bigint) v from m a join m b using (p) group by all""")
def gemm_part_supp(spark, sf_dir):
    """All suppliers against all; quantities are positive, so pairs without a part in common are the zeros."""
    df = _table(spark, sf_dir, "lineitem").filter("l_partkey is not null and l_suppkey is not null")
    top = df.agg(F.max("l_suppkey")).first()[0]
    cells = df.groupBy((F.col("l_partkey") % 500).alias("i0"), F.col("l_suppkey").alias("i1")).agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))
    m = views.transpose(NDFrame(cells, (500, (top if top is not None else -1) + 1), sparse=True))
    return _named(_outer(m, m).df.filter("v != 0"), "s", "t", "v")


@query("select a.j p, b.j q, round(cast(sum(a.v * b.v) as double), 3) v from X a join X b using (i) group by all")
def gemm_blocks(spark, sf_dir):
    x = _x(spark, sf_dir).cast("double")
    edge = 48
    packed = linalg.to_blocks(x, edge)
    made = linalg.gemm_blocks(linalg.to_blocks(views.transpose(x), edge), packed)
    return _named(linalg.from_blocks(made).map(lambda v: F.round(v, 3)), "p", "q", "v")


@query("""with g as (select a.j p, b.j q, cast(sum(a.v * b.v) as bigint) v from X a join X b using (i) group by all)
select x.i i, g.q q, cast(sum(x.v * g.v) as bigint) v from X x join g on x.j = g.p group by all""")
def gemm_chain(spark, sf_dir):
    x = _x(spark, sf_dir)
    return _named(linalg.chain(x, views.transpose(x), x), "i", "q", "v")


# ---- convolution

_KERNEL3 = [[1, 2, -1], [0, 1, 0], [-2, 1, 3]]
_K3 = "(values " + ", ".join(f"({h}, {w}, {k})" for h, r in enumerate(_KERNEL3) for w, k in enumerate(r)) + ") k(kh, kw, k)"


def _conv_sql(pad: int, stride: int, out: int, kernel: str = _K3) -> str:
    grid = f"(select n, a oh, b ow from (select distinct i n from X), range({out}) s(a), range({out}) t(b))"
    hit = f"""(select i n, (j // 8 + {pad} - kh) rh, (j % 8 + {pad} - kw) rw, v * k x from X, {kernel})"""
    return f"""select n, 0 o, oh, ow, coalesce(cast(sum(x) as bigint), 0) v from {grid} g
left join (select n, rh // {stride} oh, rw // {stride} ow, x from {hit} where rh >= 0 and rw >= 0 and rh % {stride} = 0 and rw % {stride} = 0) h
using (n, oh, ow) group by all"""


def _conv3(spark, sf_dir, pad: int, stride: int, how=conv.conv2d) -> DataFrame:
    k = S.to_tensor(spark, [[_KERNEL3]], "bigint")
    return _named(how(_x(spark, sf_dir, 1, 8, 8), k, (pad, pad), (stride, stride)), "n", "o", "oh", "ow", "v")


@query(_conv_sql(1, 1, 8))
def conv2d_pad1_s1(spark, sf_dir):
    return _conv3(spark, sf_dir, 1, 1)


@query(_conv_sql(1, 2, 4))
def conv2d_s2(spark, sf_dir):
    return _conv3(spark, sf_dir, 1, 2)


@query(_conv_sql(0, 1, 6))
def conv2d_valid(spark, sf_dir):
    return _conv3(spark, sf_dir, 0, 1)


@query(_conv_sql(1, 2, 4))
def conv2d_im2col(spark, sf_dir):
    return _conv3(spark, sf_dir, 1, 2, conv.conv2d_im2col)


@query(_conv_sql(1, 2, 4))
def conv2d_strips(spark, sf_dir):
    return _conv3(spark, sf_dir, 1, 2, conv.conv2d_strips)


@query(_conv_sql(1, 1, 8))
def conv2d_shifted(spark, sf_dir):
    return _conv3(spark, sf_dir, 1, 1, conv.conv2d_shifted)


_SOBEL = "(select a kh, b kw, case when a = 1 then 2 else 1 end * (1 - b) k from range(3) s(a), range(3) t(b)) k"


@query(_conv_sql(1, 1, 8, _SOBEL))
def conv2d_separable(spark, sf_dir):
    column = S.to_tensor(spark, [[[[1], [2], [1]]]], "bigint")
    row = S.to_tensor(spark, [[[[1, 0, -1]]]], "bigint")
    return _named(conv.conv2d_separable(_x(spark, sf_dir, 1, 8, 8), column, row, (1, 1)), "n", "o", "oh", "ow", "v")


@query(f"""with taps as (select * from {_K3})
select n, kh * 3 + kw r, oh * 8 + ow p, coalesce(v, 0) v
from (select distinct i n from X), taps, range(8) a(oh), range(8) b(ow)
left join (select i m, j // 8 h, j % 8 w, v from X) x on m = n and h = oh + kh - 1 and w = ow + kw - 1""")
def im2col(spark, sf_dir):
    return _named(conv.im2col(_x(spark, sf_dir, 1, 8, 8), (1, 1, 3, 3), (1, 1)), "n", "r", "p", "v")


@query("""select i n, o, j // 4 % 4 oh, j % 4 ow, cast(sum(v * (1 + o * 4 + j // 16 - 5)) as bigint) v from X, range(2) t(o) group by all""")
def conv2d_1x1(spark, sf_dir):
    k = S.to_tensor(spark, [[[[1 + o * 4 + c - 5]] for c in range(4)] for o in range(2)], "bigint")
    return _named(conv.conv2d(_x(spark, sf_dir, 4, 4, 4), k), "n", "o", "oh", "ow", "v")


@query("""select n, o, oh, ow, cast(sum(v * (o - c + kh - kw)) as bigint) v from (
  select i n, o, j // 16 c, kh, kw, j // 4 % 4 - kh oh, j % 4 - kw ow, v from X, range(2) a(o), range(2) b(kh), range(2) d(kw))
where oh between 0 and 2 and ow between 0 and 2 group by all""")
def conv2d_multichannel(spark, sf_dir):
    k = [[[[o - c + h - w for w in range(2)] for h in range(2)] for c in range(4)] for o in range(2)]
    return _named(conv.conv2d(_x(spark, sf_dir, 4, 4, 4), S.to_tensor(spark, k, "bigint")), "n", "o", "oh", "ow", "v")


@query("""select n, o, oh, ow, cast(sum(v * (1 + o + c % 2 + kh)) as bigint) v from (
  select i n, o, j // 16 c, kh, kw, j // 4 % 4 - 2 * kh oh, j % 4 - 2 * kw ow, v from X, range(4) a(o), range(2) b(kh), range(2) d(kw)
  where (j // 16) // 2 = o // 2)
where oh between 0 and 1 and ow between 0 and 1 group by all""")
def conv2d_grouped_dilated(spark, sf_dir):
    k = [[[[1 + o + c + h for _ in range(2)] for h in range(2)] for c in range(2)] for o in range(4)]
    y = conv.conv2d(_x(spark, sf_dir, 4, 4, 4), S.to_tensor(spark, k, "bigint"), dilation=(2, 2), groups=2)
    return _named(y, "n", "o", "oh", "ow", "v")


# ---- functions


@query("select event_id, round(exp(least(greatest(value, -88), 88) / 1000), 8) e, round(exp(least(greatest((value - 500) / 5, -88), 88)) * 1e-30, 4) clamped from events")
def exp_clamped(spark, sf_dir):
    v = F.col("value")
    e = F.round(F.exp(F.least(F.greatest(v, F.lit(-88)), F.lit(88)) / 1000), 8)
    return _table(spark, sf_dir, "events").select("event_id", e.alias("e"), F.round(M.exp_clamped((v - 500) / 5) * 1e-30, 4).alias("clamped"))


@query("select event_id, round(1 / (1 + exp(-(value - 50) / 10)), 9) s, greatest(value - 50, 0) r, round(tanh(value / 100), 9) t from events")
def activations(spark, sf_dir):
    v = F.col("value")
    return _table(spark, sf_dir, "events").select(
        "event_id", F.round(M.sigmoid((v - 50) / 10), 9).alias("s"), M.relu(v - 50).alias("r"), F.round(M.tanh(v / 100), 9).alias("t")
    )


@query("select event_id, round(ln(value + 1), 9) ln, round(log2(value + 1), 9) log2, round(pow(value, 1.5), 4) p, round(sqrt(value), 9) q, round(pow(2, value / 100), 8) e from events where value >= 0")
def elementary(spark, sf_dir):
    v = F.col("value")
    return _table(spark, sf_dir, "events").filter("value >= 0").select(
        "event_id", F.round(M.log(v + 1), 9).alias("ln"), F.round(M.log2(v + 1), 9).alias("log2"), F.round(M.pow_(v, F.lit(1.5)), 4).alias("p"),
        F.round(M.sqrt(v), 9).alias("q"), F.round(M.exp2(v / 100), 8).alias("e"))


# ---- sampling


@query("select i, j, cast(sum(abs(v)) over (partition by i order by j) as bigint) cdf from X")
def cumsum_rows(spark, sf_dir):
    x = _x(spark, sf_dir).map(F.abs)
    return sampling.cumsum(x.df, ["i0"], "i1", "v").select(F.col("i0").alias("i"), F.col("i1").alias("j"), "cdf")


@query("select o_orderkey, cast(sum(cast(round(o_totalprice * 100) as bigint)) over (order by o_orderkey) as bigint) cdf from orders")
def cumsum_long(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    return sampling.cumsum_long(df, "o_orderkey", "v", 1000).select("o_orderkey", "cdf")


def _searchsorted(spark, sf_dir, left: bool) -> DataFrame:
    x = sampling.cumsum(_x(spark, sf_dir).map(F.abs).df, ["i0"], "i1", "v")
    probes = x.select("i0", F.col("i1").alias("id"), (F.col("i1") * 77 + F.col("v")).alias("p"))
    return sampling.searchsorted(x, probes, ["i0"], "cdf", "p", left).select(F.col("i0").alias("i"), "id", "position")


def _searchsorted_sql(op: str) -> str:
    return f"""with c as (select i, j, abs(v) v, sum(abs(v)) over (partition by i order by j) cdf from X)
select p.i i, p.j id, count(c.cdf) as position from (select i, j, j * 77 + v p from c) p left join c on c.i = p.i and c.cdf {op} p.p group by all"""


@query(_searchsorted_sql("<"))
def searchsorted_left(spark, sf_dir):
    return _searchsorted(spark, sf_dir, True)


@query(_searchsorted_sql("<="))
def searchsorted_right(spark, sf_dir):
    return _searchsorted(spark, sf_dir, False)


@query("""with c as (select i, j, sum(abs(v)) over (partition by i order by j) cdf, sum(abs(v)) over (partition by i) total from X)
select i, min(j) j from c where cdf > (i % 97) / 97.0::double * total group by i""")
def multinomial_invcdf(spark, sf_dir):
    x = _x(spark, sf_dir).map(F.abs)
    u = x.df.select("i0").distinct().select("i0", ((F.col("i0") % 97) / 97.0).alias("u"))
    return _named(sampling.draw(x, u), "i", "j")


@query("select i, j, case when j = i % 64 then 5000 else abs(v) end v from X")
def sampler_update(spark, sf_dir):
    x = _x(spark, sf_dir).map(F.abs)
    changes = x.df.filter("i1 = i0 % 64").select("i0", "i1", F.lit(5000).cast("long").alias("w"))
    return _named(sampling.update_weights(x, changes), "i", "j", "v")


@query("""with k as (select i, j, -ln(1 - ((i * 131 + j * 71) % 997) / 997.0::double) / abs(v) k from X where v != 0)
select i, r - 1 draw, j from (select i, j, row_number() over (partition by i order by k, j) r from k) where r <= 5""")
def sample_wo_replacement_keys(spark, sf_dir):
    x = _x(spark, sf_dir).map(F.abs)
    u = ((F.col("i0") * 131 + F.col("i1") * 71) % 997) / 997.0
    return _named(sampling.sample_without_replacement(x, 5, u), "i", "draw", "j")


@query("""with c as (select i, j, v, sum(abs(v)) over (partition by i order by j) cdf, sum(abs(v)) over (partition by i) total from X),
d as (select i, min(j) d from c where cdf > 0.5::double * total group by i) select c.i i, j, case when j = d then 0 else abs(v) end v from c left join d using (i)""")
def draw_and_remove(spark, sf_dir):
    x = _x(spark, sf_dir).map(F.abs)
    _, left = sampling.draw_and_remove(x, x.df.select("i0").distinct().withColumn("u", F.lit(0.5)))
    return _named(left, "i", "j", "v")


def _tree(spark, sf_dir) -> sampling.WeightTree:
    """Weight trees of the vectors' absolute values, with one item changed and one removed in each."""
    x = _x(spark, sf_dir).map(F.abs)
    rows = x.df.select("i0").distinct()
    changes = rows.select("i0", F.explode(F.array(F.struct((F.col("i0") % 64).alias("i1"), F.lit(5000).alias("w")),
                                                  F.struct(((F.col("i0") + 7) % 64).alias("i1"), F.lit(0).alias("w")))).alias("c"))
    return sampling.weight_tree(x).update(changes.select("i0", "c.i1", "c.w"))


_CHANGED = "w as (select i, j, case when j = i % 64 then 5000 when j = (i + 7) % 64 then 0 else abs(v) end v from X)"


@query(f"with {_CHANGED} select i, j, cast(v as bigint) v from w")
def weight_tree_update(spark, sf_dir):
    return _named(_tree(spark, sf_dir).weights(), "i", "j", "v")


@query(f"""with {_CHANGED}, c as (select i, j, sum(v) over (partition by i order by j) cdf, sum(v) over (partition by i) total from w)
select i, t, min(j) j from c, range(20) u(t) where cdf > t / 20.0::double * total group by i, t""")
def weight_tree_draw(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    u = tree.df.select("i0", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("t")).withColumn("u", F.col("t") / 20.0)
    return tree.draw(u).select(F.col("i0").alias("i"), "t", F.col("i1").alias("j"))


@query(f"select * from part where p_retailprice > 0 order by -ln(1 - {_unit_sql(0, 'p_partkey')}) / p_retailprice, p_partkey limit 100")
def reservoir(spark, sf_dir):
    return sampling.reservoir(_table(spark, sf_dir, "part"), 100, "p_partkey", F.col("p_retailprice"))


@query(f"""with c as (select i, j, sum(abs(v)) over (partition by i order by j) cdf, sum(abs(v)) over (partition by i) total from X)
select i, min(j) j from c where cdf > ({_unit_sql(3, 'i')}) * total group by i""")
def draw_seeded(spark, sf_dir):
    return _named(sampling.draw_seeded(_x(spark, sf_dir).map(F.abs), 3), "i", "j")


# ---- stencils


def _jacobi_sql(steps: int) -> str:
    out = "with g0 as (select i n, j // 8 i, j % 8 j, v / 1024.0::double v from X)"
    for t in range(steps):
        out += f""", g{t + 1} as (select c.n n, c.i i, c.j j, case when c.i between 1 and 6 and c.j between 1 and 6 then 0.25 * (
  lag(v, 1, 0.0) over r + lead(v, 1, 0.0) over r + lag(v, 1, 0.0) over q + lead(v, 1, 0.0) over q) else v end v from g{t} c
  window r as (partition by n, i order by j), q as (partition by n, j order by i))"""
    return out + f" select n, i, j, round(v, 9) v from g{steps}"


def _jacobi(spark, sf_dir, steps: int) -> DataFrame:
    g = _x(spark, sf_dir, 8, 8).map(lambda v: v / float(SCALE))
    return _named(stencil.jacobi(g, steps).map(lambda v: F.round(v, 9)), "n", "i", "j", "v")


@query(_jacobi_sql(1))
def jacobi_step(spark, sf_dir):
    return _jacobi(spark, sf_dir, 1)


@query(_jacobi_sql(4))
def jacobi_4_steps(spark, sf_dir):
    return _jacobi(spark, sf_dir, 4)


#: One interior cell after the other, ten times; p is the cell's position from 1.
_SWEEPS = """with recursive r(n, k, g) as (select i, 0, list(v / 1024.0::double order by j) from X group by i union all
  select n, k + 1, g[1:p - 1] || [0.25 * (g[p - 8] + g[p + 8] + g[p - 1] + g[p + 1])] || g[p + 1:64]
  from (select n, k, g, 10 + k % 36 // 6 * 8 + k % 6 p from r where k < 360))
select n, (t - 1) // 8 i, (t - 1) % 8 j, round(g[t], 9) v from r, range(1, 65) u(t) where k = 360"""


@query(_SWEEPS)
def gauss_seidel(spark, sf_dir):
    g = _x(spark, sf_dir, 8, 8).map(lambda v: v / float(SCALE))
    return _named(stencil.gauss_seidel(g, 10).map(lambda v: F.round(v, 9)), "n", "i", "j", "v")


# ---- recurrent cells: the vectors as eight steps of eight features, two units


def _gate(seed: int) -> recurrent.Gate:
    weight = lambda a, b: ((a * 5 + b * 3 + seed) % 7 - 3) / 8
    return recurrent.Gate([[weight(a, b) for b in range(8)] for a in range(2)], [[weight(a, b + 8) for b in range(2)] for a in range(2)], [0.125, -0.25])


def _gate_sql(gate: recurrent.Gate, unit: int, t: int, *h: str) -> str:
    terms = [f"{w} * e[{8 * t + k + 1}]" for k, w in enumerate(gate.w[unit])] + [f"{u} * {x}" for u, x in zip(gate.u[unit], h)]
    return f"({' + '.join(terms)} + {gate.b[unit]})"


def _steps_sql(step: Callable[[int], str]) -> str:
    """SQL of eight steps from zero states a, b."""
    out = "with s0 as (select vec_id, list_transform(embedding, lambda f: f::double) e, 0.0::double a, 0.0::double b from embeddings)"
    return out + "".join(f", s{t + 1} as ({step(t)})" for t in range(8)) + " select vec_id, round(a, 9) a, round(b, 9) b from s8"


def _states(spark, sf_dir, cell: Callable) -> DataFrame:
    last = cell(recurrent.windows("embedding", 8))
    out = _table(spark, sf_dir, "embeddings").select("vec_id", last.alias("h"))
    return out.select("vec_id", *(F.round(F.get("h", F.lit(k)), 9).alias(c) for k, c in enumerate("ab")))


@query(_steps_sql(lambda t: f"select vec_id, e, tanh{_gate_sql(_gate(0), 0, t, 'a', 'b')} a, tanh{_gate_sql(_gate(0), 1, t, 'a', 'b')} b from s{t}"))
def rnn_last(spark, sf_dir):
    return _states(spark, sf_dir, lambda seq: recurrent.rnn(seq, _gate(0)))


def _gru_sql(t: int) -> str:
    gates = ", ".join(f"1 / (1 + exp(-{_gate_sql(_gate(g), k, t, 'a', 'b')})) {n}{k}" for g, n in ((1, "z"), (2, "r")) for k in (0, 1))
    new = [f"tanh{_gate_sql(_gate(4), k, t, '(r0 * a)', '(r1 * b)')}" for k in (0, 1)]
    mixed = ", ".join(f"z{k} * {h} + (1 - z{k}) * {new[k]} {h}" for k, h in enumerate("ab"))
    return f"select vec_id, e, {mixed} from (select vec_id, e, a, b, {gates} from s{t})"


@query(_steps_sql(_gru_sql))
def gru_last(spark, sf_dir):
    return _states(spark, sf_dir, lambda seq: recurrent.gru(seq, _gate(1), _gate(2), _gate(4)))


# ---- index notation


@query("select j i, i j, v from X")
def einsum_transpose(spark, sf_dir):
    a = E.Fn(_x(spark, sf_dir), "a")
    return _named(E.assign(("j", "i"), a["i", "j"]), "i", "j", "v")


@query("select i, j, v + 2 * v + v * v v from X")
def einsum_add3(spark, sf_dir):
    x = _x(spark, sf_dir)
    a, b = E.Fn(x, "a"), E.Fn(x, "b")
    return _named(E.assign(("i", "j"), a["i", "j"] + b["i", "j"] * 2 + a["i", "j"] * b["i", "j"]), "i", "j", "v")


@query("select a.i p, b.i q, cast(sum(a.v * b.v) as bigint) v from X a join X b using (j) group by all")
def einsum_matmul(spark, sf_dir):
    x = _x(spark, sf_dir).cast("double")  # exact below 2 ** 53
    return _named(E.einsum("ij,kj->ik", x, x).map(lambda v: v.cast("long")), "p", "q", "v")


@query("select i, cast(sum(v) as bigint) v from X where j // 8 = j % 8 group by i")
def einsum_trace(spark, sf_dir):
    return _named(E.einsum("nii->n", _x(spark, sf_dir, 8, 8)), "i", "v")


@query("select a.i i, a.j j, case when a.v = b.v then 0 else a.v - b.v end v from X a join (select j, max(v) v from X group by j) b using (j)")
def einsum_select(spark, sf_dir):
    """0 where a cell is the largest of its column, else how far it is below."""
    x = _x(spark, sf_dir)
    top = reduce.reduce_axes(x, [0], "max")
    a, m = E.Fn(x, "a")["i", "j"], E.Fn(top, "m")["j"]
    return _named(E.assign(("i", "j"), E.Select(a.eq(m), E.node(0), a - m)).cast("bigint"), "i", "j", "v")


@query("select i, j, round(ln(abs(v) + 1) * 2 + exp(v / 4096.0::double), 9) v from X")
def einsum_functions(spark, sf_dir):
    """The expression that a function on symbols builds: ln(a) * 2 + exp(b)."""
    x = _x(spark, sf_dir)
    f = lambda a, b: E.fma(E.ln(a["i", "j"]), E.node(2), E.exp(b["i", "j"]))
    e = E.generate(f, x.map(lambda v: F.abs(v) + 1), x.map(lambda v: v / 4096.0))
    return _named(E.assign(("i", "j"), e).map(lambda v: F.round(v, 9)), "i", "j", "v")


@query("select * from (values ('sum', '((x0[i, k] * x1[k, j]) + 3)', 2, 2), ('call', 'log(x0[i, j])', 2, 1)) t(name, expression, rank, operands)")
def expression_text(spark, sf_dir):
    """How expressions print, with the letters and operands that the planner finds in them."""
    x = S.new_tensor(spark, 2, 2)
    made = {"sum": E.generate(lambda a, b: a["i", "k"] * b["k", "j"] + 3, x, x), "call": E.generate(lambda a: E.ln(a["i", "j"]), x)}
    left = ("i", "j")
    rows = [(n, repr(e), E.assign(left, e).rank, len(E._leaves(e))) for n, e in made.items()]
    return spark.createDataFrame(rows, "name string, expression string, rank int, operands int")


# ---- integers, metadata, programs


@query("""with n as (select count(*) n from orders), c as (select o_orderkey, row_number() over (order by o_orderkey) - 1 p from orders)
select o_orderkey, case when p < (n % 12) * (n // 12 + 1) then p // (n // 12 + 1) else n % 12 + (p - (n % 12) * (n // 12 + 1)) // (n // 12) end chunk from c, n""")
def balanced_chunks(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select("o_orderkey")
    n = df.count()
    return chunking.in_chunks(df, "o_orderkey", n, 12).select("o_orderkey", "chunk")


@query("select o_orderkey, o_orderkey - o_orderkey % 24 down, ((o_orderkey + 23) // 24) * 24 up, cast(case when o_orderkey < 2 then 1 else pow(2, ceil(log2(o_orderkey))) end as bigint) p2 from orders")
def round_step(spark, sf_dir):
    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(k, chunking.round_down(k, 24).alias("down"), chunking.round_up(k, 24).alias("up"), chunking.next_power_of_two(k).alias("p2"))


@query("""select vec_id, (label + 2) || ',4,16' shape, '64,16,1' strides, (label + 2) * 64 size, '16,4,' || (label + 2) reversed,
  (label + 2) || ',9,4,16' inserted, (label + 2) || ',16' deleted, 16 last, '[' || (label + 2) || ', 4, 16]' as text from embeddings""")
def array_meta_ops(spark, sf_dir):
    shape = F.array((F.col("label") + 2).cast("long"), F.lit(4).cast("long"), F.lit(16).cast("long"))
    return _table(spark, sf_dir, "embeddings").select(
        "vec_id", shape.alias("shape"), A.strides(shape).alias("strides"), A.product(shape).alias("size"), A.reversed_(shape).alias("reversed"),
        A.insert(shape, 1, 9).alias("inserted"), A.delete(shape, 1).alias("deleted"), A.at(shape, -1).alias("last"), A.text(shape).alias("text"),
    ).select("vec_id", _text("shape"), _text("strides"), "size", _text("reversed"), _text("inserted"), _text("deleted"), "last", "text")


@query("select * from (values ('hello', 'Hi'), ('sum', chr(7))) t(name, output)")
def tape_machine(spark, sf_dir):
    programs = [("hello", "+" * 72 + ".>" + "+" * 105 + "."), ("sum", "+++>++++[<+>-]<.")]
    return tape.execute_column(spark.createDataFrame(programs, "name string, program string"), "program").select("name", "output")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the Gram matrix of the quantised embeddings."""
    return gemm_gram(spark, sf_dir)


