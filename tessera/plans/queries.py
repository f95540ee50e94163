"""One query for each operator, with its SQL.

Results are rounded, since sums of doubles depend on their order.
"""

from __future__ import annotations

import math
import operator
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import library as lib
from ..functions.kernel import kernel, named
from ..operators import adverbs, arrays
from ..operators.tensor import Tensor, arange, column, from_numpy
from ..sources.tables import table, vectors
from ..types import FLOAT64 as _DOUBLE
from . import programs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = re.sub(r"(, \d\)) AS ", r"\1 + 0.0 AS ", sql)  # rounding gives -0.0 there, but not in Spark
        return f

    return add


def out(x: Tensor, digits: int | None = 6, **more: Tensor) -> DataFrame:
    """i0, i1 ... and v of a tensor, and columns of others over the same frame."""
    x, *others = adverbs.align([x, *more.values()]) if more else [x]
    named_columns = {"v": x} | dict(zip(more, others))
    cols = [(F.round(t.column, digits) if digits is not None and not t.inner and t.dtype.is_float else t.column).alias(n) for n, t in named_columns.items()]
    return x.frame.select(*(F.col(c).cast("long").alias(n) for c, n in zip(x.index or (), x.names())), *cols)


def matrix(spark: SparkSession, folder: str) -> Tensor:
    return vectors(spark, folder, "embeddings", "embedding")[0]


_LONG = "long AS (SELECT vec_id AS i0, unnest(range(len(embedding))) AS i1, unnest(embedding) AS v FROM embeddings)"

# -- map


@query("SELECT round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS v FROM lineitem")
def map_arith(spark, folder):
    price, discount, tax = vectors(spark, folder, "lineitem", "l_extendedprice", "l_discount", "l_tax")
    return out(adverbs.map(lambda p, d, t: p * (1 - d) * (1 + t), price, discount, tax))


@query("SELECT event_id AS i0, round(value * 2.5 + 1, 6) AS v FROM events")
def map_broadcast(spark, folder):
    (value,) = vectors(spark, folder, "events", "value")
    return out(value * 2.5 + 1)


@query("SELECT vec_id AS i0, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS v FROM embeddings")
def map_axis0(spark, folder):
    def squares(row):
        return sum(adverbs.map(lambda e: float(e) * float(e), row))

    return out(adverbs.map(squares, matrix(spark, folder), axis=0))


@query("SELECT vec_id AS i0, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 6) AS v FROM embeddings")
def map_fixed(spark, folder):
    weights = np.arange(1.0, 65.0)
    return out(adverbs.map(lambda w, row: sum(w * adverbs.map(float, row)), matrix(spark, folder), fixed=(weights,), axis=0))


@query("SELECT o_orderkey AS i0, round(o_totalprice / 2, 6) AS v, round(sqrt(o_totalprice), 6) AS root FROM orders")
def map_multi_output(spark, folder):
    (price,) = vectors(spark, folder, "orders", "o_totalprice")
    half, root = adverbs.map(lambda p: (p / 2, math.sqrt(p)), price)
    return out(half, root=root)


_CND = "(CASE WHEN {0} < 0 THEN 1 - {1} ELSE {1} END)"


def _cnd_sql(x: str) -> str:
    k = f"(1.0 / (1.0 + 0.2316419 * abs({x})))"
    poly = f"{k} * (0.31938153 + {k} * (-0.356563782 + {k} * (1.781477937 + {k} * (-1.821255978 + {k} * 1.330274429))))"
    return _CND.format(x, f"(1.0 - exp(-{x} * {x} / 2.0) / sqrt(2.0 * pi()) * {poly})")


@query(f"SELECT event_id AS i0, round({_cnd_sql('x')}, 6) AS v FROM (SELECT event_id, value / 1000 - 2 AS x FROM events)")
def cnd(spark, folder):
    (value,) = vectors(spark, folder, "events", "value")
    return out(adverbs.map(lambda v: programs.cnd(v / 1000 - 2), value))


@query(f"""
    WITH a AS (
        SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS call, l_extendedprice AS s, l_extendedprice * (0.9 + l_discount) AS x, 0.25 + l_tax * 10 AS t FROM lineitem),
    b AS (SELECT *, (ln(s / x) + (0.02::DOUBLE + 0.3::DOUBLE * 0.3::DOUBLE / 2) * t) / (0.3 * sqrt(t)) AS d1 FROM a),
    c AS (SELECT *, d1 - 0.3 * sqrt(t) AS d2, x * exp(-0.02 * t) AS dx FROM b)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN call THEN s * {_cnd_sql('d1')} - dx * {_cnd_sql('d2')}
        ELSE dx * {_cnd_sql('(-d2)')} - s * {_cnd_sql('(-d1)')} END, 4) AS price FROM c""")
def black_scholes(spark, folder):
    frame = table(spark, folder, "lineitem")
    spot = F.col("l_extendedprice")
    call, s, x, t = (column(frame, c) for c in (F.col("l_returnflag") == "R", spot, spot * (0.9 + F.col("l_discount")), 0.25 + F.col("l_tax") * 10))
    price = adverbs.map(programs.black_scholes, call, s, x, t, 0.02, 0.3)
    return price.frame.select("l_orderkey", "l_linenumber", F.round(price.column, 4).alias("price"))


@query("SELECT c_custkey AS i0, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE round(c_acctbal, 6) END AS v FROM customer")
def select_where(spark, folder):
    (balance,) = vectors(spark, folder, "customer", "c_acctbal")
    return out(arrays.select(balance < 0, 0.0, balance))


@query("""SELECT p_partkey AS i0, (p_size % 7)::INT AS v, (p_size // 3)::INT AS quotient, ((p_size + 3) // 4)::INT AS up,
    round(p_size / 3, 6) AS exact FROM part""")
def mod_div(spark, folder):
    (size,) = vectors(spark, folder, "part", "p_size")
    whole = size.with_column(F.lit(3))
    return out(lib.mod(size, 7), quotient=lib.div(size, whole), up=lib.safe_div(size, size.with_column(F.lit(4))), exact=size / 3)


_UNARY = {
    "abs": "abs(x)", "neg": "-x", "sqrt": "sqrt(abs(x))", "sign": "sign(x)::DOUBLE", "reciprocal": "1.0 / x", "ceil": "ceil(x)", "floor": "floor(x)", "round": "round_even(x, 0)", "exp": "exp(x / 1000)", "exp2": "pow(2.0, x / 1000)",
    "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)", "sinh": "sinh(x / 1000)", "cosh": "cosh(x / 1000)", "tanh": "tanh(x / 1000)", "log": "ln(abs(x))", "log2": "log2(abs(x))", "log10": "log10(abs(x))",
}


@query("SELECT c_custkey AS i0, " + ", ".join(f"round({e}, 5) AS {'v' if n == 'abs' else 'f_' + n}" for n, e in _UNARY.items()) + " FROM (SELECT c_custkey, c_acctbal AS x FROM customer WHERE c_acctbal <> 0)")
def unary_math(spark, folder):
    frame = table(spark, folder, "customer").where("c_acctbal <> 0")
    x = column(frame, "c_acctbal", "c_custkey")
    sources = {"sqrt": lib.absolute(x), "log": lib.absolute(x), "log2": lib.absolute(x), "log10": lib.absolute(x)} | dict.fromkeys(("exp", "exp2", "sinh", "cosh", "tanh"), x / 1000)
    found = {n: lib.unary(n, sources.get(n, x)) for n in _UNARY}
    return out(found.pop("abs"), 5, **{f"f_{n}": t for n, t in found.items()})


# -- reduce


@query("SELECT round(sum(l_extendedprice), 2) AS v FROM lineitem")
def reduce_sum(spark, folder):
    (price,) = vectors(spark, folder, "lineitem", "l_extendedprice")
    return out(adverbs.reduce(lambda a, b: a + b, price, init=0.0), 2)


@query(f"WITH {_LONG} SELECT i1 AS i0, round(sum(v::DOUBLE), 4) AS v FROM long GROUP BY i1")
def reduce_axis0(spark, folder):
    return out(adverbs.reduce(operator.add, matrix(spark, folder), axis=0), 4)


@query("SELECT vec_id AS i0, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS v FROM embeddings")
def reduce_axis1(spark, folder):
    x = matrix(spark, folder)
    wide = x.with_column(F.transform(x.column, lambda v: v.cast("double")))
    return out(adverbs.reduce(operator.add, wide, axis=1), 4)


@query("SELECT round(product(1 + s_acctbal / 1000000), 6) AS v FROM supplier")
def reduce_prod(spark, folder):
    (balance,) = vectors(spark, folder, "supplier", "s_acctbal")
    return out(lib.prod(balance / 1000000 + 1))


@query("SELECT round(min(o_totalprice), 6) AS lo, round(max(o_totalprice), 6) AS hi FROM orders")
def reduce_minmax(spark, folder):
    (price,) = vectors(spark, folder, "orders", "o_totalprice")
    return out(lib.min(price)).withColumnRenamed("v", "lo").crossJoin(out(lib.max(price)).withColumnRenamed("v", "hi"))  # a row each


@query("SELECT round(max(o_totalprice), 6) AS v, round(min(o_totalprice), 6) AS least, count(*) * 1.0::DOUBLE AS n FROM orders")
def reduce_multi_acc(spark, folder):
    """Three accumulators, each a known fold: one aggregation."""
    (price,) = vectors(spark, folder, "orders", "o_totalprice")
    hi, lo, n = adverbs.reduce(lambda a, b, n, x: (max(a, x), min(b, x), n + 1), price, init=(-1e300, 1e300, 0.0))
    return out(hi, least=lo, n=n)


@query("SELECT round(sqrt(sum(l_quantity * l_quantity)), 4) AS v FROM lineitem")
def reduce_combine(spark, folder):
    """Partitions are folded on their own, then merged."""
    (quantity,) = vectors(spark, folder, "lineitem", "l_quantity")
    norm = adverbs.reduce(lambda a, x: math.hypot(a, x), quantity, init=0.0, combine=lambda a, b: math.hypot(a, b))
    return out(norm, 4)


@query("SELECT bool_and(quality >= 0) AS v, bool_or(toxic = 1) AS some FROM labels")
def all_any(spark, folder):
    quality, toxic = vectors(spark, folder, "labels", "quality", "toxic")
    return out(lib.all(quality >= 0)).crossJoin(out(lib.any(toxic == 1)).withColumnRenamed("v", "some"))  # a row each


@query("SELECT round(avg(l_discount), 6) AS v FROM lineitem")
def mean(spark, folder):
    (discount,) = vectors(spark, folder, "lineitem", "l_discount")
    return out(lib.mean(discount))


@query("SELECT round(sum(l_quantity * l_extendedprice), 1) AS v FROM lineitem")
def dot(spark, folder):
    return out(lib.dot(*vectors(spark, folder, "lineitem", "l_quantity", "l_extendedprice")), 1)


@query("SELECT round(sqrt(sum(value * value)), 4) AS v FROM events")
def norm(spark, folder):
    return out(programs.norm(*vectors(spark, folder, "events", "value")), 4)


@query("SELECT event_id::INT AS v FROM events ORDER BY value, event_id LIMIT 1")
def argmin(spark, folder):
    return out(lib.argmin(*vectors(spark, folder, "events", "value")))


@query("SELECT event_id::INT AS v FROM events ORDER BY value DESC, event_id LIMIT 1")
def argmax(spark, folder):
    return out(lib.argmax(*vectors(spark, folder, "events", "value")))


# -- scan


@query("SELECT event_id AS i0, round(sum(value) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 2) AS v FROM events")
def scan_sum(spark, folder):
    return out(lib.cumsum(*vectors(spark, folder, "events", "value")), 2)


@query("SELECT o_orderkey AS i0, round(max(o_totalprice) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 6) AS v FROM orders")
def scan_max(spark, folder):
    return out(adverbs.scan(named("max"), *vectors(spark, folder, "orders", "o_totalprice")))


@query("SELECT vec_id AS i0, unnest(range(len(embedding))) AS i1, round(unnest(list_transform(range(1, len(embedding) + 1), lambda n: list_sum(list_transform(embedding[1:n], lambda x: x::DOUBLE)))), 4) AS v FROM embeddings")
def scan_axis1(spark, folder):
    x = matrix(spark, folder)
    return out(lib.cumsum(x.with_column(F.transform(x.column, lambda v: v.cast("double"))), axis=1), 4)


@query("""SELECT s_suppkey AS i0, round(sum(s_acctbal * pow(0.5, -s_suppkey)) OVER (ORDER BY s_suppkey ROWS UNBOUNDED PRECEDING) * pow(0.5, s_suppkey), 4) AS v FROM supplier""")
def scan_generic(spark, folder):
    """A decaying sum, which no aggregate of Spark gives: the fold in order."""
    return out(adverbs.scan(lambda a, x: a * 0.5 + x, *vectors(spark, folder, "supplier", "s_acctbal")), 4)


# -- array operators


@query("SELECT round(value, 6) AS v FROM events WHERE event_id = 7")
def index_scalar(spark, folder):
    return out(vectors(spark, folder, "events", "value")[0][7])


@query("SELECT round(embedding[5]::DOUBLE, 5) AS v FROM embeddings WHERE vec_id = 3")
def index_multi(spark, folder):
    x = matrix(spark, folder)[3, 4]
    return out(x.with_column(x.column.cast("double")), 5)


@query("SELECT o.o_orderkey AS i0, round(c.c_acctbal, 6) AS v FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def gather(spark, folder):
    (balance,), (customers,) = vectors(spark, folder, "customer", "c_acctbal"), vectors(spark, folder, "orders", "o_custkey")
    return out(balance[customers])


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS i0, round(value, 6) AS v FROM events WHERE value > 100")
def mask_index(spark, folder):
    (value,) = vectors(spark, folder, "events", "value")
    return out(value[value > 100])


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i0, o_orderkey::INT AS v FROM orders WHERE o_totalprice > 200000")
def where(spark, folder):
    (price,) = vectors(spark, folder, "orders", "o_totalprice")
    return out(arrays.where(price > 200000))


@query("SELECT min(p_partkey)::INT AS v FROM part WHERE p_size = 17")
def find(spark, folder):
    return out(arrays.find(vectors(spark, folder, "part", "p_size")[0], 17))


@query("SELECT r AS i0, (r * 3 + 5)::INT AS v FROM range(0, 1000) t(r)")
def range_(spark, folder):
    return out(arange(spark, 5, 3005, 3))


QUERIES["range"], SQL["range"] = QUERIES.pop("range_"), SQL.pop("range_")


@query("SELECT (event_id - 10) // 7 AS i0, round(value, 6) AS v FROM events WHERE event_id >= 10 AND (event_id - 10) % 7 = 0")
def slice_step(spark, folder):
    return out(arrays.slice_(vectors(spark, folder, "events", "value")[0], 10, None, 7))


@query(f"WITH {_LONG} SELECT i1 AS i0, i0 AS i1, round(v::DOUBLE, 5) AS v FROM long")
def transpose(spark, folder):
    x = matrix(spark, folder).T
    return out(x.with_column(x.column.cast("double")), 5)


@query(f"WITH {_LONG} SELECT i0 * 64 + i1 AS i0, round(v::DOUBLE, 5) AS v FROM long")
def flatten(spark, folder):
    x = arrays.flatten(matrix(spark, folder))
    return out(x.with_column(x.column.cast("double")), 5)


@query("SELECT [max(vec_id) + 1, max(len(embedding))]::INT[] AS shape, [max(len(embedding)) * 4, 4]::INT[] AS strides FROM embeddings")
def shape(spark, folder):
    x = matrix(spark, folder)
    return spark.createDataFrame([(list(x.shape), list(x.strides))], "shape array<int>, strides array<int>")


@query("SELECT p_partkey AS i0, CASE WHEN p_partkey = 11 THEN 99 ELSE p_size END::INT AS v FROM part")
def setidx(spark, folder):
    return out(arrays.set_index(vectors(spark, folder, "part", "p_size")[0], 11, 99))


@query("SELECT row_number() OVER (ORDER BY o_totalprice) - 1 AS i0, round(o_totalprice, 6) AS v FROM orders")
def sort(spark, folder):
    return out(arrays.sort(vectors(spark, folder, "orders", "o_totalprice")[0]))


@query("SELECT (p_partkey + 5) % (SELECT count(*) FROM part) AS i0, p_size AS v FROM part")
def rotate(spark, folder):
    return out(arrays.rotate(vectors(spark, folder, "part", "p_size")[0], 5))


@query("SELECT p_partkey AS i0, coalesce(lag(p_size, 3) OVER (ORDER BY p_partkey), -1)::INT AS v FROM part")
def shift(spark, folder):
    return out(arrays.shift(vectors(spark, folder, "part", "p_size")[0], 3, -1))


@query("SELECT n_nationkey AS i0, 2.5::DOUBLE AS v, 4 AS four FROM nation")
def explode(spark, folder):
    keys = vectors(spark, folder, "nation", "n_regionkey")[0]
    flat = arrays.explode(keys, 2.5)
    return out(flat, four=arrays.explode(keys, 4))


# -- allpairs and programs


@query("SELECT a.s_suppkey AS i0, b.n_nationkey AS i1, round(a.s_acctbal + b.n_regionkey, 6) AS v FROM supplier a, nation b")
def allpairs_add(spark, folder):
    return out(adverbs.allpairs(np.add, vectors(spark, folder, "supplier", "s_acctbal")[0], vectors(spark, folder, "nation", "n_regionkey")[0]))


@query(f"WITH {_LONG} SELECT a.i1 AS i0, b.i1 AS i1, round(sum(a.v::DOUBLE * b.v::DOUBLE), 3) AS v FROM long a JOIN long b USING (i0) GROUP BY a.i1, b.i1")
def matmul(spark, folder):
    x = arrays.cast(matrix(spark, folder), _DOUBLE)
    return out(lib.dot(x.T, x), 3)


@query("SELECT a.vec_id AS i0, b.vec_id AS i1, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2]))), 3) AS v FROM embeddings a, embeddings b")
def distance_matrix(spark, folder):
    x = arrays.cast(matrix(spark, folder), _DOUBLE)
    return out(adverbs.allpairs(programs.sqdist, x, x), 3)


@query("SELECT count(*) AS v FROM part WHERE p_size = 10")
def count_matches(spark, folder):
    (size,) = vectors(spark, folder, "part", "p_size")
    hit = size == 10
    return out(adverbs.reduce(operator.add, hit.with_column(hit.column.cast("int"))))


_K = 10


@query(f"""
    WITH {_LONG},
    near AS (
        SELECT p.i0, arg_min(c.i0, struct_pack(d := round(p.d, 9), c := c.i0)) AS cluster FROM (
            SELECT a.i0, b.i0 AS c, sum((a.v::DOUBLE - b.v::DOUBLE) * (a.v::DOUBLE - b.v::DOUBLE)) AS d
            FROM long a JOIN (SELECT * FROM long WHERE i0 < {_K}) b USING (i1) GROUP BY a.i0, b.i0) p JOIN (SELECT DISTINCT i0 FROM long WHERE i0 < {_K}) c ON p.c = c.i0 GROUP BY p.i0)
    SELECT cluster::BIGINT AS i0, i1::BIGINT AS i1, round(avg(v::DOUBLE), 4) AS v, count(*) AS n FROM long JOIN near USING (i0) GROUP BY cluster, i1""")
def kmeans_step(spark, folder):
    """One round of k-means from the first ten rows."""
    x = matrix(spark, folder)
    first = x.frame.where(F.col("vec_id") < _K).orderBy("vec_id").collect()
    labels = programs.nearest(x, np.array([r["embedding"] for r in first], float))
    sums = programs.centroid_sums(x, labels, 64)
    means = F.posexplode(F.array(*(F.col(f"m{i}") for i in range(64)))).alias("i1", "m")
    return sums.select(F.col("cluster").cast("long").alias("i0"), "n", means).select("i0", F.col("i1").cast("long").alias("i1"), F.round("m", 4).alias("v"), "n")


@query()
def kmeans(spark, folder):
    """K-means until nothing moves; tested against NumPy."""
    _, labels, _ = programs.kmeans(matrix(spark, folder), _K)
    return out(labels)


@query("""
    SELECT vec_id AS i0, u * 8 + w AS i1, round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE
        * cos((2 * ((i - 1) // 8) + 1) * u * pi() / 16) * cos((2 * ((i - 1) % 8) + 1) * w * pi() / 16)))
        * (CASE WHEN u = 0 THEN sqrt(1 / 8) ELSE 0.5 END) * (CASE WHEN w = 0 THEN sqrt(1 / 8) ELSE 0.5 END), 4) AS v
    FROM embeddings, range(0, 8) a(u), range(0, 8) b(w)""")
def dct8x8(spark, folder):
    return out(programs.dct_blocks(matrix(spark, folder)).long(), 4)


@query("SELECT round(sum(sqrt(l_extendedprice * (1 - l_discount)) + 1), 2) AS v FROM lineitem")
def fused_pipeline(spark, folder):
    """Two maps and a sum: one projection with a partial aggregate."""
    price, discount = vectors(spark, folder, "lineitem", "l_extendedprice", "l_discount")
    net = adverbs.map(lambda p, d: p * (1 - d), price, discount)
    rooted = adverbs.map(lambda x: math.sqrt(x) + 1, net)
    return out(adverbs.reduce(operator.add, rooted), 2)


_HALVED = "greatest(0, ceil(log2(greatest(value, 1) / 50)))"


@query(f"SELECT event_id AS i0, round(CASE WHEN value > 50 THEN value / pow(2, {_HALVED}) ELSE value END, 6) AS v FROM events")
def loop_on_data(spark, folder):
    """A loop whose end depends on the data: batches of elements, of which ever fewer go on."""
    (value,) = vectors(spark, folder, "events", "value")
    return out(adverbs.map(_halved, value))


@kernel
def _halved(x):
    while x > 50:
        x = x / 2
    return x


@query("SELECT event_id AS i0, round(CASE WHEN value > 50 THEN sqrt(value) ELSE value * value END, 6) AS v FROM events")
def opaque_map(spark, folder):
    """A payload that can't be compiled (it returns from a loop) runs over Arrow batches."""
    (value,) = vectors(spark, folder, "events", "value")
    return out(adverbs.map(_opaque, value))


@kernel
def _opaque(x):
    while x > 50:
        return math.sqrt(x)
    return x * x


# -- operations by themselves


@query("""SELECT p_partkey AS i0, pow(p_size, 2)::DOUBLE AS v, p_size <> 7 AS other, NOT (p_size > 20) AS small,
    (p_size > 10 AND p_size < 30) AS middle, (p_size < 5 OR p_size > 45) AS extreme, least(p_size, 9)::INT AS lo, greatest(p_size, 9)::INT AS hi FROM part""")
def scalar_ops(spark, folder):
    (size,) = vectors(spark, folder, "part", "p_size")
    return out(lib.power(size, 2), other=size != 7, small=~(size > 20), middle=(size > 10) & (size < 30), extreme=(size < 5) | (size > 45), lo=lib.minimum(size, 9), hi=lib.maximum(size, 9))


@query(f"WITH {_LONG} SELECT i1 AS i0, round(max(v)::DOUBLE, 5) AS v FROM long GROUP BY i1")
def ufunc_reduce(spark, folder):
    return out(lib.ufunc("max").reduce(arrays.cast(matrix(spark, folder), _DOUBLE)), 5)


@query(f"WITH {_LONG} SELECT i0, i1, round(min(v) OVER (PARTITION BY i1 ORDER BY i0 ROWS UNBOUNDED PRECEDING)::DOUBLE, 5) AS v FROM long")
def ufunc_accumulate(spark, folder):
    return out(lib.ufunc("min").accumulate(arrays.cast(matrix(spark, folder), _DOUBLE)), 5)


@query("SELECT n_nationkey::BIGINT AS i0, [53, 2, -302, 1][n_nationkey % 4 + 1] + 4 AS v FROM nation")
def array_literal(spark, folder):
    """A literal in a payload, indexed by calling it, and its length."""
    (key,) = vectors(spark, folder, "nation", "n_nationkey")
    return out(adverbs.map(_from_literal, key))


@kernel
def _from_literal(k):
    table = np.array([53, 2, -302, 1])
    return table(k % 4) + len(table)


_RATE = 7


@query("SELECT p_partkey AS i0, p_size * 7 + 3 + (0 + 1 + 2 + 3) AS v FROM part")
def globals_and_defaults(spark, folder):
    """A module's variable, a default, a keyword argument and a counted loop."""
    (size,) = vectors(spark, folder, "part", "p_size")
    return out(adverbs.map(_rated, size, more=3))


@kernel
def _rated(x, more=1, turns=4):
    total = x * _RATE + more
    for i in range(turns):
        total = total + i
    return total


@query("SELECT vec_id AS i0, unnest(range(64)) AS i1, round(unnest(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 5) AS v FROM embeddings")
def rank_mismatch(spark, folder):
    """A vector meets the trailing axis of a matrix."""
    weights = from_numpy(spark, np.arange(1.0, 65.0))
    return out(arrays.cast(matrix(spark, folder), _DOUBLE) * weights, 5)


@query("SELECT l_orderkey, l_linenumber, round((l_extendedprice + l_quantity) / 2, 6) AS v FROM lineitem")
def average_of_two(spark, folder):
    base = table(spark, folder, "lineitem")
    half = adverbs.map(lambda a, b: (a + b) / 2, column(base, "l_extendedprice"), column(base, "l_quantity"))
    return half.frame.select("l_orderkey", "l_linenumber", F.round(half.column, 6).alias("v"))


@query("SELECT (SELECT count(*) FROM part)::BIGINT AS v, 64::BIGINT AS width")
def length(spark, folder):
    return spark.createDataFrame([(len(vectors(spark, folder, "part", "p_size")[0]), matrix(spark, folder).shape[1])], "v long, width long")


@query("""SELECT event_id AS i0, round(sum(value) OVER w, 2) AS v, round(max(value * 2) OVER w, 6) AS most FROM events
    WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def scan_multi(spark, folder):
    """Two accumulators of one scan."""
    (value,) = vectors(spark, folder, "events", "value")
    total, most = adverbs.scan(lambda s, m, x: (s + x, max(m, x * 2)), value, init=(0.0, -1e300))
    found, more = out(total, 2), out(most).withColumnRenamed("v", "most")
    return found.join(more, "i0")


@query("SELECT vec_id % 10 AS i0, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS v FROM embeddings WHERE vec_id < 100 GROUP BY 1")
def map_axis_rank3(spark, folder):
    """Sums of squares of the slices of a tensor of three axes, along the middle one."""
    some = matrix(spark, folder).frame.where("vec_id < 100")
    cells = some.select(F.floor(F.col("vec_id") / 10).alias("a"), (F.col("vec_id") % 10).alias("b"), F.posexplode("embedding").alias("c", "v"))
    x = column(cells, F.col("v").cast("double"), ("a", "b", "c"))
    return out(adverbs.map(lambda s: sum(s * s), x, axis=1), 4)


@query("""SELECT l_orderkey, l_linenumber, round(0.299 * l_quantity + 0.587 * l_discount + 0.114 * l_tax, 6) AS light,
    round(128 - 0.168736 * l_quantity - 0.331264 * l_discount + 0.5 * l_tax, 6) AS blueness, round(128 + 0.5 * l_quantity - 0.418688 * l_discount - 0.081312 * l_tax, 6) AS redness FROM lineitem""")
def colour_space(spark, folder):
    base = table(spark, folder, "lineitem")
    light, blue, red = programs.to_ycc(*(column(base, c) for c in ("l_quantity", "l_discount", "l_tax")))
    return light.frame.select("l_orderkey", "l_linenumber", *(F.round(t.column, 6).alias(n) for n, t in (("light", light), ("blueness", blue), ("redness", red))))
