"""Queries of the tensor engine over the star-schema tables, each with the SQL that gives the same rows.

E: embeddings (vec_id x position), L: quantity by part and supplier, U: quantity by order and line, X: number of events
by user, type and day. L and X hold whole numbers, so sums of products are exact.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import latticeframe as lf

from .operators.tensor import Tensor

TYPES = ("click", "error", "purchase", "signup", "view")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def extent(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> tuple[int, ...]:
    """Largest id plus one of columns: dimensions that the tables' statistics give."""
    row = spark.read.parquet(f"{sf_dir}/{name}.parquet").agg(*(F.max(c) for c in columns)).first()
    return tuple(int(x) + 1 for x in row)


def embeddings(spark: SparkSession, sf_dir: str) -> Tensor:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return lf.from_vectors(table, "vec_id", "embedding", *extent(spark, sf_dir, "embeddings", "vec_id"), 64)


def quantities(spark: SparkSession, sf_dir: str) -> Tensor:
    parts, = extent(spark, sf_dir, "part", "p_partkey")
    suppliers, = extent(spark, sf_dir, "supplier", "s_suppkey")
    return lf.from_table(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_partkey", "l_suppkey"], "l_quantity", (parts, suppliers))


def events(spark: SparkSession, sf_dir: str) -> Tensor:
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    users, = extent(spark, sf_dir, "events", "user_id")
    kind = F.array_position(F.array(*map(F.lit, TYPES)), F.col("event_type")) - 1
    cells = table.select("user_id", kind.alias("kind"), (F.dayofmonth("ts") - 1).alias("day"), F.lit(1.0).alias("one"))
    return lf.from_table(cells, ["user_id", "kind", "day"], "one", (users, len(TYPES), 31))


def order_times(spark: SparkSession, sf_dir: str) -> Tensor:
    """Order dates by key; those of every seventh key are taken out."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n, = extent(spark, sf_dir, "orders", "o_orderkey")
    cells = orders.select(F.col("o_orderkey").cast("long").alias("d0"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate").cast("timestamp_ntz")).alias("v"))
    return Tensor(cells, lf.Meta((n,), "M8[us]"))


WITH = {
    "L": "L AS (SELECT l_partkey AS p, l_suppkey AS s, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2)",
    "E": "E AS (SELECT vec_id AS i, CAST(UNNEST(range(64)) AS BIGINT) AS k, CAST(UNNEST(embedding) AS DOUBLE) AS v FROM embeddings)",
    "X": "X AS (SELECT user_id AS u, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS t, day(ts) - 1 AS d, CAST(COUNT(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2, 3)",
    "P": "P AS (SELECT CAST(UNNEST(range((SELECT MAX(p_partkey) + 1 FROM part))) AS BIGINT) AS p)",
    "S": "S AS (SELECT CAST(UNNEST(range((SELECT MAX(s_suppkey) + 1 FROM supplier))) AS BIGINT) AS s)",
    "D": "D AS (SELECT P.p, S.s, COALESCE(L.v, 0e0) AS v FROM P CROSS JOIN S LEFT JOIN L ON L.p = P.p AND L.s = S.s)",
}


def query(tables: str, sql: str | None):
    """Register a function of the tensors named in `tables`; sql reads the same names."""
    source = {"L": quantities, "E": embeddings, "X": events, "O": order_times}

    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, *(source[c](spark, sf_dir) for c in tables if c in source))
            if isinstance(out, DataFrame):
                return out
            return out.df.select(*out.dims, *out.values)

        run.__module__ = f.__module__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = ("WITH " + ", ".join(WITH[c] for c in tables if c in WITH) + " " if set(tables) & set(WITH) else "") + sql
        return f

    return keep


def rounded(t: Tensor, digits: int = 6) -> DataFrame:
    """Whole numbers stay as they are, which spares them a decimal."""
    return t.df.select(*t.dims, *((F.when(F.rint(c) == F.col(c), F.col(c)).otherwise(F.round(c, digits)) + 0.0).alias(c) for c in t.values))


def fixed(spark: SparkSession, value, dtype=float) -> Tensor:
    return lf.array(np.asarray(value, dtype), spark=spark)


@query("E", "SELECT a.k AS d0, b.k AS d1, ROUND(SUM(a.v * b.v), 6) + 0.0 AS v FROM E a JOIN E b ON a.i = b.i GROUP BY 1, 2")
def gram(spark, e):
    return rounded(np.einsum("ia,ib->ab", e, e))


@query("E", "SELECT i AS d0, k AS d1, v FROM E")
def scan_coo(spark, e):
    return e


@query("L", "SELECT p AS d0, s AS d1, v FROM L")
def sparse_from_lineitem(spark, t):
    return t


@query("L", "SELECT s AS d0, p AS d1, v FROM L")
def transpose_matrix(spark, t):
    return t.T


@query("X", "SELECT CAST(d AS BIGINT) AS d0, CAST(u AS BIGINT) AS d1, CAST(t AS BIGINT) AS d2, v FROM X")
def transpose_axes(spark, x):
    return x.transpose(2, 0, 1)


@query("L", "SELECT (p * (SELECT MAX(s_suppkey) + 1 FROM supplier) + s) // (SELECT MAX(p_partkey) + 1 FROM part) AS d0, (p * (SELECT MAX(s_suppkey) + 1 FROM supplier) + s) % (SELECT MAX(p_partkey) + 1 FROM part) AS d1, v FROM L")
def reshape_c(spark, t):
    return t.reshape(t.shape[1], -1)


@query("L", "SELECT (p + s * (SELECT MAX(p_partkey) + 1 FROM part)) % (SELECT MAX(s_suppkey) + 1 FROM supplier) AS d0, (p + s * (SELECT MAX(p_partkey) + 1 FROM part)) // (SELECT MAX(s_suppkey) + 1 FROM supplier) AS d1, v FROM L")
def reshape_f(spark, t):
    return t.reshape((t.shape[1], t.shape[0]), order="F")


@query("L", "SELECT p * (SELECT MAX(s_suppkey) + 1 FROM supplier) + s AS d0, v FROM L")
def flatten(spark, t):
    return t.flatten()


@query("L", "SELECT s AS d0, v FROM L WHERE p = 7")
def getitem_row(spark, t):
    return t[7]


@query("L", "SELECT (p - 10) // 3 AS d0, (9 - s) // 2 AS d1, v FROM L WHERE p BETWEEN 10 AND 99 AND (p - 10) % 3 = 0 AND s BETWEEN 2 AND 9 AND (9 - s) % 2 = 0")
def getitem_slice(spark, t):
    return t[10:100:3, 9:1:-2]


@query("L", "SELECT CAST(x.k AS BIGINT) AS d0, s AS d1, v FROM L JOIN (VALUES (0, 5), (1, 3), (2, 5), (3, 11)) x(k, p) ON x.p = L.p")
def fancy_index(spark, t):
    return t[[5, 3, 5, 11]]


@query("LPSD", "SELECT CAST(ROW_NUMBER() OVER (ORDER BY p, s) - 1 AS BIGINT) AS d0, v FROM D WHERE v > 60")
def boolean_mask(spark, t):
    return t[t > 60]


@query("L", "SELECT p AS d0, s AS d1, v FROM L WHERE NOT (p BETWEEN 5 AND 8 AND s < 10) UNION ALL SELECT p.range, s.range, 2.5 FROM range(5, 9) p, range(0, 10) s")
def setitem(spark, t):
    t[5:9, :10] = 2.5
    return t


@query("E", "SELECT i AS d0, k AS d1, CAST(TRUNC(v * 100) AS BIGINT) AS v FROM E")
def astype_int(spark, e):
    return (e * 100.0).astype(np.int64)


@query("E", "SELECT i AS d0, k - 32 AS d1, v FROM E WHERE k BETWEEN 32 AND 47")
def split_axis(spark, e):
    return np.split(e, 4, axis=1)[2]


@query("E", "SELECT i AS d0, CAST(0 AS BIGINT) AS d1, k AS d2, v FROM E UNION ALL SELECT i, 1, 63 - k, v FROM E")
def stack_two(spark, e):
    return np.stack([e, e[:, ::-1]], axis=1)


@query("E", "SELECT i AS d0, k AS d1, v FROM E UNION ALL SELECT i, 64 + k, -v FROM E UNION ALL SELECT (SELECT MAX(vec_id) + 1 FROM embeddings) + i, k, 2 * v FROM E UNION ALL SELECT (SELECT MAX(vec_id) + 1 FROM embeddings) + i, 64 + k, v FROM E")
def block_2x2(spark, e):
    return np.block([[e, -e], [e * 2.0, e]])


@query("", "SELECT CAST(a.range AS BIGINT) AS d0, CAST(b.range AS BIGINT) AS d1, 0e0 AS v FROM range(7) a, range(5) b")
def zeros_dense(spark):
    return lf.zeros((7, 5), spark=spark).dense()


@query("", "SELECT CAST(a.range AS BIGINT) AS d0, CAST(b.range AS BIGINT) AS d1, CAST(3 AS BIGINT) AS v FROM range(70) a, range(50) b")
def full_int(spark):
    return lf.full((70, 50), 3, spark=spark)


@query("", "SELECT CAST(a.range AS BIGINT) AS d0, CAST(a.range AS BIGINT) AS d1, 1e0 AS v FROM range(100) a")
def identity(spark):
    return lf.identity(100, spark=spark)


@query("E", "SELECT i AS d0, k AS d1, 1e0 AS v FROM E")
def ones_like(spark, e):
    return np.ones_like(e)


@query("L", "SELECT COALESCE(a.p, b.p) AS d0, COALESCE(a.s, b.s) AS d1, COALESCE(a.v, 0) + COALESCE(b.v, 0) AS v FROM L a FULL JOIN (SELECT p, (SELECT MAX(s_suppkey) FROM supplier) - s AS s, v FROM L) b ON a.p = b.p AND a.s = b.s")
def add_outer_join(spark, t):
    return t + t[:, ::-1]


@query("L", "SELECT a.p AS d0, a.s AS d1, a.v * b.v AS v FROM L a JOIN (SELECT p, (SELECT MAX(s_suppkey) FROM supplier) - s AS s, v FROM L) b ON a.p = b.p AND a.s = b.s")
def mul_inner_join(spark, t):
    return t * t[:, ::-1]


@query("LPSD", "SELECT p AS d0, s AS d1, 2 * v + 1 AS v FROM D")
def scalar_ops(spark, t):
    return t * 2.0 + 1.0


@query("LPSD", "SELECT p AS d0, s AS d1, v >= 50 AS v FROM D")
def compare_mask(spark, t):
    return (t >= 50).dense()


@query("E", "SELECT i AS d0, k AS d1, ROUND(EXP(v) + SIN(v) * ATAN(v), 9) AS v FROM E")
def unary_math(spark, e):
    return rounded(np.exp(e) + np.sin(e) * np.arctan(e), 9)


@query("L", "SELECT p AS d0, s AS d1, FLOOR(v / 7) AS v FROM L")
def floor_divide(spark, t):
    return np.floor_divide(t, 7.0)


@query("L", "SELECT p AS d0, s AS d1, v - 7 * FLOOR(v / 7) AS v FROM L")
def remainder(spark, t):
    return np.remainder(t, 7.0)


@query("L", "SELECT COALESCE(a.p, b.p) AS d0, COALESCE(a.s, b.s) AS d1, GREATEST(COALESCE(a.v, 0), COALESCE(b.v, 0)) AS v FROM L a FULL JOIN (SELECT p, (SELECT MAX(s_suppkey) FROM supplier) - s AS s, v FROM L) b ON a.p = b.p AND a.s = b.s WHERE GREATEST(COALESCE(a.v, 0), COALESCE(b.v, 0)) <> 0")
def maximum(spark, t):
    out = np.maximum(t, t[:, ::-1])
    return out.df.where("v <> 0")


@query("E", "SELECT i AS d0, k AS d1, CASE WHEN v > 0 THEN ROUND(LN(v), 9) WHEN v = 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS v FROM E")
def log_guarded(spark, e):
    return rounded(np.log(e), 9)


@query("LX", "SELECT L.p AS d0, L.s AS d1, CAST(w.t AS BIGINT) AS d2, L.v * w.v AS v FROM L, (SELECT t, SUM(v) AS v FROM X GROUP BY 1) w")
def outer(spark, t, x):
    return np.multiply.outer(t, x.sum((0, 2)))


@query("LX", "SELECT L.p AS d0, L.s * 5 + w.t AS d1, L.v * w.v AS v FROM L, (SELECT t, SUM(v) AS v FROM X GROUP BY 1) w")
def kron(spark, t, x):
    return np.kron(t, x.sum((0, 2)))


@query("L", "SELECT L.p AS d0, SUM(L.v * w.v) AS v FROM L JOIN (SELECT s, SUM(v) AS v FROM L GROUP BY 1) w ON w.s = L.s GROUP BY 1")
def matvec(spark, t):
    return t @ t.sum(0)


@query("L", "SELECT a.s AS d0, b.s AS d1, SUM(a.v * b.v) AS v FROM L a JOIN L b ON a.p = b.p GROUP BY 1, 2")
def matmul(spark, t):
    return t.T @ t


@query("X", "SELECT CAST(a.u AS BIGINT) AS d0, CAST(b.u AS BIGINT) AS d1, SUM(a.v * b.v) AS v FROM X a JOIN X b ON a.t = b.t AND a.d = b.d GROUP BY 1, 2")
def tensordot_2axes(spark, x):
    return np.tensordot(x, x, ([2, 1], [-1, 1]))


@query("L", "SELECT SUM(v * v) AS v FROM L")
def einsum_trace(spark, t):
    return np.einsum("ps,ps->", t, t)


@query("L", "SELECT p AS d0, v FROM L WHERE p = s")
def einsum_diag(spark, t):
    n = min(t.shape)
    return np.einsum("ii->i", t[:n, :n])


@query("X", "SELECT CAST(t AS BIGINT) AS d0, SUM(v) AS v FROM X GROUP BY 1")
def einsum_reduce(spark, x):
    return np.einsum("utd->t", x)


@query("X", "SELECT CAST(c.t AS BIGINT) AS d0, CAST(b.t AS BIGINT) AS d1, SUM(a.g * b.v * c.v) AS v FROM (SELECT a.d AS d, b.d AS e, SUM(a.v * b.v) AS g FROM X a JOIN X b ON a.u = b.u AND a.t = b.t GROUP BY 1, 2) a JOIN (SELECT t, d, SUM(v) AS v FROM X GROUP BY 1, 2) b ON b.d = a.e JOIN (SELECT t, d, SUM(v) AS v FROM X GROUP BY 1, 2) c ON c.d = a.d GROUP BY 1, 2")
def einsum_chain(spark, x):
    w = x.sum(0)
    return np.einsum("utd,ute,se,rd->rs", x, x, w, w)


@query("X", "SELECT CAST(a.u AS BIGINT) AS d0, CAST(a.t AS BIGINT) AS d1, CAST(b.t AS BIGINT) AS d2, SUM(a.v * b.v) AS v FROM X a JOIN X b ON a.u = b.u AND a.d = b.d GROUP BY 1, 2, 3")
def einsum_batch(spark, x):
    return np.einsum("utd,usd->uts", x, x)


@query("LS", "SELECT S.s AS d0, CAST(COUNT(L.v) AS BIGINT) AS v FROM S LEFT JOIN L ON L.s = S.s AND L.v <> 0 GROUP BY 1")
def count_nonzero_axis(spark, t):
    return np.count_nonzero(t, axis=0)


@query("L", "SELECT CAST(COUNT(*) AS BIGINT) AS v FROM L WHERE v <> 0")
def count_nonzero_all(spark, t):
    return spark.createDataFrame([(np.count_nonzero(t),)], "v long")


@query("LS", "SELECT CAST(0 AS BIGINT) AS d0, S.s AS d1, CAST(COUNT(L.v) AS BIGINT) AS v FROM S LEFT JOIN L ON L.s = S.s AND L.v <> 0 GROUP BY 1, 2")
def count_nonzero_keepdims(spark, t):
    return np.count_nonzero(t, axis=0, keepdims=True)


@query("LPSD", "SELECT p AS d0, s AS d1, SUM(v) OVER (PARTITION BY p ORDER BY s ROWS UNBOUNDED PRECEDING) AS v FROM D")
def cumsum_axis(spark, t):
    return np.cumsum(t, axis=1)


@query("LPSD", "SELECT p * (SELECT MAX(s_suppkey) + 1 FROM supplier) + s AS d0, SUM(v) OVER (ORDER BY p, s ROWS UNBOUNDED PRECEDING) AS v FROM D")
def cumsum_flat(spark, t):
    return np.cumsum(t)


@query("L", "SELECT p AS d0, SUM(v) AS v FROM L GROUP BY 1")
def reduce_sum(spark, t):
    return np.add.reduce(t, axis=1)


@query("L", "SELECT s AS d0, MAX(v) AS v FROM L GROUP BY 1")
def reduce_max(spark, t):
    return t.max(axis=0)


@query("LPSD", "SELECT p AS d0, CASE WHEN s < 3 THEN 0 WHEN s < 8 THEN 1 ELSE 2 END::BIGINT AS d1, SUM(v) AS v FROM D GROUP BY 1, 2")
def reduceat(spark, t):
    return np.add.reduceat(t, [0, 3, 8], axis=1)


@query("LPSD", "SELECT p AS d0, AVG(v) AS v FROM D WHERE p IN (SELECT p FROM L) GROUP BY 1")
def reduce_mean(spark, t):
    return t.mean(axis=1)


@query("LPSD", "SELECT p AS d0, s AS d1, v + CASE WHEN p = 1 AND s = 2 THEN 30 WHEN p = 3 AND s = 4 THEN 5 ELSE 0 END AS v FROM D WHERE v <> 0 OR (p = 1 AND s = 2) OR (p = 3 AND s = 4)")
def scatter_add(spark, t):
    np.add.at(t, ([1, 3, 1], [2, 4, 2]), np.array([10.0, 5.0, 20.0]))
    return t


@query("L", "SELECT ROUND(SQRT(SUM(v * v)), 6) AS v FROM L")
def norm(spark, t):
    return rounded(np.linalg.norm(t))


@query("X", "SELECT CAST(u AS BIGINT) AS d0, CAST(t AS BIGINT) AS d1, CAST(d AS BIGINT) AS d2, v FROM X")
def block_roundtrip(spark, x):
    return lf.to_blocks(x, (64, 2, 8)).to_coo()


@query("E", "SELECT a.k AS d0, b.k AS d1, ROUND(SUM(a.v * b.v), 6) + 0.0 AS v FROM E a JOIN E b ON a.i = b.i GROUP BY 1, 2")
def block_tensordot(spark, e):
    b = lf.to_blocks(e, (128, 32))
    return rounded(lf.tensordot(b, b, (0, 0)).to_coo())


@query("E", "SELECT SUM(re) AS re, SUM(im) AS im FROM (SELECT ROUND(SUM(v * v), 6) AS re, ROUND(SUM(v * v), 6) AS im FROM E)")
def complex_product(spark, e):
    z = np.multiply(e.astype(complex), 1 + 1j)
    return rounded(np.einsum("ik,ik->", z, e))


@query("E", None)
def qr_tsqr(spark, e):
    return rounded(np.linalg.qr(e, mode="r"))


@query("E", None)
def svd_values(spark, e):
    return rounded(np.linalg.svd(e, compute_uv=False))


@query("E", None)
def schmidt_topk(spark, e):
    return rounded(lf.schmidt(e, 1, chi=5)[1])


@query("", "SELECT CAST(a.range AS BIGINT) AS d0, CAST(b.range AS BIGINT) AS d1, ('0x' || substr(md5('1,' || a.range || ',' || b.range), 1, 13))::BIGINT / 4503599627370496e0 AS v FROM range(1000) a, range(20) b")
def rand(spark):
    return lf.rand((1000, 20), seed=1, spark=spark)


@query("LPSD", "SELECT p AS d0, s AS d1, CASE WHEN v = 0 THEN 5e-324 ELSE POWER(2e0, FLOOR(LOG2(v)) - 52) END AS v FROM D")
def nextafter_spacing(spark, t):
    return np.spacing(np.nextafter(t, np.inf))
