"""Further registered queries: the remaining forms of constructors, sinks, functions, contractions and solvers, each with
its SQL. Factorisations are stated by what they must give back (Q R = E, U S V = E, inverse times matrix = identity)."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import latticeframe as lf

from .extra import register_autoray
from .operators.tensor import Tensor
from .queries import fixed, query, rounded

EYE = "SELECT CAST(a.range AS BIGINT) AS d0, CAST(b.range AS BIGINT) AS d1, CASE WHEN a.range = b.range THEN 1e0 ELSE 0e0 END AS v FROM range({n}) a, range({n}) b"
#: W: events by type and day; G: its Gram matrix; M: quantities by parity of part and supplier.
W = "(SELECT t, d, SUM(v) AS v FROM X GROUP BY 1, 2)"
G = f"(SELECT CAST(a.t AS BIGINT) AS i, CAST(b.t AS BIGINT) AS j, SUM(a.v * b.v) AS v FROM {W} a JOIN {W} b ON a.d = b.d GROUP BY 1, 2)"
M = "(SELECT SUM(v) FILTER (p % 2 = 0 AND s % 2 = 0) AS a, SUM(v) FILTER (p % 2 = 0 AND s % 2 = 1) AS b, SUM(v) FILTER (p % 2 = 1 AND s % 2 = 0) AS c, SUM(v) FILTER (p % 2 = 1 AND s % 2 = 1) AS d FROM L)"


def days(x: Tensor) -> Tensor:
    return x.sum(0)


def gram_of_days(x: Tensor) -> Tensor:
    w = days(x)
    return np.matmul(w, w.T)


def parity(t: Tensor) -> Tensor:
    """Sums by parity of both coordinates; an odd extent counts as one longer."""
    rows, cols = (n + n % 2 for n in t.shape)
    return Tensor(t.df, t.meta.with_(shape=(rows, cols))).reshape(rows // 2, 2, cols // 2, 2).sum((0, 2))


def wide(digits: int = 9, **tensors: Tensor) -> DataFrame:
    """Tensors of one shape side by side, a column each; reals rounded."""
    dims = next(iter(tensors.values())).dims
    value = lambda t: F.col("v") if t.dtype.kind in "biu" else F.round("v", digits) + 0.0
    return reduce(lambda a, b: a.join(b, dims), [t.dense().df.select(*dims, value(t).alias(n)) for n, t in tensors.items()])


def parts(spark: SparkSession, digits: int = 6, **tensors) -> DataFrame:
    """Tensors and numbers of any shape one under the other: part, d0, d1, v; cells that are zero are left out."""
    out = []
    for name, t in tensors.items():
        t = t if isinstance(t, Tensor) else fixed(spark, t)
        dims = [F.col(f"d{i}").cast("long") if i < t.ndim else F.lit(0).cast("long") for i in range(2)]
        rows = t.df.select(F.lit(name).alias("part"), *(c.alias(f"d{i}") for i, c in enumerate(dims)), (F.round(F.col("v").cast("double"), digits) + 0.0).alias("v"))
        out.append(rows.where("v <> 0"))
    return reduce(DataFrame.unionByName, out)


def on_e(**expressions: str) -> str:
    return "SELECT i AS d0, k AS d1, " + ", ".join(f"{e} AS {n}" for n, e in expressions.items()) + " FROM E"


def ro(expression: str, digits: int = 9) -> str:
    return f"ROUND({expression}, {digits}) + 0.0"


@query("E", on_e(quotient=ro("v / (v * v + 1)"), inverse="CASE WHEN v = 0 THEN 'inf'::DOUBLE ELSE ROUND(1 / v, 9) + 0.0 END", rest=ro("v % 0.25e0")))
def ufunc_divide(spark, e):
    return wide(quotient=e / (e * e + 1.0), inverse=np.reciprocal(e), rest=np.fmod(e, 0.25))


@query("E", on_e(whole="FLOOR(v / 0.25) + 0.0", rest=ro("v - 0.25 * FLOOR(v / 0.25)"), fraction=ro("v * 8 - TRUNC(v * 8)"), integral="TRUNC(v * 8) + 0.0",
                 mantissa="CASE WHEN v = 0 THEN 0 ELSE ROUND(v / POWER(2, FLOOR(LOG2(ABS(v))) + 1), 9) END + 0.0", exponent="CAST(CASE WHEN v = 0 THEN 0 ELSE FLOOR(LOG2(ABS(v))) + 1 END AS BIGINT)"))
def ufunc_two_results(spark, e):
    whole, rest = np.divmod(e, 0.25)
    fraction, integral = np.modf(e * 8.0)
    mantissa, exponent = np.frexp(e)
    return wide(whole=whole, rest=rest, fraction=fraction, integral=integral, mantissa=mantissa, exponent=exponent)


@query("E", on_e(log1p=ro("LN(1 + v * v)"), log2=ro("LOG2(1 + v * v)"), log10=ro("LOG10(1 + v * v)"), expm1=ro("EXP(v) - 1"), add=ro("LN(EXP(v) + EXP(0.5e0))"), add2=ro("LOG2(POWER(2, v) + POWER(2, 0.5e0))")))
def ufunc_logarithms(spark, e):
    square = np.square(e)
    return wide(log1p=np.log1p(square), log2=np.log2(square + 1.0), log10=np.log10(square + 1.0), expm1=np.expm1(e), add=np.logaddexp(e, 0.5), add2=np.logaddexp2(e, 0.5))


@query("E", on_e(angle=ro("ATAN2(v, 0.5e0)"), length=ro("SQRT(v * v + 0.25)"), degrees=ro("DEGREES(v)"), radians=ro("RADIANS(v)")))
def ufunc_angles(spark, e):
    return wide(angle=np.arctan2(e, 0.5), length=np.hypot(e, 0.5), degrees=np.degrees(e), radians=np.radians(e))


@query("E", on_e(sin=ro("SIN(v)"), cos=ro("COS(v)"), tan=ro("TAN(v / 8)"), arcsin=ro("ASIN(SIN(v) * 0.9)"), arccos=ro("ACOS(SIN(v) * 0.9)"), sinh=ro("(EXP(v) - EXP(-v)) / 2"), cosh=ro("(EXP(v) + EXP(-v)) / 2"), tanh=ro("(EXP(2 * v) - 1) / (EXP(2 * v) + 1)")))
def ufunc_trigonometry(spark, e):
    part = np.sin(e) * 0.9
    return wide(sin=np.sin(e), cos=np.cos(e), tan=np.tan(e / 8.0), arcsin=np.arcsin(part), arccos=np.arccos(part), sinh=np.sinh(e), cosh=np.cosh(e), tanh=np.tanh(e))


@query("E", on_e(arcsinh=ro("LN(v + SQRT(v * v + 1))", 8), arccosh=ro("LN(v * v + 2 + SQRT((v * v + 2) * (v * v + 2) - 1))", 8), arctanh=ro("LN((1 + SIN(v) * 0.9) / (1 - SIN(v) * 0.9)) / 2", 8), cube=ro("CBRT(v)", 8), exp2=ro("POWER(2, v)", 8), root=ro("SQRT(ABS(v))", 8)))
def ufunc_inverse_hyperbolic(spark, e):
    return wide(8, arcsinh=np.arcsinh(e), arccosh=np.arccosh(np.square(e) + 2.0), arctanh=np.arctanh(np.sin(e) * 0.9), cube=np.cbrt(e), exp2=np.exp2(e), root=np.sqrt(np.fabs(e)))


@query("E", on_e(nearest="ROUND_EVEN(v * 10, 0) + 0.0", down="FLOOR(v * 10) + 0.0", up="CEIL(v * 10) + 0.0", inwards="TRUNC(v * 10) + 0.0"))
def ufunc_rounding(spark, e):
    ten = e * 10.0
    return wide(nearest=np.rint(ten), down=np.floor(ten), up=np.ceil(ten), inwards=np.trunc(ten))


@query("E", on_e(fmax="GREATEST(v, 0.1e0)", fmin="LEAST(v, 0.1e0)", most="ABS(v)", least="LEAST(v, 0.2e0)", sign="SIGN(v) + 0.0", positive="v + 0.0"))
def ufunc_extremes(spark, e):
    return wide(30, fmax=np.fmax(e, 0.1), fmin=np.fmin(e, 0.1), most=np.maximum(e, -e), least=np.minimum(e, 0.2), sign=np.sign(e), positive=np.positive(e))


@query("E", on_e(differs="v <> 0", conjunction="v > 0 AND v < 0.5", either="v > 0 OR v < -0.5", only="(v > 0) <> (v < 0.5)", negated="v = 0", less="v < 0.1", at_most="v <= 0.1", equal="v = 0.1"))
def ufunc_logic(spark, e):
    low, high = e > 0, e < 0.5
    return wide(differs=np.not_equal(e, 0.0), conjunction=np.logical_and(low, high), either=np.logical_or(low, e < -0.5), only=np.logical_xor(low, high), negated=np.logical_not(e), less=e < 0.1, at_most=e <= 0.1, equal=e == 0.1)


@query("E", on_e(missing="v < 0", endless="v = 0", usual="v > 0", negative="v < 0", copied="CASE WHEN v < 0 THEN -1.5e0 ELSE 1.5e0 END", step="CASE WHEN v < 0 THEN 0e0 WHEN v = 0 THEN 0.5e0 ELSE 1e0 END"))
def ufunc_float_tests(spark, e):
    logs = np.log(e)
    return wide(missing=np.isnan(logs), endless=np.isinf(logs), usual=np.isfinite(logs), negative=np.signbit(e), copied=np.copysign(1.5, e), step=np.heaviside(e, 0.5))


N = "CAST(TRUNC(v * 100) AS BIGINT)"


@query("E", on_e(conjunction=f"{N} & 12", either=f"{N} | 12", differ=f"XOR({N}, 12::BIGINT)", flipped=f"-1 - {N}", left_=f"{N} * 4", right_=f"CAST(FLOOR(TRUNC(v * 100) / 2) AS BIGINT)", ones=f"CAST(BIT_COUNT(ABS({N})) AS BIGINT)"))
def ufunc_bits(spark, e):
    n = (e * 100.0).astype(np.int64)
    return wide(conjunction=n & 12, either=n | 12, differ=n ^ 12, flipped=~n, left_=n << 2, right_=n >> 1, ones=np.bitwise_count(n).astype(np.int64))


@query("E", on_e(divisor=f"CAST(GCD({N}, 12) AS BIGINT)", multiple=f"CAST(LCM({N}, 6) AS BIGINT)", cube=f"{N} * {N} * {N}", scaled="v * 8", quotient=f"CAST(FLOOR(TRUNC(v * 100) / 7) AS BIGINT)", rest=f"{N} - 7 * CAST(FLOOR(TRUNC(v * 100) / 7) AS BIGINT)"))
def ufunc_integers(spark, e):
    n = (e * 100.0).astype(np.int64)
    return wide(30, divisor=np.gcd(n, 12), multiple=np.lcm(n, 6), cube=np.power(n, 3), scaled=np.ldexp(e, 3), quotient=n // 7, rest=n % 7)


@query("E", f"SELECT i AS d0, k AS d1, CAST(POWER(3::DOUBLE, ABS({N}) % 30) AS BIGINT) AS v FROM E")
def ufunc_power_exact(spark, e):
    return np.power(3, np.absolute((e * 100.0).astype(np.int64)) % 30)


@query("E", "SELECT i AS d0, k AS d1, ROUND(v * (1 + v), 9) + 0.0 AS re, ROUND(-2 * v * (1 + v), 9) + 0.0 AS im FROM E")
def ufunc_conjugate(spark, e):
    return rounded(np.multiply(np.conjugate(np.multiply(e.astype(complex), 1 + 2j)), e + 1.0), 9)


@query("O", "SELECT CAST(o_orderkey AS BIGINT) AS d0, o_orderkey % 7 = 0 OR o_orderdate IS NULL AS v FROM orders")
def ufunc_isnat(spark, times):
    return np.isnat(times)


# -- constructors, sinks and handles

FORMS = [[np.full((2, 3), 10 * i + j + 1.0) for j in range(2)] for i in range(2)]


@query("", "SELECT f.range AS form, CAST(a.range AS BIGINT) AS d0, CAST(b.range AS BIGINT) AS d1, CAST(10 * (a.range // 2) + b.range // 3 + 1 AS DOUBLE) AS v FROM range(4) f, range(4) a, range(6) b WHERE f.range < 3 OR (a.range < 2 AND b.range < 3)")
def block_array_forms(spark):
    flat, held = [x for row in FORMS for x in row], np.empty((2, 2), object)
    for i in range(2):
        for j in range(2):
            held[i, j] = FORMS[i][j]
    made = [lf.BlockArray(FORMS, spark=spark), lf.BlockArray(flat, (2, 2), spark), lf.BlockArray(held, spark=spark), lf.BlockArray(FORMS[0][0], spark=spark)]
    return reduce(DataFrame.unionByName, [b.to_coo().df.select(F.lit(f).cast("long").alias("form"), "d0", "d1", "v") for f, b in enumerate(made)])


@query("", "SELECT * FROM (VALUES ('array', 0::BIGINT, 1::BIGINT, 2.5::DOUBLE), ('array', 1, 0, -1), ('scalar', 0, 0, 4), ('wrapped', 0, 0, 7), ('wrapped', 1, 1, 7), ('empty_like', 1, 1, 3), ('full_like', 0, 0, 6), ('full_like', 0, 1, 6), ('full_like', 1, 0, 6), ('full_like', 1, 1, 6), ('off', 0, 2, 1), ('ones', 0, 0, 1), ('ones', 1, 0, 1)) x(part, d0, d1, v)")
def constructors(spark):
    a = fixed(spark, [[0, 2.5], [-1, 0]])
    filled = np.empty_like(a)
    filled[1, 1] = 3
    return parts(spark, array=a, scalar=lf.array(4.0, spark=spark), wrapped=lf.array(lf.identity(2, spark=spark) * 7.0), empty_like=filled, zeros_like=np.zeros_like(a), full_like=np.full_like(a, 6),
                 off=lf.identity_block((2, 3), 6, 1, 0, spark=spark), ones=lf.ones(2, spark=spark))


@query("L", "SELECT 'total' AS sink, SUM(v) AS v FROM L UNION ALL SELECT 'cells', COUNT(*) FROM L UNION ALL SELECT 'rows', MAX(p_partkey) + 1 FROM part UNION ALL SELECT 'item', SUM(v) FROM L UNION ALL SELECT 'array', SUM(v) FROM L UNION ALL SELECT 'complex', SUM(v) FROM L UNION ALL SELECT 'repr', 1 UNION ALL SELECT 'bool', 1")
def sinks(spark, t):
    total = t.sum()
    held = np.asarray(t.sum(0))
    found = {"total": float(total), "cells": int(np.count_nonzero(t)), "rows": len(t), "item": total.item(), "array": held.sum(), "complex": complex(total).real, "repr": repr(t) == f"Tensor(shape={t.shape}, dtype=float64)" == str(t), "bool": bool(total > 0)}
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "sink string, v double")


@query("L", "SELECT part, p AS d0, s AS d1, v FROM L, (VALUES ('copy'), ('persisted'), ('stored')) x(part)")
def handles(spark, t):
    """Copies keep the old table when the handle is written; persisted and stored tensors hold the same cells."""
    own = t.copy()
    own[0:1, :] = 0.0
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp()
    path = f"{base.rstrip('/')}/tensor-{uuid.uuid4().hex}"
    t.write(path)
    held = t.copy().persist()
    held.unpersist()
    return parts(spark, 9, copy=t, persisted=held, stored=lf.read(path, spark))


@query("X", "SELECT CAST(u * 5 + t AS BIGINT) AS d0, CAST(d AS BIGINT) AS d1, v FROM X")
def shape_setter(spark, x):
    y = x.copy()
    y.shape = (-1, x.shape[2])
    return y


@query("E", "SELECT 'first' AS part, i AS d0, k AS d1, v FROM E WHERE k < 5 UNION ALL SELECT 'second', i, k - 5, v FROM E WHERE k BETWEEN 5 AND 39 UNION ALL SELECT 'third', i, k - 40, v FROM E WHERE k >= 40")
def split_list(spark, e):
    first, second, third = np.split(e, [5, 40], axis=1)
    return parts(spark, 30, first=first, second=second, third=third)


@query("E", "SELECT 'p' || x.part AS part, i AS d0, k - x.lo AS d1, v FROM E JOIN (VALUES (0, 0, 10), (1, 10, 19), (2, 19, 28), (3, 28, 37), (4, 37, 46), (5, 46, 55), (6, 55, 64)) x(part, lo, hi) ON k >= lo AND k < hi")
def split_uneven(spark, e):
    return parts(spark, 30, **{f"p{i}": t for i, t in enumerate(np.array_split(e, 7, axis=1))})


@query("E", "SELECT i AS d0, k AS d1, ROUND(v * 2 + i % 3, 9) + 0.0 AS v FROM E")
def operate(spark, e):
    odd = lf.array(np.arange(e.shape[0]) % 3.0, spark=spark)
    return rounded(lf.operate(lambda x, y: 2 * x + y, e, lf.broadcast_to(odd.reshape(-1, 1), e.shape)), 9)


@query("", "SELECT * FROM (VALUES ('unique', 1e0), ('free', 60), ('nesting', 3), ('grid', 4), ('flops', 120), ('bytes', 752), ('qr', 1152), ('transposed', 192), ('cores', 1), ('nodes', 1), ('path', 2), ('autoray', 1)) x(name, v)")
def planning(spark):
    from .plans import cost, meta, planner

    a, b = lf.Meta((3, 4), float), lf.Meta((4, 10), float)
    found = {
        "unique": meta.isunique((3, 1)) and not meta.isunique((3, 3)), "free": float(np.prod(meta.result_shape((3, 4, 2), (4, 10), ([1], [0])))), "nesting": meta.nest_level([[[1]]]), "grid": float(np.prod(meta.measure_shape([[1, 2], [3, 4]]))),
        "flops": cost.flops.tensordot(a, b, ([1], [0])), "bytes": cost.mem.tensordot(a, b, ([1], [0])) + 96, "qr": cost.mem.qr(lf.Meta((3, 4, 4), float)), "transposed": cost.mem.transpose(a),
        "cores": cost.core_count(spark) >= 1, "nodes": cost.node_count(spark) >= 1, "path": len(planner.path(["ab", "bc", "cd"], "ad", dict(a=2, b=3, c=4, d=5))), "autoray": register_autoray() in (True, False),
    }
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "name string, v double")


# -- blocks

@query("X", "SELECT CAST(d AS BIGINT) AS d0, CAST(u AS BIGINT) AS d1, CAST(t AS BIGINT) AS d2, v FROM X")
def block_transpose(spark, x):
    return lf.to_blocks(x, (64, 2, 8)).transpose((2, 0, 1)).to_coo()


@query("X", "SELECT CAST(u * 5 + t AS BIGINT) AS d0, CAST(d AS BIGINT) AS d1, v FROM X")
def block_reshape(spark, x):
    return lf.to_blocks(x, (64, 2, 8)).reshape((-1, x.shape[2]))


@query("L", "SELECT 'read' AS part, CAST(0 AS BIGINT) AS d0, CAST(0 AS BIGINT) AS d1, v FROM L WHERE p = 3 AND s = 2 UNION ALL SELECT 'written', p, s, v FROM L WHERE NOT (p = 5 AND s = 4) UNION ALL SELECT 'written', 5, 4, 9.5")
def block_cells(spark, t):
    b = lf.to_blocks(t, (256, 64))
    read = float(b[3, 2])
    b[5, 4] = 9.5
    return parts(spark, read=read, written=b.to_coo())


@query("L", "SELECT s AS d0, SUM(v) AS v FROM L GROUP BY 1")
def block_assembled(spark, t):
    """Row blocks are summed, then the grid of what is left is put together on the driver."""
    ones = lf.to_blocks(lf.ones((1, t.shape[0]), spark=spark), (1, 256))
    whole = lf.tensordot(ones, lf.to_blocks(t, (256, 64)), 1)
    return fixed(spark, np.asarray(whole)[0])


@query("LPSD", "SELECT p AS d0, s AS d1, ROUND(2 * v + EXP(-v / 50), 9) AS v FROM D")
def block_ufuncs(spark, t):
    b = lf.to_blocks(t, (256, 64))
    return rounded((b * 2.0 + np.exp(b * -0.02)).to_coo(zeros=True), 9)


@query("E", "SELECT a.k AS d0, b.k AS d1, ROUND(SUM(3 * a.v * b.v), 6) + 0.0 AS v FROM E a JOIN E b ON a.i = b.i GROUP BY 1, 2")
def block_sequence(spark, e):
    """The sum of the products of two lists, in the three ways of adding up."""
    found = [lf.tensordot([e], [e], (0, 0), method=m) for m in ("sequential", "commutative", "commutative-but-first")]
    return rounded(found[0] + found[1] + found[2])


@query("X", "SELECT CAST(a.t AS BIGINT) AS d0, CAST(b.t AS BIGINT) AS d1, SUM(a.v * b.v) AS v FROM X a JOIN X b ON a.u = b.u AND a.d = b.d GROUP BY 1, 2")
def tensordot_sequence(spark, x):
    half = x.shape[2] // 2
    halves = [x[:, :, :half], x[:, :, half:]]
    return lf.tensordot(halves, halves, ([0, 2], [0, 2]))


# -- contractions

@query("X", f"SELECT 'dot' AS part, CAST(a.t AS BIGINT) AS d0, CAST(b.t AS BIGINT) AS d1, SUM(a.v * b.v) AS v FROM {W} a JOIN {W} b ON a.d = b.d GROUP BY 1, 2, 3 UNION ALL SELECT 'inner', CAST(a.t AS BIGINT), CAST(b.t AS BIGINT), SUM(a.v * b.v) FROM {W} a JOIN {W} b ON a.d = b.d GROUP BY 1, 2, 3 "
            f"UNION ALL SELECT 'vdot', 0, 0, SUM(v * v) FROM {W} UNION ALL SELECT 'vecdot', CAST(t AS BIGINT), 0, SUM(v * v) FROM {W} GROUP BY 1, 2, 3 UNION ALL SELECT 'chain', CAST(a.t AS BIGINT), CAST(b.d AS BIGINT), SUM(a.v * b.v) FROM {G} a(t, e, v) JOIN {W} b ON b.t = a.e GROUP BY 1, 2, 3")
def products(spark, x):
    w = days(x)
    return parts(spark, dot=np.dot(w, w.T), inner=np.inner(w, w), vdot=np.vdot(w, w), vecdot=np.vecdot(w, w), chain=np.linalg.multi_dot([w, w.T, w]))


@query("X", f"SELECT 'einsum' AS part, CAST(i AS BIGINT) AS d0, CAST(j AS BIGINT) AS d1, v FROM {G} UNION ALL SELECT 'cumsum', CAST(t AS BIGINT), CAST(d AS BIGINT), SUM(v) OVER (PARTITION BY t ORDER BY d) FROM {W} UNION ALL SELECT 'ufunc', CAST(t AS BIGINT), CAST(d AS BIGINT), 2 * v FROM {W}")
def outputs(spark, x):
    """Results written into tensors that are given with out=."""
    w = days(x)
    product, running, doubled = lf.zeros((5, 5), spark=spark), lf.zeros(w.shape, spark=spark), lf.zeros(w.shape, spark=spark)
    np.einsum("td,sd->ts", w, w, out=product)
    np.cumsum(w, axis=1, out=running)
    np.multiply(w, 2.0, out=doubled)
    return parts(spark, einsum=product, cumsum=Tensor(running.df.join(w.df.select("d0", "d1"), ["d0", "d1"], "left_semi"), running.meta), ufunc=doubled)


@query("L", "SELECT SUM(v) AS v FROM L WHERE p = s")
def trace(spark, t):
    return np.trace(t)


@query("X", f"SELECT CAST(a.i AS BIGINT) AS d0, CAST(b.j AS BIGINT) AS d1, SUM(a.v * b.v) AS v FROM {G} a JOIN {G} b ON a.j = b.i GROUP BY 1, 2")
def matrix_power(spark, x):
    return np.linalg.matrix_power(gram_of_days(x), 2)


@query("X", f"SELECT SUM(a.v * b.v) AS v FROM (SELECT a.i, b.j, SUM(a.v * b.v) AS v FROM {G} a JOIN {G} b ON a.j = b.i GROUP BY 1, 2) a JOIN {G} b ON a.j = b.i AND b.j = a.i")
def ring_network(spark, x):
    """A closed ring of three equal tensors, through the planner."""
    g = gram_of_days(x)
    return np.einsum("ab,bc,ca->", g, g, g)


# -- reductions, running values, scatters

@query("LPSD", "SELECT 'std' AS part, p AS d0, CAST(0 AS BIGINT) AS d1, ROUND(STDDEV_POP(v), 6) AS v FROM D GROUP BY 1, 2 UNION ALL SELECT 'var', s, 0, ROUND(VAR_SAMP(v), 6) FROM D GROUP BY 1, 2 HAVING VAR_SAMP(v) > 0 UNION ALL SELECT 'min', s, 0, MIN(v) FROM D GROUP BY 1, 2 HAVING MIN(v) <> 0")
def spread(spark, t):
    return parts(spark, std=t.std(axis=1), var=t.var(axis=0, ddof=1), min=t.min(axis=0))


@query("E", "SELECT k AS d0, ROUND(VAR_POP(v) * 5, 9) AS spread, ROUND(EXP(SUM(LN(1 + v * v / 100))), 6) AS product, BOOL_OR(v > 0.3) AS some, BOOL_AND(v > -0.3) AS every, ROUND(SQRT(SUM(v * v)), 9) AS length, CAST(arg_max(i, v) AS BIGINT) AS top FROM E GROUP BY 1")
def reduce_forms(spark, e):
    z = np.multiply(e.astype(complex), 1 + 2j)
    found = wide(spread=z.var(axis=0), product=np.multiply.reduce(np.square(e) / 100.0 + 1.0, axis=0), some=(e > 0.3).any(axis=0), every=(e > -0.3).all(axis=0), length=np.hypot.reduce(e, axis=0), top=e.argmax(axis=0))
    return found.withColumn("product", F.round("product", 6))


@query("E", "SELECT i AS d0, ROUND(2 * SUM(v) FILTER (k = 0) - SUM(v), 9) + 0.0 AS rest, CAST(BIT_OR(CAST(TRUNC(ABS(v) * 100) AS BIGINT)) AS BIGINT) AS bits, ROUND(LN(SUM(EXP(v))), 9) AS logs FROM E GROUP BY 1")
def reduce_other_ufuncs(spark, e):
    n = np.trunc(np.absolute(e) * 100.0).astype(np.int64)
    return wide(rest=np.subtract.reduce(e, axis=1), bits=np.bitwise_or.reduce(n, axis=1), logs=np.logaddexp.reduce(e, axis=1))


@query("E", "SELECT i AS d0, k AS d1, MAX(v) OVER w AS high, MIN(v) OVER w AS low, ROUND(2 * FIRST_VALUE(v) OVER w - SUM(v) OVER w, 9) + 0.0 AS rest, ROUND(EXP(SUM(LN(1 + v * v / 100)) OVER w), 9) AS product FROM E WINDOW w AS (PARTITION BY i ORDER BY k ROWS UNBOUNDED PRECEDING)")
def accumulate_forms(spark, e):
    out = wide(30, high=np.maximum.accumulate(e, axis=1), low=np.minimum.accumulate(e, axis=1), rest=np.subtract.accumulate(e, axis=1), product=np.cumprod(np.square(e) / 100.0 + 1.0, axis=1))
    return out.withColumn("rest", F.round("rest", 9) + 0.0).withColumn("product", F.round("product", 9))


@query("E", "SELECT i * 64 + k AS d0, ROUND(MIN(v) OVER (ORDER BY i, k ROWS UNBOUNDED PRECEDING), 9) + 0.0 AS v FROM E")
def accumulate_flat(spark, e):
    return rounded(np.minimum.accumulate(e.reshape(-1)), 9)


@query("LPSD", "SELECT 'max' AS part, p AS d0, s AS d1, CASE WHEN p = 1 AND s = 2 THEN GREATEST(v, 70) ELSE v END AS v FROM D WHERE v <> 0 OR (p = 1 AND s = 2) UNION ALL SELECT 'times', p, s, CASE WHEN p = 1 AND s = 2 THEN 6 * v ELSE v END FROM L UNION ALL SELECT 'twice', p, s, CASE WHEN p = 3 AND s = 4 THEN -v ELSE v END FROM L")
def scatter_forms(spark, t):
    most, times, twice = t.copy(), t.copy(), t.copy()
    np.maximum.at(most, ([1, 1], [2, 2]), np.array([70.0, 20.0]))
    np.multiply.at(times, ([1, 1], [2, 2]), np.array([2.0, 3.0]))
    np.negative.at(twice, ([1, 1, 3], [2, 2, 4]))
    return parts(spark, max=most, times=times, twice=twice)


@query("X", f"SELECT CAST(t AS BIGINT) AS d0, CAST(d AS BIGINT) AS d1, CASE WHEN v >= 128 THEN v - 256 * FLOOR((v + 128) / 256) ELSE v END::BIGINT AS v FROM {W}")
def astype_narrow(spark, x):
    return days(x).astype(np.int64).astype(np.int8)


# -- factorisations and solvers

@query("E", "SELECT i AS d0, k AS d1, ROUND(v, 6) + 0.0 AS v FROM E")
def qr_product(spark, e):
    q, r = np.linalg.qr(e)
    return rounded(np.matmul(q, r))


@query("E", EYE.format(n=64))
def qr_orthogonal(spark, e):
    q, _ = np.linalg.qr(e)
    return rounded(np.einsum("ia,ib->ab", q, q), 9)


@query("E", "SELECT i AS d0, k AS d1, ROUND(v, 6) + 0.0 AS v FROM E")
def svd_product(spark, e):
    u, s, vh = np.linalg.svd(e, full_matrices=False)
    return rounded(np.matmul(np.multiply(u, s), vh))


@query("E", "SELECT ROUND(SUM(v * v), 6) AS v FROM E")
def svd_energy(spark, e):
    s = np.linalg.svd(e, compute_uv=False)
    return rounded(np.vdot(s, s))


@query("E", "SELECT i AS d0, k AS d1, ROUND(v, 6) + 0.0 AS v FROM E")
def svd_matrix_product(spark, e):
    us, vh = lf.svd_matrix(e)
    return rounded(np.matmul(us, vh))


@query("E", "SELECT i AS d0, k AS d1, ROUND(v, 6) + 0.0 AS v FROM E")
def schmidt_product(spark, e):
    """With all triplets kept, the split gives the tensor back."""
    u, s, v = lf.schmidt(e, 1, chi=64)
    return rounded(np.matmul(np.multiply(u, s), v))


@query("X", f"SELECT x.part, i AS d0, j AS d1, v FROM {G}, (VALUES ('cholesky'), ('eigh'), ('eig'), ('pinv')) x(part)")
def factorisations(spark, x):
    """C C^T, V diag(w) V^T (symmetric and general) and A pinv(A) A of the Gram matrix."""
    g = gram_of_days(x)
    c = np.linalg.cholesky(g)
    w, v = np.linalg.eigh(g)
    w2, v2 = np.linalg.eig(g)
    general = np.matmul(np.multiply(v2, w2), np.linalg.inv(v2))
    general = general.real if general.meta.is_complex else general
    return parts(spark, 2, cholesky=np.matmul(c, c.T), eigh=np.matmul(np.multiply(v, w), v.T), eig=general, pinv=np.matmul(np.matmul(g, np.linalg.pinv(g)), g))


@query("X", f"SELECT 'eigvalsh' AS part, CAST(0 AS BIGINT) AS d0, CAST(0 AS BIGINT) AS d1, SUM(v) AS v FROM {G} WHERE i = j UNION ALL SELECT 'eigvals', 0, 0, SUM(v) FROM {G} WHERE i = j UNION ALL SELECT 'rank', 0, 0, 5e0")
def eigenvalues(spark, x):
    g = gram_of_days(x)
    general = np.linalg.eigvals(g)
    return parts(spark, 2, eigvalsh=np.linalg.eigvalsh(g).sum(), eigvals=(general.real if general.meta.is_complex else general).sum(), rank=np.linalg.matrix_rank(g))


@query("L", f"SELECT 'det' AS part, CAST(0 AS BIGINT) AS d0, CAST(0 AS BIGINT) AS d1, ROUND((a * d - b * c) / 1e6, 3) AS v FROM {M} UNION ALL SELECT 'sign', 0, 0, SIGN(a * d - b * c) FROM {M} UNION ALL SELECT 'log', 0, 0, ROUND(LN(ABS(a * d - b * c)), 3) FROM {M} "
            f"UNION ALL SELECT 'cond', 0, 0, ROUND(SQRT((q + SQRT(q * q - 4 * e * e)) / (q - SQRT(q * q - 4 * e * e))), 2) FROM (SELECT a * a + b * b + c * c + d * d AS q, a * d - b * c AS e FROM {M})")
def determinants(spark, t):
    m = parity(t)
    sign, log = np.linalg.slogdet(m)
    out = parts(spark, 3, det=np.linalg.det(m) / 1e6, sign=sign, log=log, cond=np.linalg.cond(m))
    return out.withColumn("v", F.when(F.col("part") == "cond", F.round("v", 2)).otherwise(F.col("v")))


@query("X", "SELECT x.part, CAST(a.range AS BIGINT) AS d0, CAST(b.range AS BIGINT) AS d1, 1e0 AS v FROM range(5) a, range(5) b, (VALUES ('inv'), ('tensorinv'), ('solve'), ('tensorsolve')) x(part) WHERE (x.part LIKE '%inv' AND a.range = b.range) OR (x.part LIKE '%solve' AND b.range = 0)")
def solvers(spark, x):
    """A A^-1 is the identity; the solutions of A x = A 1 are ones."""
    g = gram_of_days(x)
    right = np.matmul(g, lf.ones(5, spark=spark))
    return parts(spark, 4, inv=np.matmul(g, np.linalg.inv(g)), tensorinv=np.matmul(g, np.linalg.tensorinv(g, 1)), solve=np.linalg.solve(g, right), tensorsolve=np.linalg.tensorsolve(g, right))


@query("E", "SELECT CAST(range AS BIGINT) AS d0, 1e0 AS v FROM range(64)")
def least_squares(spark, e):
    return rounded(np.linalg.lstsq(e, np.matmul(e, lf.ones(64, spark=spark)))[0])
