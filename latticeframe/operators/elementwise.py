"""Elementwise functions: one projection for one tensor, a join on all coordinates for two.

Which join is safe follows from the function's values at zero: if f(x, 0) = f(0, y) = 0 an inner join will do, if only
f(0, 0) = 0 a full outer join, and otherwise both sides are stored densely first. (As in any sparse algebra, NaN or
infinity times a cell that is not stored counts as zero; call dense() first where that matters.)
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import ufuncs as U
from ..plans.meta import Meta
from .coords import astype
from .tensor import Tensor, as_tensor, from_runs, register, session, sql_type

#: NumPy's other names for the same ufunc are resolved by __name__; these differ between versions.
ALIASES = {"true_divide": "divide", "mod": "remainder", "abs": "absolute", "conj": "conjugate", "bitwise_not": "invert", "bitwise_invert": "invert"}
#: Most cells of a result that stores the pairs of all cells of two tensors; a guard against mistakes.
MOST_OUTER = 1 << 38
TWO_SIDED_ZERO = {"multiply", "bitwise_and", "logical_and"}


def out_dtypes(ufunc: np.ufunc, *dtypes) -> list[np.dtype]:
    with np.errstate(all="ignore"):
        out = ufunc(*(np.ones(1, t) for t in dtypes))
    return [x.dtype for x in out] if isinstance(out, tuple) else [out.dtype]


def at_zero(ufunc: np.ufunc, *values) -> bool:
    """Whether the function is zero there."""
    with np.errstate(all="ignore"):
        out = ufunc(*(np.asarray([v]) for v in values))
    return not np.any(out[0]) if not isinstance(out, tuple) else not any(np.any(x) for x in out)


def broadcast_to(a: Tensor, shape) -> Tensor:
    """Repeat dimensions of size one; new dimensions come first."""
    shape = tuple(shape)
    new = len(shape) - a.ndim
    if new < 0 or any(x not in (1, n) for x, n in zip(a.shape, shape[new:], strict=True)):
        raise ValueError(f"cannot broadcast {a.shape} to {shape}")
    if a.shape == shape:
        return a
    df, cols = a.df, []
    for k, n in enumerate(shape):
        if k >= new and a.shape[k - new] == n:
            cols.append(F.col(f"d{k - new}").alias(f"n{k}"))
        else:
            df = df.withColumn(f"n{k}", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n else df.where("false").withColumn(f"n{k}", F.lit(0))
            cols.append(F.col(f"n{k}"))
    df = df.select(*cols, *a.values)
    return Tensor(df.select(*(F.col(f"n{k}").cast("long").alias(f"d{k}") for k in range(len(shape))), *a.values), a.meta.with_(shape=shape))


register("broadcast_to")(broadcast_to)


def _sql(name: str, kinds: str, args: dict[str, str]):
    """The expressions for a ufunc on inputs of these kinds, or None if it has none."""
    if "c" in kinds:
        form = U.COMPLEX.get(name)
        return None if form is None else [F.expr(t.format(**args)) for t in form if t]
    table = (U.INT_UNARY if len(kinds) == 1 else U.INT_BINARY) if set(kinds) <= set("iub") else {}
    template = table.get(name) or (U.UNARY if len(kinds) == 1 else U.BINARY).get(name)
    return None if template is None else [F.expr(template.format(**args))]


def _typed(t: Tensor, names: list[str], kind: str):
    """Columns of a tensor as DOUBLE or BIGINT, complex always as two."""
    if kind == "c":
        pair = [F.col("re"), F.col("im")] if t.meta.is_complex else [F.col("v").cast("double"), F.lit(0.0)]
        return [c.alias(n) for c, n in zip(pair, names, strict=True)]
    return [F.col("v").cast("bigint" if kind == "i" else "double").alias(names[0])]


def _native(name: str, dtypes) -> str:
    kinds = [t.kind for t in dtypes]
    if "c" in kinds:
        return "c"
    return "i" if all(k in "iub" for k in kinds) and name in (U.INT_UNARY if len(kinds) == 1 else U.INT_BINARY) else "f"


def _by_numpy(ufunc: np.ufunc, which: int, dtype, *cols):
    """A vectorised call of the ufunc itself, for the few that Spark has no expression for."""
    @F.pandas_udf(sql_type(dtype))
    def run(*xs: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            out = ufunc(*(x.to_numpy() for x in xs))
        return pd.Series(np.asarray(out[which] if isinstance(out, tuple) else out).astype({"f": float, "i": np.int64, "u": np.int64}.get(np.dtype(dtype).kind, dtype)))

    return run(*cols)


def _compute(ufunc, name, dtypes, columns) -> list[list]:
    """For each output of the ufunc its value columns; columns: names of x, y (and xi, yi)."""
    kind = _native(name, dtypes)
    outs = out_dtypes(ufunc, *dtypes)
    if name == "divmod":
        return [[_sql(n, "ii" if kind == "i" or all(t.kind in "iub" for t in dtypes) else "ff", columns)[0]] for n in ("floor_divide", "remainder")]
    if name == "modf":
        whole = F.expr(U.UNARY["trunc"].format(**columns))
        return [[F.expr(f"if(abs({columns['x']}) = {U.INF}, 0D, {columns['x']})") - F.when(F.expr(f"abs({columns['x']}) = {U.INF}"), 0.0).otherwise(whole)], [whole]]
    found = _sql(name, kind * len(dtypes), columns)
    if found is None and kind == "i":
        found = _sql(name, "f" * len(dtypes), columns)
    if found is not None:
        return [found]
    if kind == "c":
        raise TypeError(f"{name} of complex tensors is not supported")
    args = [F.col(columns[k]) for k in ("x", "y") if k in columns]
    if any(t.kind == "i" for t in dtypes):
        args = [c.cast("bigint") if t.kind in "iu" else c for c, t in zip(args, dtypes, strict=True)]
    return [[_by_numpy(ufunc, i, t, *args)] for i, t in enumerate(outs)]


def _finish(df, dims, values, dtype, shape) -> Tensor:
    meta = Meta(shape, dtype)
    names = ["re", "im"] if meta.is_complex else ["v"]
    if meta.is_complex and len(values) == 1:
        values = [*values, F.lit(0.0)]
    rows = df.select(*dims, *(c.cast(sql_type(dtype)).alias(n) for c, n in zip(values, names, strict=True)))
    return from_runs(rows, meta) if "__n" in dims else Tensor(rows, meta)


def _places(t: Tensor):
    """The rows that a function of one tensor maps: its runs of equal values where it has them, else its cells."""
    return (t.df, t.dims) if t.runs is None else (t.runs, ["__p", "__n"])


def unary(ufunc: np.ufunc, a: Tensor):
    name = ALIASES.get(ufunc.__name__, ufunc.__name__)
    if name == "isnat":
        return _finish(a.df, a.dims, [F.col("v").isNull()], np.dtype(bool), a.shape)
    if not at_zero(ufunc, np.zeros(1, a.dtype)[0]):
        a = a.dense()
    kind = _native(name, [a.dtype])
    rows, at = _places(a)
    df = rows.select(*at, *_typed(a, ["x", "xi"], kind))
    results = _compute(ufunc, name, [a.dtype], {"x": "x", "xi": "xi"})
    out = [_finish(df, at, r, t, a.shape) for r, t in zip(results, out_dtypes(ufunc, a.dtype), strict=True)]
    return out[0] if len(out) == 1 else tuple(out)


def _scalar_columns(value, kind: str, name: str) -> dict:
    value = np.asarray(value)
    if kind == "c":
        return {name: F.lit(float(value.real)), name + "i": F.lit(float(value.imag))}
    return {name: F.lit(int(value)).cast("bigint") if kind == "i" else F.lit(float(value))}


def binary(ufunc: np.ufunc, a, b):
    name = ALIASES.get(ufunc.__name__, ufunc.__name__)
    spark = session(a, b)
    scalars = [not isinstance(x, Tensor) and np.ndim(x) == 0 for x in (a, b)]
    if any(scalars):
        t, s = (b, a) if scalars[0] else (a, b)
        weak = isinstance(s, bool | int | float | complex) and not isinstance(s, np.generic) and name != "ldexp"
        st = np.result_type(s, t.dtype) if weak and not (t.dtype.kind in "iub" and isinstance(s, float | complex)) else np.asarray(s).dtype
        zero = np.zeros(1, t.dtype)[0]
        if not at_zero(ufunc, *((s, zero) if scalars[0] else (zero, s))):
            t = t.dense()
        dtypes = [st, t.dtype] if scalars[0] else [t.dtype, st]
        kind = _native(name, dtypes)
        own, other = ("y", "x") if scalars[0] else ("x", "y")
        rows, dims = _places(t)
        df = rows.select(*dims, *_typed(t, [own, own + "i"], kind), *(c.alias(n) for n, c in _scalar_columns(s, kind, other).items()))
        shape = t.shape
    else:
        a, b = as_tensor(a, spark), as_tensor(b, spark)
        shape = np.broadcast_shapes(a.shape, b.shape)
        a, b = broadcast_to(a, shape), broadcast_to(b, shape)
        dtypes, dims = [a.dtype, b.dtype], [f"d{i}" for i in range(len(shape))]
        kind = _native(name, dtypes)
        how = "inner" if name in TWO_SIDED_ZERO else "full" if at_zero(ufunc, np.zeros(1, a.dtype)[0], np.zeros(1, b.dtype)[0]) else "dense"
        if how == "dense":
            a, b = a.dense(), b.dense()
        left = a.df.select(*dims, *_typed(a, ["x", "xi"], kind))
        right = b.df.select(*dims, *_typed(b, ["y", "yi"], kind))
        if dims:
            df = left.join(right, dims, "full" if how == "full" else "inner")
        else:
            df = left.withColumn("__k", F.lit(0)).join(right.withColumn("__k", F.lit(0)), "__k", "full" if how == "full" else "inner")
        if how == "full":
            df = df.select(*dims, *(F.coalesce(c, F.lit(0).cast(df.schema[c].dataType)).alias(c) for c in df.columns if c in ("x", "y", "xi", "yi")))
    results = _compute(ufunc, name, dtypes, {c: c for c in ("x", "xi", "y", "yi")})
    out = [_finish(df, dims, r, t, shape) for r, t in zip(results, out_dtypes(ufunc, *dtypes), strict=True)]
    return out[0] if len(out) == 1 else tuple(out)


def outer(ufunc: np.ufunc, a, b) -> Tensor:
    """All pairs, a's dimensions first. Where zeros give zero only stored cells are paired, whatever the shapes."""
    from .contract import crossed

    spark = session(a, b)
    a, b = as_tensor(a, spark), as_tensor(b, spark)
    if ALIASES.get(ufunc.__name__, ufunc.__name__) in TWO_SIDED_ZERO:
        name = ufunc.__name__
        kind = _native(name, [a.dtype, b.dtype])
        left = a.df.select(*a.dims, *_typed(a, ["x", "xi"], kind))
        right = b.df.select(*(F.col(d).alias(f"d{a.ndim + i}") for i, d in enumerate(b.dims)), *_typed(b, ["y", "yi"], kind))
        shape = (*a.shape, *b.shape)
        values = _compute(ufunc, name, [a.dtype, b.dtype], {c: c for c in ("x", "xi", "y", "yi")})[0]
        return _finish(crossed(left, a.size, right, b.size), [f"d{i}" for i in range(len(shape))], values, out_dtypes(ufunc, a.dtype, b.dtype)[0], shape)
    if a.size * b.size > MOST_OUTER:
        raise ValueError(f"the outer product of {a.shape} and {b.shape} is too large")
    wide = a.select([F.col(d) for d in a.dims] + [F.lit(0)] * b.ndim, (*a.shape, *(1,) * b.ndim))
    return binary(ufunc, wide, b)


def apply(ufunc, method, *inputs, out=None, where=True, dtype=None, **kwargs):
    """The ufunc protocol: __call__, outer, reduce, accumulate, reduceat and at."""
    from . import contract, reduction

    if out is not None:
        target = out[0] if isinstance(out, tuple) else out
        result = apply(ufunc, method, *inputs, dtype=dtype, **kwargs)
        if not np.can_cast(result.dtype, target.dtype, "same_kind"):
            raise TypeError(f"cannot cast ufunc output from {result.dtype} to {target.dtype}")
        target.df, target.meta = astype(result, target.dtype).df, Meta(result.shape, target.dtype)
        return target
    if where is not True:
        return NotImplemented
    if method == "__call__":
        if ufunc.signature:
            f = {"matmul": contract.matmul, "vecdot": contract.vecdot, "matvec": contract.matvec, "vecmat": contract.vecmat}.get(ufunc.__name__)
            result = NotImplemented if f is None else f(*inputs)
        elif ufunc.nin > 2:
            return NotImplemented
        else:
            result = unary(ufunc, inputs[0]) if ufunc.nin == 1 else binary(ufunc, *inputs)
        return astype(result, dtype) if dtype is not None and isinstance(result, Tensor) else result
    if method == "outer":
        return outer(ufunc, *inputs)
    if method == "reduce":
        return reduction.ufunc_reduce(ufunc, inputs[0], kwargs.get("axis", 0), kwargs.get("keepdims", False), dtype)
    if method == "accumulate":
        return reduction.accumulate(ufunc, inputs[0], inputs[1] if len(inputs) > 1 else kwargs.get("axis", 0))
    if method == "reduceat":
        return reduction.reduceat(ufunc, inputs[0], inputs[1], kwargs.get("axis", 0))
    if method == "at":
        new = reduction.scatter(ufunc, *inputs)
        inputs[0].df, inputs[0].meta = new.df, new.meta
        return None
    return NotImplemented


def operate(func, *tensors, dtype=np.float64) -> Tensor:
    """Any elementwise Python function of NumPy arrays, run on Arrow batches of aligned cells. All cells are visited."""
    dims = tensors[0].dims
    joined = reduce(lambda x, y: x.join(y, dims), [t.dense().df.select(*dims, F.col("v").alias(f"x{i}")) for i, t in enumerate(tensors)])

    @F.pandas_udf(sql_type(dtype))
    def run(*xs: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(func(*(x.to_numpy() for x in xs)), dtype))

    return Tensor(joined.select(*dims, run(*(F.col(f"x{i}") for i in range(len(tensors)))).alias("v")), Meta(tensors[0].shape, dtype))
