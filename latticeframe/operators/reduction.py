"""Reductions, running sums and scatters."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.meta import Meta, normal_axes, normal_axis
from .coords import astype, reshape, transpose
from .tensor import STRETCH, Tensor, from_runs, marked, register, sql_type, until

#: ufunc name -> aggregate of a stored column and the value that a missing cell contributes.
AGGREGATES = {
    "add": (F.sum, 0), "multiply": (F.product, 0), "maximum": (F.max, 0), "minimum": (F.min, 0), "fmax": (F.max, 0), "fmin": (F.min, 0),
    "logical_and": (F.bool_and, False), "logical_or": (F.bool_or, False), "bitwise_and": (F.bit_and, 0), "bitwise_or": (F.bit_or, 0), "bitwise_xor": (F.bit_xor, 0),
}


#: Blocks of a running sum up to this number send their totals to every task.
MOST_BLOCKS = 1 << 20
#: Most stretches of a reduceat: they are sent to every task.
MOST_SPANS = 100_000
#: Stretches up to this number are found by an expression, not by a join.
FEW_SPANS = 256
#: Longest line that one task reduces where no aggregate will do.
MOST_LINE = 1 << 24
#: Most cells of a right-hand side that at() brings to the driver.
MOST_UPDATES = 1 << 20


def _layout(a: Tensor, axis, keepdims: bool):
    axes = normal_axes(axis, a.ndim)
    keep = [i for i in range(a.ndim) if i not in axes]
    shape = tuple(1 if i in axes else n for i, n in enumerate(a.shape)) if keepdims else tuple(a.shape[i] for i in keep)
    coords = [F.lit(0) if i in axes else F.col(f"d{i}") for i in range(a.ndim)] if keepdims else [F.col(f"d{i}") for i in keep]
    return axes, keep, shape, coords


def _aggregate(a: Tensor, axis, keepdims: bool, columns: list, dtype) -> Tensor:
    """Aggregates by the kept dimensions, cells of missing groups left out (they are zero)."""
    _, keep, shape, coords = _layout(a, axis, keepdims)
    meta = Meta(shape, dtype)
    names = ["re", "im"] if meta.is_complex else ["v"]
    df = a.df.groupBy(*(f"d{i}" for i in keep)).agg(*(c.alias(f"__{n}") for c, n in zip(columns, names, strict=True)))
    zero = F.lit(False) if meta.dtype.kind == "b" else F.lit(0)
    cells = [F.coalesce(F.col(f"__{n}"), zero).cast(sql_type(dtype)).alias(n) for n in names]
    return Tensor(df.select(*(c.cast("long").alias(f"d{i}") for i, c in enumerate(coords)), *cells), meta)


@register("sum")
def sum_(a: Tensor, axis=None, dtype=None, out=None, keepdims=False) -> Tensor:
    dtype = np.dtype(dtype) if dtype else np.sum(np.zeros(1, a.dtype)).dtype
    a = astype(a, dtype) if dtype.kind != a.dtype.kind else a
    return _aggregate(a, axis, keepdims, [F.sum(c) for c in a.values], dtype)


@register("mean")
def mean(a: Tensor, axis=None, keepdims=False) -> Tensor:
    n = math.prod(a.shape[i] for i in normal_axes(axis, a.ndim))
    dtype = a.dtype if a.dtype.kind in "fc" else np.dtype(np.float64)
    a = astype(a, dtype)
    return _aggregate(a, axis, keepdims, [F.sum(c) / float(max(n, 1)) for c in a.values], dtype)


@register("var")
def var(a: Tensor, axis=None, keepdims=False, ddof=0) -> Tensor:
    """Two passes: the mean first, then the squared deviations, with a term for cells that are not stored."""
    if a.meta.is_complex:  # the squared distance in the plane
        return var(a.real, axis, keepdims, ddof) + var(a.imag, axis, keepdims, ddof)
    n = math.prod(a.shape[i] for i in normal_axes(axis, a.ndim))
    a = astype(a, np.float64)
    center = mean(a, axis, keepdims=True)
    axes = normal_axes(axis, a.ndim)
    keep = [f"d{i}" for i in range(a.ndim) if i not in axes]
    m = center.df.select(*keep, F.col("v").alias("m"))
    joined = a.df.join(m, keep) if keep else a.df.crossJoin(F.broadcast(m))
    parts = Tensor(joined.select(*a.dims, ((F.col("v") - F.col("m")) ** 2 - F.col("m") ** 2).alias("v"), F.col("m")), a.meta)
    total = (F.sum("v") + F.lit(float(n)) * F.first("m") ** 2) / float(n - ddof)
    return _aggregate(parts, axis, keepdims, [total], np.float64)


@register("std")
def std(a: Tensor, axis=None, keepdims=False, ddof=0) -> Tensor:
    return np.sqrt(var(a, axis, keepdims, ddof))


def ufunc_reduce(ufunc, a: Tensor, axis=0, keepdims=False, dtype=None) -> Tensor:
    name = ufunc.__name__
    if name == "add":
        return sum_(a, axis, dtype, keepdims=keepdims)
    if name not in AGGREGATES or a.meta.is_complex:
        return _by_lines(ufunc, a, axis, keepdims, "reduce")
    aggregate, zero = AGGREGATES[name]
    n = math.prod(a.shape[i] for i in normal_axes(axis, a.ndim))
    if not n and name in ("maximum", "minimum", "fmax", "fmin"):
        raise ValueError("zero-size array to reduction operation which has no identity")
    logical = name.startswith("logical")
    value = ((F.col("v") if a.dtype.kind == "b" else F.col("v") != 0)) if logical else F.col("v").cast("int").cast("long") if a.dtype.kind == "b" else F.col("v")
    out = np.dtype(bool) if logical or a.dtype.kind == "b" and name != "multiply" else np.dtype(dtype) if dtype else np.prod(np.zeros(1, a.dtype)).dtype if name == "multiply" else a.dtype
    all_stored = F.count(F.lit(1)) == n
    result = aggregate(value)
    if name in ("maximum", "fmax"):
        result = F.when(all_stored, result).otherwise(F.greatest(result, F.lit(zero).cast(sql_type(a.dtype)) if a.dtype.kind != "b" else F.lit(0)))
    elif name in ("minimum", "fmin"):
        result = F.when(all_stored, result).otherwise(F.least(result, F.lit(zero).cast(sql_type(a.dtype)) if a.dtype.kind != "b" else F.lit(0)))
    elif name in ("multiply", "logical_and", "bitwise_and"):
        result = F.when(all_stored, result).otherwise(F.lit(zero))
    if a.dtype.kind == "f" and name in ("maximum", "minimum"):
        result = F.when(F.bool_or(F.isnan("v")), F.lit(float("nan"))).otherwise(result)
    if a.dtype.kind == "f" and name in ("fmax", "fmin"):
        value = F.when(~F.isnan("v"), F.col("v"))
        result = F.when(all_stored, F.coalesce(aggregate(value), F.lit(float("nan")))).otherwise((F.greatest if name == "fmax" else F.least)(aggregate(value), F.lit(0.0)))
    if name == "multiply" and not n:
        return np.asarray(1)
    return _aggregate(a, axis, keepdims, [result], out)


def _by_lines(ufunc, a: Tensor, axis, keepdims: bool, method: str) -> Tensor:
    """ufunc.reduce or ufunc.accumulate itself, a line of at most MOST_LINE cells at a time, for functions that no
    aggregate stands for (subtract, divide, hypot, ...). The other dimensions partition the work."""
    if ufunc.nin != 2 or ufunc.nout != 1 or ufunc.signature:
        raise ValueError(f"{method} needs a function of two arguments with one result")
    axes = normal_axes(axis, a.ndim)
    if len(axes) != 1:
        if len(axes) != a.ndim or method != "reduce":
            raise TypeError(f"{ufunc.__name__}.{method} goes along one axis, or over the whole tensor")
        flat = _by_lines(ufunc, reshape(a, -1), 0, False, method)
        return reshape(flat, (1,) * a.ndim) if keepdims else flat
    at, n, shape = axes[0], a.shape[axes[0]], a.shape
    if n > MOST_LINE:
        raise ValueError(f"a line of {n} cells is too long for {ufunc.__name__}.{method} (at most {MOST_LINE})")
    complex_, old = a.meta.is_complex, a.dtype
    kind = ufunc.reduce(np.ones(2, old)).dtype if method == "reduce" else ufunc.accumulate(np.ones(2, old)).dtype
    out = Meta(tuple(1 if i == at else m for i, m in enumerate(shape)) if method == "reduce" else shape, kind)
    names, dims = ["re", "im"] if out.is_complex else ["v"], a.dims
    others = [d for i, d in enumerate(dims) if i != at]

    def line(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros(n, old)
        cells[pdf[f"d{at}"]] = pdf["re"] + 1j * pdf["im"] if complex_ else pdf["v"]
        with np.errstate(all="ignore"):
            found = np.atleast_1d(getattr(ufunc, method)(cells))
        data = {d: np.arange(len(found)) if d == f"d{at}" else np.full(len(found), pdf[d].iloc[0]) for d in dims}
        return pd.DataFrame(data | ({"re": found.real, "im": found.imag} if out.is_complex else {"v": found}))

    cells = a.dense().df.select(*dims, *a.values)
    schema = ", ".join([f"{d} long" for d in dims] + [f"{c} {sql_type(kind)}" for c in names])
    result = Tensor(cells.groupBy(*others).applyInPandas(line, schema), out)
    return result if keepdims or method != "reduce" else result.select([F.col(d) for d in others], [m for i, m in enumerate(shape) if i != at])


def _by_ufunc(name):
    def f(a: Tensor, axis=None, out=None, keepdims=False, **_) -> Tensor:
        return ufunc_reduce(name, a, axis, keepdims)
    return f


for _names, _u in ((("prod",), np.multiply), (("max", "amax"), np.maximum), (("min", "amin"), np.minimum), (("any",), np.logical_or), (("all",), np.logical_and)):
    register(*_names)(_by_ufunc(_u))


@register("count_nonzero")
def count_nonzero(a: Tensor, axis=None, keepdims=False):
    """Of the whole tensor an integer, at once; along axes a dense tensor, groups without stored cells count zero."""
    test = F.lit(False)
    for c in a.values:
        test = test | (F.col(c) if a.dtype.kind == "b" else F.col(c) != 0)
    if axis is None and not keepdims:
        return int(a.df.agg(F.count_if(test)).first()[0])
    return _aggregate(a, axis, keepdims, [F.count_if(test)], np.int64).dense()


def _extreme(a: Tensor, axis, sign: int) -> Tensor:
    """Position of the first largest (sign 1) or smallest (-1) value."""
    if axis is None:
        a, axis = reshape(a, -1), 0
    axis = normal_axis(axis, a.ndim)
    a = a.dense()
    best = F.max_by(F.col(f"d{axis}"), F.struct((F.col("v").cast("double") * sign).alias("a"), (-F.col(f"d{axis}")).alias("b")))
    return _aggregate(a, axis, False, [best], np.int64)


@register("argmax")
def argmax(a: Tensor, axis=None) -> Tensor:
    return _extreme(a, axis, 1)


@register("argmin")
def argmin(a: Tensor, axis=None) -> Tensor:
    return _extreme(a, axis, -1)


RUNNING = {"add": F.sum, "multiply": F.product, "maximum": F.max, "minimum": F.min, "logical_and": F.bool_and, "logical_or": F.bool_or}


def accumulate(ufunc, a: Tensor, axis=0) -> Tensor:
    """Running values along an axis; the other dimensions partition the work."""
    name = ufunc.__name__
    if name not in RUNNING or a.meta.is_complex and name != "add":
        return _by_lines(ufunc, a, axis, True, "accumulate")
    axis = normal_axis(axis, a.ndim)
    others = [d for i, d in enumerate(a.dims) if i != axis]
    w = Window.partitionBy(*others).orderBy(f"d{axis}").rowsBetween(Window.unboundedPreceding, 0)
    if name == "add" and a.size and (others or a.size <= 1 << 10):
        return _running_sums(a, axis)
    if not others and a.size > 1 << 10 and name in ("add", "multiply", "maximum", "minimum"):
        return _flat_running(a, name)
    dense = a.dense()
    dtype = np.cumsum(np.zeros(1, a.dtype)).dtype if name in ("add", "multiply") else np.dtype(bool) if name.startswith("logical") else a.dtype
    cell = (lambda c: F.col(c).cast("int").cast("long")) if a.dtype.kind == "b" and name in ("add", "multiply") else (lambda c: F.col(c) != 0) if name.startswith("logical") and a.dtype.kind != "b" else F.col
    found = [RUNNING[name](cell(c)).over(w) for c in a.values]
    if a.dtype.kind == "f" and name in ("maximum", "minimum"):  # a NaN stays from where it occurs
        found = [F.when(F.bool_or(F.isnan("v")).over(w), F.lit(float("nan"))).otherwise(found[0])]
    return dense.map(found, dtype)


def _running_sums(a: Tensor, axis: int) -> Tensor:
    """Sums of the stored cells of each line; the cells between them repeat the last one and are made in place."""
    order = [i for i in range(a.ndim) if i != axis] + [axis]
    n, turned = a.shape[axis], a if order == sorted(order) else transpose(a, order)
    out = _carried(marked(turned, n), turned, n, lambda own, i: own)
    return out if turned is a else transpose(out, [order.index(i) for i in range(a.ndim)])


def _carried(cells, a: Tensor, block: int, total) -> Tensor:
    """Running sums in blocks of positions, total(sum, index of the value) in runs up to the next row."""
    w = Window.partitionBy("__b").orderBy("__i", F.col(a.values[0]).isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    dtype = np.cumsum(np.zeros(1, a.dtype)).dtype
    kind = sql_type(dtype)
    value = lambda c: F.col(c).cast("int").cast(kind) if a.dtype.kind == "b" else F.col(c).cast(kind)
    sums = [total(F.coalesce(F.sum(value(c)).over(w), F.lit(0).cast(kind)), i).alias(f"__r{i}") for i, c in enumerate(a.values)]
    rows = until(cells, block, a.size).select("__i", "__e", F.col(a.values[0]).isNotNull().alias("__own"), *sums)
    length = F.greatest(F.col("__e") - F.col("__i"), F.col("__own").cast("long"))
    runs = rows.select(F.col("__i").alias("__p"), length.alias("__n"), *(F.col(f"__r{i}").alias(c) for i, c in enumerate(a.values))).where("__n > 0")
    return from_runs(runs, Meta(a.shape, dtype))


@register("cumsum")
def cumsum(a: Tensor, axis=None, dtype=None, out=None) -> Tensor:
    """Along an axis a window per line; over the flattened tensor by blocks."""
    result = _flat_running(reshape(a, -1), "add") if axis is None else accumulate(np.add, a, axis)
    result = astype(result, dtype) if dtype else result
    if out is not None:
        out.df, out.meta = astype(result, out.dtype).df, Meta(result.shape, out.dtype)
        return out
    return result


@register("cumprod")
def cumprod(a: Tensor, axis=None) -> Tensor:
    return accumulate(np.multiply, reshape(a, -1) if axis is None else a, 0 if axis is None else axis)


def _flat_running(flat: Tensor, name: str) -> Tensor:
    """Running sums, products or extremes of a vector: aggregates of blocks of cells, running ones over the few blocks,
    and windows inside blocks, so no task sees more than a block of cells."""
    if name == "add" and flat.size:
        return _flat_sums(flat)
    flat, kind = flat.dense(), flat.dtype.kind
    block = max(1, math.isqrt(max(1, flat.size)))
    dtype = np.cumsum(np.zeros(1, flat.dtype)).dtype if name in ("add", "multiply") else flat.dtype
    nan = kind == "f" and name in ("maximum", "minimum")
    values = [F.col(c).cast("int").cast("long") if kind == "b" else F.col(c) for c in flat.values]
    if nan:
        values.append(F.isnan("v"))
    combine = [RUNNING[name]] * len(flat.values) + [F.bool_or] * nan
    both = {"add": lambda x, y: x + y, "multiply": lambda x, y: x * y, "maximum": F.greatest, "minimum": F.least}[name]
    cells = flat.df.select("d0", F.expr(f"d0 div {block}").alias("__b"), *(v.alias(f"__v{i}") for i, v in enumerate(values)))
    parts = cells.groupBy("__b").agg(*(f(f"__v{i}").alias(f"__s{i}") for i, f in enumerate(combine)))
    earlier = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # at most isqrt(size) + 1 rows
    before = parts.select("__b", *(f(f"__s{i}").over(earlier).alias(f"__p{i}") for i, f in enumerate(combine)))
    inside = Window.partitionBy("__b").orderBy("d0").rowsBetween(Window.unboundedPreceding, 0)
    own = [f(f"__v{i}").over(inside) for i, f in enumerate(combine)]
    found = [F.when(F.col(f"__p{i}").isNull(), o).otherwise(both(o, F.col(f"__p{i}")) if i < len(flat.values) else o | F.col(f"__p{i}")) for i, o in enumerate(own)]
    if nan:
        found = [F.when(found[1], F.lit(float("nan"))).otherwise(found[0])]
    if kind == "b" and name in ("maximum", "minimum"):
        found = [found[0] != 0]
    out = cells.join(before, "__b").select("d0", *(x.cast(sql_type(dtype)).alias(c) for x, c in zip(found, flat.values, strict=True)))
    return Tensor(out, Meta(flat.shape, dtype))


def _flat_sums(flat: Tensor) -> Tensor:
    """The same for sums, from stored cells and marks only."""
    block = max(STRETCH, math.isqrt(flat.size))
    cells = marked(flat, block)
    kind = sql_type(np.cumsum(np.zeros(1, flat.dtype)).dtype)
    value = lambda c: F.col(c).cast("int").cast(kind) if flat.dtype.kind == "b" else F.col(c).cast(kind)
    parts = cells.groupBy("__b").agg(*(F.sum(value(c)).alias(f"__s{i}") for i, c in enumerate(flat.values)))
    earlier = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # at most isqrt(size) + 1 rows
    before = parts.select("__b", *(F.coalesce(F.sum(f"__s{i}").over(earlier), F.lit(0).cast(kind)).alias(f"__q{i}") for i in range(len(flat.values))))
    if flat.size // block < MOST_BLOCKS:
        before = F.broadcast(before)
    return _carried(cells.join(before, "__b"), flat, block, lambda own, i: own + F.col(f"__q{i}"))


def reduceat(ufunc, a: Tensor, indices, axis=0) -> Tensor:
    """Reduce the stretches that begin at the given indices; where the next index is not larger, one cell."""
    axis, n = normal_axis(axis, a.ndim), a.shape[axis]
    indices = [int(i) for i in indices]
    if any(not 0 <= i < n for i in indices):
        raise IndexError("index out of bounds")
    if ufunc.__name__ not in AGGREGATES:
        return NotImplemented
    if len(indices) > MOST_SPANS:
        raise ValueError(f"reduceat takes at most {MOST_SPANS} indices, which are broadcast")
    name = ufunc.__name__
    aggregate, _ = AGGREGATES[name]
    d = F.col(f"d{axis}")
    stops = [*indices[1:], n]
    spans = [(k, i, stop if stop > i else i + 1) for k, (i, stop) in enumerate(zip(indices, stops, strict=True))]
    if len(indices) <= FEW_SPANS and (np.diff(indices) > 0).all():
        df = a.inside().where(d >= indices[0]).withColumn("__k", _span(d, indices, 0, len(indices)))
        df = df.withColumn("__w", F.element_at(F.array(*(F.lit(hi - lo).cast("long") for _, lo, hi in spans)), F.col("__k") + 1))
    else:
        # a range join with a list given by the caller
        df = a.inside().join(F.broadcast(a.spark.createDataFrame(spans, "__k long, __lo long, __hi long")), (d >= F.col("__lo")) & (d < F.col("__hi"))).withColumn("__w", F.col("__hi") - F.col("__lo"))
    keys = [F.col("__k").cast("long").alias(f"d{i}") if i == axis else F.col(f"d{i}") for i in range(a.ndim)]
    whole = F.count(F.lit(1)) == F.first("__w")
    # what the cells that are not stored, which are zero, make of an aggregate of the stored ones
    zeros = {"multiply": lambda x: x * a.zero + a.zero, "maximum": lambda x: F.greatest(x, a.zero), "minimum": lambda x: F.least(x, a.zero), "logical_and": lambda x: F.lit(False), "bitwise_and": lambda x: a.zero}
    zeros |= {"fmax": zeros["maximum"], "fmin": zeros["minimum"]}
    found = [x if name not in zeros else F.when(whole, x).otherwise(zeros[name](x)) for x in (aggregate(c) for c in a.values)]
    out = df.select(*keys, "__w", *a.values).groupBy(*a.dims).agg(*(x.alias(c) for x, c in zip(found, a.values, strict=True)))
    return Tensor(out, Meta(tuple(len(indices) if i == axis else m for i, m in enumerate(a.shape)), a.dtype)).dense()


def _span(d, starts: list[int], lo: int, hi: int):
    """Which of starts[lo:hi] (ascending) is the last one up to d: a binary search as an expression."""
    if hi - lo == 1:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(d < starts[mid], _span(d, starts, lo, mid)).otherwise(_span(d, starts, mid, hi))


def scatter(ufunc, a: Tensor, index, b=None) -> Tensor:
    """ufunc.at without buffering: repeated indices all count. index: a list for one dimension, or a tuple of lists."""
    index = [np.asarray(x, np.int64) for x in (index if isinstance(index, tuple) else (index,))]
    if len(index) != a.ndim:
        raise IndexError("one list of indices for each dimension is expected")
    name = ufunc.__name__
    if b is None:
        return _apply_at(ufunc, a, index)
    if isinstance(b, Tensor) and b.size > MOST_UPDATES:
        raise ValueError(f"at() takes at most {MOST_UPDATES} values")
    value = b.to_numpy() if isinstance(b, Tensor) else np.asarray(b)
    index = np.broadcast_arrays(*index)
    value = np.broadcast_to(value, index[0].shape)
    rows = [(*(int(x[i]) % n for x, n in zip(index, a.shape, strict=True)), value[i].item()) for i in range(len(value))]
    updates = as_rows(a, rows, value.dtype)
    combine = {"add": F.sum, "subtract": F.sum, "multiply": F.product, "maximum": F.max, "minimum": F.min}
    if name not in combine:
        return NotImplemented
    total = updates.groupBy(*a.dims).agg(combine[name]("v").alias("u"))
    old = F.coalesce(F.col("v"), F.lit(0).cast(sql_type(a.dtype)))
    u = F.col("u")
    new = {"add": old + u, "subtract": old - u, "multiply": old * u, "maximum": F.greatest(old, u), "minimum": F.least(old, u)}[name]
    joined = a.df.join(total, a.dims, "full")
    return Tensor(joined.select(*a.dims, F.when(u.isNull(), F.col("v")).otherwise(new).cast(sql_type(a.dtype)).alias("v")), a.meta)


def _apply_at(ufunc, a: Tensor, index) -> Tensor:
    """A function of one argument, once for every occurrence of a coordinate in the caller's lists."""
    from .elementwise import unary

    times = Counter(tuple(int(x) % n for x, n in zip(at, a.shape, strict=True)) for at in zip(*np.broadcast_arrays(*index), strict=True))
    wanted = a.spark.createDataFrame([(*at, n) for at, n in times.items()], ", ".join([f"{d} long" for d in a.dims] + ["__n int"]))
    held = wanted.join(a.df, a.dims, "left").select(*a.dims, "__n", *(F.coalesce(F.col(c), F.lit(0)).cast(sql_type(a.dtype)).alias(c) for c in a.values))
    done = a.df.join(wanted, a.dims, "left_anti").select(*a.dims, *a.values)
    for n in sorted(set(times.values())):  # as many rounds as there are different counts
        part = Tensor(held.where(F.col("__n") == n).select(*a.dims, *a.values), a.meta)
        for _ in range(n):
            stored = part.df
            part = astype(unary(ufunc, part), a.dtype)
            part = Tensor(part.df.join(stored.select(*a.dims), a.dims, "left_semi"), a.meta)
        done = done.unionByName(part.df)
    return Tensor(done, a.meta)


def as_rows(a: Tensor, rows, dtype):
    kinds = ", ".join([f"{d} long" for d in a.dims] + [f"v {sql_type(dtype)}"])
    return a.spark.createDataFrame(rows, kinds)

