"""Projections and rewrites of coordinates: indexing, reshape, transpose, split, stack, block, astype."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from ..plans.meta import Meta, infer_shape, isunique, normal_axis, strides
from .tensor import Tensor, as_tensor, register, session, sql_type, unravel


@register("transpose", "permute_dims")
def transpose(a: Tensor, *axes) -> Tensor:
    """Axes as a tuple, a list or single arguments; none reverses them. Only renames columns."""
    axes = axes[0] if len(axes) == 1 and not np.isscalar(axes[0]) else axes or None
    order = list(range(a.ndim))[::-1] if axes is None else [normal_axis(x, a.ndim) for x in axes]
    if len(order) != a.ndim or not isunique(order):
        raise ValueError("axes don't match array")
    return a.select([F.col(f"d{k}") for k in order], [a.shape[k] for k in order])


@register("swapaxes")
def swapaxes(a: Tensor, one: int, two: int) -> Tensor:
    order = list(range(a.ndim))
    order[one], order[two] = order[two], order[one]
    return transpose(a, order)


@register("moveaxis")
def moveaxis(a: Tensor, source: int, destination: int) -> Tensor:
    order = [k for k in range(a.ndim) if k != normal_axis(source, a.ndim)]
    order.insert(normal_axis(destination, a.ndim), normal_axis(source, a.ndim))
    return transpose(a, order)


def linear(a: Tensor, order: str = "C"):
    """The linear index of each cell."""
    terms = [F.col(d) * F.lit(s) for d, s in zip(a.dims, strides(a.shape, order), strict=True)]
    return reduce(lambda x, y: x + y, terms, F.lit(0)).cast("long")


@register("reshape")
def reshape(a: Tensor, shape, order: str = "C", inplace: bool = False, **_) -> Tensor:
    """One -1 is inferred; an integer flattens. inplace rebinds the handle."""
    shape = infer_shape(shape, a.size)
    df = a.df.withColumn("__i", linear(a, order))
    out = Tensor(df.select(*(c.cast("long").alias(f"d{k}") for k, c in enumerate(unravel(F.col("__i"), shape, order))), *a.values), a.meta.with_(shape=shape))
    if inplace:
        a.df, a.meta = out.df, out.meta
        return a
    return out


@register("ravel", "flatten")
def ravel(a: Tensor, order: str = "C") -> Tensor:
    return reshape(a, -1, order) if a.size else reshape(a, 0)


@register("squeeze")
def squeeze(a: Tensor, axis=None) -> Tensor:
    drop = {k for k, n in enumerate(a.shape) if n == 1} if axis is None else {normal_axis(x, a.ndim) for x in np.atleast_1d(axis)}
    if any(a.shape[k] != 1 for k in drop):
        raise ValueError("cannot select an axis to squeeze out which has size not equal to one")
    keep = [k for k in range(a.ndim) if k not in drop]
    return a.select([F.col(f"d{k}") for k in keep], [a.shape[k] for k in keep])


@register("expand_dims")
def expand_dims(a: Tensor, axis: int) -> Tensor:
    axis = normal_axis(axis, a.ndim + 1)
    cols, shape = [F.col(d) for d in a.dims], list(a.shape)
    cols.insert(axis, F.lit(0))
    shape.insert(axis, 1)
    return a.select(cols, shape)


@register("astype")
def astype(a: Tensor, dtype, order="K", casting="unsafe", subok=True, copy=True) -> Tensor:
    """Reals truncate towards zero; NaN and values out of range become the least integer of the type, as NumPy's casts
    to 32 and 64 bits do on common hardware. Integers wrap into narrower types. To boolean is x <> 0; complex to real
    drops the imaginary part."""
    dtype = np.dtype(dtype)
    if not np.can_cast(a.dtype, dtype, casting):
        raise TypeError(f"cannot cast from {a.dtype} to {dtype} according to the rule {casting!r}")
    if a.dtype.kind == "c" and dtype.kind != "c":
        return astype(a.real, dtype)
    if a.dtype.kind == "c":
        return a.map([F.col("re"), F.col("im")], dtype)
    v = F.col("v")
    if dtype.kind == "c":
        return a.map([v.cast("double"), F.lit(0.0)], dtype)
    if dtype.kind == "b":
        return a.map([v if a.dtype.kind == "b" else (v != 0) | F.isnan(v.cast("double"))], dtype)
    if dtype.kind in "iu" and a.dtype.kind == "f":
        low, whole = int(np.iinfo(dtype).min), F.expr("try_cast(v as bigint)")
        inside = ~F.isnan(v) & whole.isNotNull() & whole.between(low, min(int(np.iinfo(dtype).max), (1 << 63) - 1))
        return a.map([F.when(inside, whole).otherwise(F.lit(low).cast("bigint"))], dtype)
    if dtype.kind in "iu" and a.dtype.kind in "iu" and dtype.itemsize < 8 and not np.can_cast(a.dtype, dtype):
        span, low = 1 << 8 * dtype.itemsize, int(np.iinfo(dtype).min)
        return a.map([F.pmod(v - F.pmod(F.lit(low), F.lit(span)), F.lit(span)) + low if low else F.pmod(v, F.lit(span))], dtype)
    if dtype == np.float32:
        return a.map([v.cast("float").cast("double")], dtype)
    return a.map([v.cast(sql_type(dtype))], dtype)


def _slice(n: int, s: slice) -> tuple[int, int, int, int]:
    """first, step, count and last of a slice over n."""
    r = range(*s.indices(n))
    return (r[0], r.step, len(r), r[-1]) if len(r) else (0, 1, 0, -1)


def _expand(a: Tensor, key) -> list:
    key = list(key) if isinstance(key, tuple) else [key]
    count = sum(k is not None and k is not Ellipsis for k in key)
    if sum(k is Ellipsis for k in key) > 1 or count > a.ndim:
        raise IndexError("too many indices for array")
    fill = [slice(None)] * (a.ndim - count)
    at = next((i for i, k in enumerate(key) if k is Ellipsis), len(key))
    return key[:at] + fill + key[at + 1 :]


@register("getitem")
def getitem(a: Tensor, key) -> Tensor:
    """Integers drop their dimension; slices shift; None adds one; lists of equal length select pointwise (as NumPy's
    fancy indexing does); a boolean mask of the tensor's shape selects in C order into one dimension."""
    mask = key if isinstance(key, Tensor) and key.dtype.kind == "b" else None
    if mask is None and isinstance(key, np.ndarray | list) and np.asarray(key).dtype.kind == "b":
        mask = as_tensor(np.asarray(key), a.spark)
    if mask is not None:
        return _masked(a, mask)
    key = _expand(a, key)
    fancy = [i for i, k in enumerate(key) if isinstance(k, list | np.ndarray)]
    df, cols, shape, d, lists = a.df, [], [], 0, []
    where = None
    for i, k in enumerate(key):
        if k is None:
            cols.append(F.lit(0))
            shape.append(1)
            continue
        c, n = F.col(f"d{d}"), a.shape[d]
        if i in fancy:
            index = np.asarray(k, np.int64)
            if index.ndim != 1 or ((index < -n) | (index >= n)).any():
                raise IndexError("index out of bounds, or not a list")
            lists.append((d, index % n))
            if where is None:
                where = len(cols)
                cols.append(F.col("__k"))
                shape.append(None)
        elif isinstance(k, slice):
            first, step, count, last = _slice(n, k)
            lo, hi = min(first, last), max(first, last)
            df = df.where((c >= lo) & (c <= hi) & (F.pmod(c - first, F.lit(abs(step))) == 0) if count else F.lit(False))
            cols.append(F.expr(f"(d{d} - {first}) div ({step})"))
            shape.append(count)
        else:
            k = int(k)
            if not -n <= k < n:
                raise IndexError(f"index {k} is out of bounds for axis {d} with size {n}")
            df = df.where(c == k % n)
        d += 1
    if lists:
        length = max(len(x) for _, x in lists)
        lists = [(d, np.broadcast_to(x, (length,))) for d, x in lists]
        if len(fancy) > 1 and np.any(np.diff(fancy) != 1):  # separated lists: their dimension comes first
            cols.insert(0, cols.pop(where))
            shape.insert(0, shape.pop(where))
        shape = [length if n is None else n for n in shape]
        rows = [(i, *(int(x[i]) for _, x in lists)) for i in range(length)]
        names = [f"__x{d}" for d, _ in lists]
        wanted = a.spark.createDataFrame(rows, ", ".join(f"{c} long" for c in ["__k", *names]))
        df = df.join(F.broadcast(wanted) if length <= 100_000 else wanted, reduce(lambda p, q: p & q, [F.col(f"d{d}") == F.col(f"__x{d}") for d, _ in lists]))
    return Tensor(df, a.meta).select(cols, shape)


def _masked(a: Tensor, mask: Tensor) -> Tensor:
    """Positions in the result come from per-chunk counts, so no single task orders all cells."""
    if mask.shape != a.shape:
        raise IndexError("the mask's shape differs")
    chosen = mask.df.where("v").select(*mask.dims, linear(mask).alias("__i"))
    chunk = max(1, int(max(1, mask.size) ** 0.5))
    chosen = chosen.withColumn("__c", F.expr(f"__i div {chunk}"))
    counts = chosen.groupBy("__c").count()
    from pyspark.sql import Window

    before = counts.select("__c", (F.sum("count").over(Window.orderBy("__c")) - F.col("count")).alias("__b"))
    place = chosen.join(before, "__c").select(*mask.dims, (F.col("__b") + F.row_number().over(Window.partitionBy("__c").orderBy("__i")) - 1).alias("__p"))
    n = int(counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0])  # the result's shape depends on the mask's values
    return Tensor(a.df.join(place, a.dims), a.meta).select([F.col("__p")], (n,))


@register("setitem")
def setitem(a: Tensor, key, value) -> Tensor:
    """A new tensor with value (a scalar, or a tensor of the selection's shape or broadcastable to it) written at key."""
    if (isinstance(key, Tensor) and key.dtype.kind == "b") or (isinstance(key, np.ndarray | list) and np.asarray(key).dtype.kind == "b"):
        mask = as_tensor(key, a.spark)
        rest = a.df.join(mask.df.where("v").select(*mask.dims), a.dims, "left_anti")
        new = mask.df.where("v").select(*mask.dims, F.lit(np.asarray(value, a.dtype).item()).cast(sql_type(a.dtype)).alias("v"))
        return Tensor(rest.unionByName(new), a.meta)
    key = _expand(a, key)
    ranges, shape = [], []
    for n, k in zip(a.shape, key, strict=True):
        if isinstance(k, slice):
            first, step, count, _ = _slice(n, k)
            ranges.append((first, step, count))
            shape.append(count)
        else:
            if not -n <= int(k) < n:
                raise IndexError(f"index {k} is out of bounds for size {n}")
            ranges.append((int(k) % n, 1, 1))
    inside = [F.lit(True)]
    for d, (first, step, count) in zip(a.dims, ranges, strict=True):
        last = first + step * (count - 1)
        inside.append((F.col(d) >= min(first, last)) & (F.col(d) <= max(first, last)) & (F.pmod(F.col(d) - first, F.lit(abs(step))) == 0) if count else F.lit(False))
    rest = a.df.where(~reduce(lambda p, q: p & q, inside)).select(*a.dims, *a.values)
    from .elementwise import broadcast_to

    part = broadcast_to(as_tensor(value, a.spark), tuple(shape))
    part = astype(part, a.dtype)
    cols, free = [], iter(range(len(shape)))
    for k, (first, step, _) in zip(key, ranges, strict=True):
        cols.append(F.col(f"d{next(free)}") * step + first if isinstance(k, slice) else F.lit(first))
    return Tensor(rest.unionByName(part.select(cols, a.shape).df), a.meta)


@register("array_split")
def array_split(a: Tensor, indices_or_sections, axis: int = 0) -> list[Tensor]:
    """As split, but a count need not divide the length: the first parts are one longer."""
    if not np.isscalar(indices_or_sections):
        return split(a, indices_or_sections, axis)
    if indices_or_sections <= 0:
        raise ValueError("number sections must be larger than 0")
    each, longer = divmod(a.shape[normal_axis(axis, a.ndim)], indices_or_sections)
    return split(a, np.cumsum([each + 1] * longer + [each] * (indices_or_sections - longer))[:-1].tolist(), axis)


@register("split")
def split(a: Tensor, indices_or_sections, axis: int = 0) -> list[Tensor]:
    axis = normal_axis(axis, a.ndim)
    n = a.shape[axis]
    if np.isscalar(indices_or_sections):
        if n % indices_or_sections:
            raise ValueError("array split does not result in an equal division")
        cuts = list(range(0, n + 1, n // indices_or_sections)) if n else [0] * (indices_or_sections + 1)
    else:
        cuts = [0, *(min(n, x if x >= 0 else n + x) for x in indices_or_sections), n]
    return [a[(slice(None),) * axis + (slice(lo, max(lo, hi)),)] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


@register("stack")
def stack(arrays, axis: int = 0, out=None) -> Tensor:
    parts = [as_tensor(x, session(arrays)) for x in arrays]
    if len({p.shape for p in parts}) != 1:
        raise ValueError("all input arrays must have the same shape")
    dtype, axis = np.result_type(*(p.dtype for p in parts)), normal_axis(axis, parts[0].ndim + 1)
    return concatenate([expand_dims(astype(p, dtype), axis) for p in parts], axis)


@register("concatenate", "concat")
def concatenate(arrays, axis: int = 0) -> Tensor:
    parts = [as_tensor(x, session(arrays)) for x in arrays]
    dtype, axis = np.result_type(*(p.dtype for p in parts)), normal_axis(axis, parts[0].ndim)
    offset, frames = 0, []
    for p in parts:
        if p.ndim != parts[0].ndim or any(x != y for k, (x, y) in enumerate(zip(p.shape, parts[0].shape, strict=True)) if k != axis):
            raise ValueError("all the input array dimensions except for the concatenation axis must match exactly")
        frames.append(astype(p, dtype).select([F.col(d) + (offset if k == axis else 0) for k, d in enumerate(p.dims)], p.shape).df)
        offset += p.shape[axis]
    shape = tuple(offset if k == axis else n for k, n in enumerate(parts[0].shape))
    return Tensor(reduce(lambda x, y: x.unionByName(y), frames), Meta(shape, dtype))


@register("block")
def block(arrays) -> Tensor:
    """Assemble nested lists of tensors: the innermost lists along the last axis, and so on outwards."""
    def depth(x):
        return 1 + depth(x[0]) if isinstance(x, list) else 0

    levels, spark = depth(arrays), None

    def first(x):
        return first(x[0]) if isinstance(x, list) else x

    spark = session(first(arrays))
    ndim = max(levels, as_tensor(first(arrays), spark).ndim)

    def build(x, level):
        if not isinstance(x, list):
            t = as_tensor(x, spark)
            while t.ndim < ndim:
                t = expand_dims(t, 0)
            return t
        return concatenate([build(y, level + 1) for y in x], axis=ndim - levels + level)

    return build(arrays, 0)
