"""Contractions: an equi-join on the contracted coordinates and a sum of products by the free ones."""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..plans import planner
from ..plans.meta import Meta, contraction_axes, normal_axis, strides
from .coords import astype, expand_dims, reshape, squeeze
from .tensor import Tensor, as_tensor, register, session, sql_type

#: A tensor of at most so many elements is sent whole to the cells that it is paired with.
SMALL = 1 << 16
#: Steps of a chain after which the lineage is cut, if the session has a checkpoint folder.
CHECKPOINT_EVERY = 10


def _sum_dtype(*tensors) -> np.dtype:
    return np.result_type(*(t.dtype for t in tensors))


def _product(a: Tensor, b: Tensor) -> list:
    """Value columns of the product of joined cells; a's are named l_*, b's r_*."""
    if not (a.meta.is_complex or b.meta.is_complex):
        kind = sql_type(_sum_dtype(a, b))
        kind = "bigint" if kind == "boolean" else kind
        return [F.col("l_v").cast(kind) * F.col("r_v").cast(kind)]
    lr, li = ("l_re", F.col("l_im")) if a.meta.is_complex else ("l_v", F.lit(0.0))
    rr, ri = ("r_re", F.col("r_im")) if b.meta.is_complex else ("r_v", F.lit(0.0))
    lr, rr = F.col(lr).cast("double"), F.col(rr).cast("double")
    return [lr * rr - li * ri, lr * ri + li * rr]


def crossed(l, l_size: int, r, r_size: int):
    """All pairs of stored cells."""
    if r_size <= SMALL:
        return l.crossJoin(F.broadcast(r))
    return F.broadcast(l).crossJoin(r) if l_size <= SMALL else l.crossJoin(r)


#: Contracted cells of a line up to which lines are multiplied in bundles, lines of a bundle, partitions of a side, and
#: lines of both sides (their product) from which that pays.
SHORT, BUNDLE, SIDE, MANY = 256, 512, 16, 1 << 20
#: Cells of a batch that a Python worker sends.
BATCH_CELLS = 1 << 18


def by_lines(a: Tensor, left: str, b: Tensor, right: str, output: str) -> Tensor:
    """Contraction along few cells and between many lines: bundles of lines meet once, and BLAS sums the products that a
    join would make one by one. As with the join, a result has a row where both lines store a common coordinate."""
    shared = [c for c in left if c in right]
    free_a, free_b = [c for c in left if c not in shared], [c for c in right if c not in shared]
    length = math.prod(a.shape[left.index(c)] for c in shared)

    def bundles(t: Tensor, labels: str, free: list[str], side: str):
        sizes = dict(zip(labels, t.shape, strict=True))
        at = lambda cs: F.expr(" + ".join(f"d{labels.index(c)} * {s}L" for c, s in zip(cs, strides([sizes[c] for c in cs], "C"), strict=True)))
        cells = t.inside().select(at(free).alias("line"), at(shared).cast("int").alias("k"), F.coalesce("v", F.lit(0.0)).alias("v"))
        cells = cells.select(F.expr(f"line div {BUNDLE}L").alias(f"{side}b"), F.expr(f"cast(line % {BUNDLE}L as int)").alias("r"), "k", "v").repartition(SIDE, f"{side}b")
        return cells.groupBy(f"{side}b").agg(*(F.collect_list(c).alias(f"{side}{c}") for c in ("r", "k", "v")))

    pairs = bundles(a, left, free_a, "l").crossJoin(bundles(b, right, free_b, "r").hint("shuffle_replicate_nl"))
    columns = {c: i for i, c in enumerate(pairs.columns)}

    def multiply(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = [batch.column(columns[c])[i] for c in ("lb", "lr", "lk", "lv", "rb", "rr", "rk", "rv")]
                ends = [x.as_py() if j % 4 == 0 else x.values.to_numpy() for j, x in enumerate(one)]
                lines, others, v = _line_products(ends[1:4], ends[5:], length)
                lines, others = lines + ends[0] * BUNDLE, others + ends[4] * BUNDLE
                for lo in range(0, len(v), BATCH_CELLS):
                    at = slice(lo, lo + BATCH_CELLS)
                    yield pa.RecordBatch.from_arrays([pa.array(lines[at]), pa.array(others[at]), pa.array(v[at])], ["l", "r", "v"])

    shape = [dict(zip(left + right, a.shape + b.shape, strict=True))[c] for c in output]
    where = {}
    for line, labels, t, free in (("l", left, a, free_a), ("r", right, b, free_b)):
        sizes = [t.shape[labels.index(c)] for c in free]
        for k, (c, step, n) in enumerate(zip(free, strides(sizes, "C"), sizes, strict=True)):
            whole = f"({line} div {step}L)" if step > 1 else line
            where[c] = F.expr(f"{whole} % {n}L" if k else whole)
    cells = pairs.mapInArrow(multiply, "l long, r long, v double")
    return Tensor(cells.select(*(where[c].alias(f"d{i}") for i, c in enumerate(output)), "v"), Meta(tuple(shape), _sum_dtype(a, b)))


def _line_products(a, b, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For two bundles (line, position, value) the pairs of lines with a common position, and their sums of products.
    Bundles with few common positions are paired cell by cell, others as matrices."""
    (lr, lk, lv), (rr, rk, rv) = a, b
    counts = np.bincount(lk, minlength=length), np.bincount(rk, minlength=length)
    joined = int(counts[0] @ counts[1])
    distinct = all(len(np.unique(r.astype(np.int64) * length + k)) == len(r) for r, k in ((lr, lk), (rr, rk)))
    if joined * 64 < BUNDLE * BUNDLE or not distinct or not (np.isfinite(lv).all() and np.isfinite(rv).all()):
        lo, ro = np.argsort(lk, kind="stable"), np.argsort(rk, kind="stable")
        first = np.cumsum(counts[1]) - counts[1]
        times = counts[1][lk[lo]]
        own = np.repeat(lo, times)
        other = ro[np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[lk[lo]], times)]
        key, where = np.unique(lr[own].astype(np.int64) * BUNDLE + rr[other], return_inverse=True)
        with np.errstate(all="ignore"):
            return key // BUNDLE, key % BUNDLE, np.bincount(where, lv[own] * rv[other], len(key))
    x, y = np.zeros((BUNDLE, length)), np.zeros((length, BUNDLE))
    x[lr, lk], y[rk, rr] = lv, rv
    stored = np.zeros(x.shape, np.float32), np.zeros(y.shape, np.float32)
    stored[0][lr, lk], stored[1][rk, rr] = 1, 1
    lines, others = np.nonzero(stored[0] @ stored[1])
    return lines, others, (x @ y)[lines, others]


def pair(a: Tensor, left: str, b: Tensor, right: str, output: str) -> Tensor:
    """One step: labels shared by both are join keys, labels not in output are summed. Labels within an operand differ."""
    alike = {c for c in left if c in right}
    long = [math.prod(n for c, n in zip(labels, t.shape, strict=True) if c not in alike) for t, labels in ((a, left), (b, right))]
    if alike and set(output) == set(left) ^ set(right) and a.dtype.kind == b.dtype.kind == "f" and min(long) > BUNDLE and math.prod(long) >= MANY and math.prod(n for c, n in zip(left, a.shape, strict=True) if c in alike) <= SHORT:
        return by_lines(a, left, b, right, output)
    own = lambda t, labels, side: t.df.select(*(F.col(f"d{i}").alias(f"{side}{ord(c)}") for i, c in enumerate(labels)), *(F.col(v).alias(f"{side}_{v}") for v in t.values))
    l, r = own(a, left, "l"), own(b, right, "r")
    shared = [c for c in left if c in right]
    joined = l.join(r, reduce(lambda p, q: p & q, [F.col(f"l{ord(c)}") == F.col(f"r{ord(c)}") for c in shared])) if shared else crossed(l, a.size, r, b.size)
    where = {c: (f"l{ord(c)}" if c in left else f"r{ord(c)}") for c in left + right}
    sizes = dict(zip(left, a.shape, strict=True)) | dict(zip(right, b.shape, strict=True))
    dtype = _sum_dtype(a, b)
    meta = Meta(tuple(sizes[c] for c in output), dtype)
    names = ["re", "im"] if meta.is_complex else ["v"]
    cells = joined.select(*(F.col(where[c]).alias(f"d{i}") for i, c in enumerate(output)), *(x.alias(n) for x, n in zip(_product(a, b), names, strict=True)))
    summed = set(left + right) - set(output)
    if summed or not output:
        cells = cells.groupBy(*(f"d{i}" for i in range(len(output)))).agg(*(F.sum(n).alias(n) for n in names))
        if not output:
            cells = cells.select(*(F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names))
    return Tensor(cells.select(*(f"d{i}" for i in range(len(output))), *((F.col(n) != 0 if dtype.kind == "b" else F.col(n)).cast(sql_type(dtype)).alias(n) for n in names)), meta)


@register("tensordot", "linalg.tensordot")
def tensordot(a, b, axes=2, method: str = "sequential") -> Tensor:
    """axes: a count, or two lists; negative axes count from the end. Lists of tensors give the sum of the pairs'
    products. The three methods of accumulating are one here: a partial and a final sum, in any order."""
    if method not in ("sequential", "commutative", "commutative-but-first"):
        raise ValueError(f"unknown method {method!r}")
    if isinstance(a, list | tuple):
        return reduce(lambda x, y: x + y, [tensordot(x, y, axes) for x, y in zip(a, b, strict=True)])
    from .blocked import BlockTensor, block_tensordot

    if isinstance(a, BlockTensor) or isinstance(b, BlockTensor):
        return block_tensordot(a, b, axes)
    spark = session(a, b)
    a, b = as_tensor(a, spark), as_tensor(b, spark)
    left_axes, right_axes = contraction_axes(a.shape, b.shape, axes)
    letters = iter(string.ascii_letters)
    left = [next(letters) for _ in a.shape]
    right = [left[left_axes[right_axes.index(j)]] if j in right_axes else next(letters) for j in range(b.ndim)]
    output = [c for i, c in enumerate(left) if i not in left_axes] + [c for j, c in enumerate(right) if j not in right_axes]
    return pair(a, "".join(left), b, "".join(right), "".join(output))


def reduce_operand(t: Tensor, labels: str, need: set[str]) -> tuple[Tensor, str]:
    """Diagonals for repeated labels, sums over labels that nobody else needs."""
    df, seen = t.df, {}
    for i, c in enumerate(labels):
        if c in seen:
            df = df.where(F.col(f"d{i}") == F.col(f"d{seen[c]}"))
        else:
            seen[c] = i
    keep = [c for c in seen if c in need]
    cols = [F.col(f"d{seen[c]}").alias(f"d{k}") for k, c in enumerate(keep)]
    df = df.select(*cols, *t.values)
    dtype = t.dtype
    if len(keep) < len(seen):
        if dtype.kind == "b":
            df = df.groupBy(*(f"d{k}" for k in range(len(keep)))).agg(F.bool_or("v").alias("v"))
        else:
            df = df.groupBy(*(f"d{k}" for k in range(len(keep)))).agg(*(F.sum(v).alias(v) for v in t.values))
        if not keep:
            df = df.select(*(F.coalesce(F.col(v), F.lit(False) if dtype.kind == "b" else F.lit(0)).cast(sql_type(dtype)).alias(v) for v in t.values))
    return Tensor(df, Meta(tuple(t.shape[seen[c]] for c in keep), dtype)), "".join(keep)


@register("einsum", "linalg.einsum")
def einsum(pattern: str, *operands, out=None, dtype=None, order="K", casting="safe", optimize=True) -> Tensor:
    """Implicit or explicit output, repeated labels and '...'. Operands are contracted pair by pair in planner order,
    each step with its own aggregation; optimize may also be a list of pairs."""
    spark = session(operands)
    tensors = [as_tensor(x, spark) for x in operands]
    inputs, output = planner.parse(pattern, [t.shape for t in tensors])
    sizes: dict[str, int] = {}
    for labels, t in zip(inputs, tensors, strict=True):
        for c, n in zip(labels, t.shape, strict=True):
            sizes[c] = n if sizes.get(c, 1) == 1 else sizes[c]
    result = np.result_type(*(t.dtype for t in tensors)) if dtype is None else np.dtype(dtype)
    if dtype is not None:
        tensors = [astype(t, dtype, casting="unsafe" if casting == "unsafe" else "same_kind") for t in tensors]
    for k, (labels, t) in enumerate(zip(inputs, tensors, strict=True)):  # dimensions of size one broadcast
        ones = [i for i, (c, n) in enumerate(zip(labels, t.shape, strict=True)) if n == 1 and sizes[c] != 1]
        if ones:
            tensors[k] = squeeze(t, ones)
            inputs[k] = "".join(c for i, c in enumerate(labels) if i not in ones)
    live = []
    for k, (labels, t) in enumerate(zip(inputs, tensors, strict=True)):
        need = set(output).union(*(x for j, x in enumerate(inputs) if j != k))
        live.append(reduce_operand(t, labels, need))
    steps = list(optimize) if isinstance(optimize, list) else planner.path([x for _, x in live], output, sizes)
    for count, (i, j) in enumerate(steps, 1):
        (a, left), (b, right) = live[i], live[j]
        rest = [x for k, x in enumerate(live) if k not in (i, j)]
        new = planner.kept(frozenset(left), frozenset(right), [frozenset(x) for _, x in rest], frozenset(output))
        labels = "".join(c for c in dict.fromkeys(left + right) if c in new)
        t = pair(a, left, b, right, labels)
        if count % CHECKPOINT_EVERY == 0 and count < len(steps) and (spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()):
            t = t.checkpoint()
        live = [*rest, (t, labels)]
    t, labels = live[0]
    t = Tensor(t.select([F.col(f"d{labels.index(c)}") for c in output], [sizes[c] for c in output]).df, Meta(tuple(sizes[c] for c in output), t.dtype))
    t = astype(t, result)
    if out is not None:
        out.df, out.meta = astype(t, out.dtype).df, Meta(t.shape, out.dtype)
        return out
    return t


contract = einsum


@register("einsum_path")
def einsum_path(pattern: str, *operands, optimize=True):
    """The planned pairs, and a description with multiply-adds and the largest intermediate. Only shapes are read."""
    inputs, output = planner.parse(pattern, [np.shape(x) if not hasattr(x, "shape") else x.shape for x in operands])
    sizes = {c: n for labels, x in zip(inputs, operands, strict=True) for c, n in zip(labels, x.shape, strict=True)}
    steps = planner.path(inputs, output, sizes)
    work, largest = planner.total_cost(inputs, output, sizes, steps)
    return ["einsum_path", *steps], f"multiply-adds: {work}\nlargest intermediate: {largest}"


@register("dot")
def dot(a, b) -> Tensor:
    spark = session(a, b)
    a, b = as_tensor(a, spark), as_tensor(b, spark)
    if not a.ndim or not b.ndim:
        return np.multiply(a, b)
    return tensordot(a, b, (a.ndim - 1, max(0, b.ndim - 2)))


@register("inner")
def inner(a, b) -> Tensor:
    spark = session(a, b)
    a, b = as_tensor(a, spark), as_tensor(b, spark)
    return np.multiply(a, b) if not a.ndim or not b.ndim else tensordot(a, b, (a.ndim - 1, b.ndim - 1))


@register("vdot")
def vdot(a, b) -> Tensor:
    spark = session(a, b)
    a, b = as_tensor(a, spark), as_tensor(b, spark)
    return tensordot(reshape(np.conjugate(a), -1), reshape(b, -1), 1)


@register("outer", "linalg.outer")
def outer(a, b) -> Tensor:
    spark = session(a, b)
    return tensordot(reshape(as_tensor(a, spark), -1), reshape(as_tensor(b, spark), -1), 0)


@register("matmul", "linalg.matmul")
def matmul(a, b) -> Tensor:
    """Leading dimensions are a batch and broadcast; batch labels are join keys that stay in the grouping."""
    spark = session(a, b)
    a, b = as_tensor(a, spark), as_tensor(b, spark)
    if not a.ndim or not b.ndim:
        raise ValueError("matmul: operands need at least one dimension")
    left, right = expand_dims(a, 0) if a.ndim == 1 else a, expand_dims(b, 1) if b.ndim == 1 else b
    out = einsum("...ij,...jk->...ik", left, right)
    return squeeze(out, [out.ndim - 2 + i for i, t in enumerate((a, b)) if t.ndim == 1]) if 1 in (a.ndim, b.ndim) else out


@register("vecdot", "linalg.vecdot")
def vecdot(a, b, axis: int = -1) -> Tensor:
    return einsum("...i,...i->...", np.conjugate(as_tensor(a, session(a, b))), b)


def matvec(a, b) -> Tensor:
    return einsum("...ij,...j->...i", a, b)


def vecmat(a, b) -> Tensor:
    return einsum("...i,...ij->...j", np.conjugate(as_tensor(a, session(a, b))), b)


@register("linalg.multi_dot")
def multi_dot(arrays: Sequence) -> Tensor:
    spark = session(arrays)
    tensors = [as_tensor(x, spark) for x in arrays]
    letters = string.ascii_letters
    terms, at = [], 0
    for k, t in enumerate(tensors):
        if t.ndim == 1 and k == 0:
            terms.append(letters[0])
        elif t.ndim == 1:
            terms.append(letters[at])
        else:
            terms.append(letters[at] + letters[at + 1])
            at += 1
    output = (terms[0][0] if tensors[0].ndim == 2 else "") + (terms[-1][-1] if tensors[-1].ndim == 2 else "")
    return einsum(",".join(terms) + "->" + output, *tensors)


@register("kron")
def kron(a, b) -> Tensor:
    spark = session(a, b)
    a, b = as_tensor(a, spark), as_tensor(b, spark)
    while a.ndim < b.ndim:
        a = expand_dims(a, 0)
    while b.ndim < a.ndim:
        b = expand_dims(b, 0)
    n = a.ndim
    both = tensordot(a, b, 0)
    return both.select([F.col(f"d{i}") * b.shape[i] + F.col(f"d{n + i}") for i in range(n)], [x * y for x, y in zip(a.shape, b.shape, strict=True)])


@register("trace", "linalg.trace")
def trace(a: Tensor, offset: int = 0, axis1: int = 0, axis2: int = 1) -> Tensor:
    i, j = normal_axis(axis1, a.ndim), normal_axis(axis2, a.ndim)
    keep = [k for k in range(a.ndim) if k not in (i, j)]
    cells = a.df.where(F.col(f"d{j}") == F.col(f"d{i}") + offset)
    from .reduction import sum_

    rest = Tensor(cells.select(*(F.col(f"d{k}").alias(f"d{p}") for p, k in enumerate(keep)), F.col(f"d{i}").alias(f"d{len(keep)}"), *a.values), Meta((*(a.shape[k] for k in keep), a.shape[i]), a.dtype))
    return sum_(rest, len(keep))


@register("linalg.matrix_power")
def matrix_power(a: Tensor, n: int) -> Tensor:
    """Repeated squaring."""
    from ..sources.create import identity
    from .linalg import inv

    if n < 0:
        a, n = inv(a), -n
    out = None
    while n:
        if n & 1:
            out = a if out is None else matmul(out, a)
        n >>= 1
        if n:
            a = matmul(a, a)
    return identity(a.shape[0], a.dtype, a.spark) if out is None else out
