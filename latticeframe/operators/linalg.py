"""Linear algebra: tall matrices by TSQR over row blocks, small ones by NumPy behind a size check."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..plans.meta import Meta
from .contract import matmul, tensordot
from .coords import reshape, transpose
from .reduction import sum_
from .tensor import Tensor, as_tensor, register, session

#: Most elements of a matrix that is brought to one place.
SMALL = 1 << 24
#: Row blocks whose R factors are stacked in one step.
FAN_IN = 32
ROWS = 1 << 14


def small(a: Tensor) -> np.ndarray:
    """A matrix on the driver, if its size allows."""
    if a.size > SMALL:
        raise ValueError(f"a matrix of {a.size} elements is too large for a dense solver (at most {SMALL})")
    return a.to_numpy()


def _back(a: Tensor, value) -> Tensor:
    return as_tensor(np.asarray(value), a.spark)


def _local(name: str, f, square: bool = False):
    """A function of small matrices; leading dimensions are a batch, as in NumPy."""
    def run(a, *args, **kwargs):
        spark = session(a, *args)
        a = as_tensor(a, spark)
        if square and a.shape[-1] != a.shape[-2]:
            raise np.linalg.LinAlgError("Last 2 dimensions of the array must be square")
        args = [small(x) if isinstance(x, Tensor) else x for x in args]
        out = f(small(a), *args, **kwargs)
        return tuple(_back(a, x) for x in out) if isinstance(out, tuple) else _back(a, out)

    run.__name__ = name
    return register(f"linalg.{name}")(run)


cholesky = _local("cholesky", np.linalg.cholesky, True)
eig = _local("eig", lambda a: tuple(np.linalg.eig(a)), True)
eigh = _local("eigh", lambda a, UPLO="L": tuple(np.linalg.eigh(a, UPLO)), True)  # noqa: N803
eigvals = _local("eigvals", np.linalg.eigvals, True)
eigvalsh = _local("eigvalsh", np.linalg.eigvalsh, True)
det = _local("det", np.linalg.det, True)
slogdet = _local("slogdet", lambda a: tuple(np.linalg.slogdet(a)), True)
solve = _local("solve", np.linalg.solve, True)
tensorsolve = _local("tensorsolve", np.linalg.tensorsolve)
inv = _local("inv", np.linalg.inv, True)
tensorinv = _local("tensorinv", np.linalg.tensorinv)


def _row_blocks(a: Tensor, rows: int):
    """A matrix as rows of arrays: blk, d0, row (dense, n long; re and im one after the other)."""
    n = a.shape[1]
    names = a.values
    packed = F.collect_list(F.struct("d1", *names))
    df = a.df.groupBy("d0").agg(packed.alias("cells"))

    def fill(frames):
        for pdf in frames:
            out = []
            for cells in pdf["cells"]:
                row = np.zeros(n * len(names))
                for k, name in enumerate(names):
                    row[np.fromiter((c["d1"] for c in cells), np.int64, len(cells)) + k * n] = np.fromiter((c[name] for c in cells), float, len(cells))
                out.append(row)
            yield pd.DataFrame({"blk": pdf["d0"] // rows, "d0": pdf["d0"], "row": out})

    return df.mapInPandas(fill, "blk long, d0 long, row array<double>")


def _as_complex(row: np.ndarray, n: int, is_complex: bool) -> np.ndarray:
    return row[..., :n] + 1j * row[..., n:] if is_complex else row


def tsqr(a: Tensor, rows: int | None = None) -> tuple:
    """Local QR factors of row blocks and the n x n factor R of the whole, reduced FAN_IN blocks at a time.

    Returns the DataFrame of rows, R, and the rows a block has. R's diagonal is made real and not negative.
    """
    m, n = a.shape
    is_complex = a.meta.is_complex
    rows = rows or max(n, ROWS)
    blocks = _row_blocks(a, rows)
    kind = "blk long, d0 long, row array<double>"

    def factor(pdf: pd.DataFrame) -> pd.DataFrame:
        stacked = _as_complex(np.stack(pdf["row"].to_list()), n, is_complex)
        r = np.linalg.qr(stacked, mode="r")
        flat = np.concatenate((r.real, r.imag), axis=1) if is_complex else r
        return pd.DataFrame({"blk": int(pdf["blk"].iloc[0]), "d0": np.arange(len(r), dtype=np.int64), "row": list(flat)})

    level, count = blocks, -(-m // rows)
    level = level.groupBy("blk").applyInPandas(factor, kind)
    while count > 1:
        level = level.withColumn("blk", F.expr(f"blk div {FAN_IN}")).groupBy("blk").applyInPandas(factor, kind)
        count = -(-count // FAN_IN)
    if n * n > SMALL:
        raise ValueError("TSQR needs few columns")
    r = np.zeros((min(m, n), n), a.dtype if a.dtype.kind in "fc" else float)
    for row in level.select("d0", "row").collect():  # n rows at most
        r[row[0]] = _as_complex(np.asarray(row[1]), n, is_complex)
    sign = np.diagonal(r)
    sign = np.where(sign == 0, 1, sign / np.where(sign == 0, 1, np.abs(sign))).conj()
    return blocks, sign[:, None] * r, rows


def _apply_right(blocks, a: Tensor, right: np.ndarray, m: int) -> Tensor:
    """Rows times a small matrix."""
    n, is_complex, k = a.shape[1], a.meta.is_complex, right.shape[1]
    meta = Meta((m, k), np.result_type(a.dtype, right.dtype, np.float32) if a.dtype.kind in "fc" else np.float64)

    def times(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            out = _as_complex(np.stack(pdf["row"].to_list()), n, is_complex) @ right
            d0, d1 = np.repeat(pdf["d0"].to_numpy(), k), np.tile(np.arange(k, dtype=np.int64), len(pdf))
            values = {"re": out.real.ravel(), "im": out.imag.ravel()} if meta.is_complex else {"v": out.ravel()}
            yield pd.DataFrame({"d0": d0, "d1": d1} | values)

    return Tensor(blocks.mapInPandas(times, "d0 long, d1 long, " + ("re double, im double" if meta.is_complex else "v double")), meta)


def _orthogonal(a: Tensor, blocks, r: np.ndarray) -> tuple[Tensor, np.ndarray]:
    """Q = A R^-1, made orthogonal to machine accuracy by a second pass; needs full column rank."""
    q = _apply_right(blocks, a, np.linalg.inv(r), a.shape[0])
    blocks2, r2, _ = tsqr(q)
    return _apply_right(blocks2, q, np.linalg.inv(r2), a.shape[0]), r2 @ r


def full_rank(r: np.ndarray) -> bool:
    if r.shape[0] < r.shape[1]:
        return False
    s = np.linalg.svd(r, compute_uv=False)
    return bool(len(s)) and s[-1] > s[0] * 1e-8


@register("linalg.qr")
def qr(a: Tensor, mode: str = "reduced"):
    """reduced, complete, r or raw. Tall matrices of full rank by TSQR (R's diagonal is not negative); others, and the
    modes complete and raw, in one place if they are small. Leading dimensions are a batch."""
    if mode not in ("reduced", "complete", "r", "raw"):
        raise ValueError(f"unrecognized mode {mode!r}")
    if a.ndim < 2:
        raise np.linalg.LinAlgError("at least two dimensions are needed")
    m, n = a.shape[-2:]
    if a.ndim == 2 and m >= n and mode in ("reduced", "r") and n:
        blocks, r, _ = tsqr(a)
        if mode == "r":
            return _back(a, r)
        if full_rank(r):
            q, r = _orthogonal(a, blocks, r)
            return q, _back(a, r)
    out = np.linalg.qr(small(a), mode)
    return _back(a, out) if mode == "r" else tuple(_back(a, x) for x in out)


@register("linalg.svd")
def svd(a: Tensor, full_matrices: bool = True, compute_uv: bool = True, hermitian: bool = False):
    """Tall matrices: the SVD of R from TSQR, U = Q U_R. Wide ones through their transpose. Leading dimensions are a
    batch. Full matrices only where the matrix is small."""
    m, n = a.shape[-2:]
    if a.ndim == 2 and m < n and not full_matrices:
        if not compute_uv:
            return svd(transpose(a), False, False)
        u, s, vh = svd(transpose(a), False)
        return transpose(vh), s, transpose(u)
    if a.ndim == 2 and m >= n and n and (not compute_uv or not full_matrices or m == n and a.size > SMALL):
        blocks, r, _ = tsqr(a)
        if not compute_uv:
            return _back(a, np.linalg.svd(r, compute_uv=False))
        if full_rank(r):
            q, r = _orthogonal(a, blocks, r)
            u, s, vh = np.linalg.svd(r, full_matrices=False)
            return matmul(q, _back(a, u)), _back(a, s), _back(a, vh)
    out = np.linalg.svd(small(a), full_matrices, compute_uv, hermitian)
    return tuple(_back(a, x) for x in out) if compute_uv else _back(a, out)


@register("linalg.svdvals")
def svdvals(a: Tensor) -> Tensor:
    return svd(a, False, False)


def svd_matrix(a: Tensor) -> tuple[Tensor, Tensor]:
    """(U diag(s), Vh)."""
    u, s, vh = svd(a, False)
    return np.multiply(u, s), vh


def schmidt(a: Tensor, axes_v, chi: int = 5) -> tuple[Tensor, Tensor, Tensor]:
    """Split the dimensions into axes_v and the rest, and keep the chi largest singular triplets: (U, s, V)."""
    axes_v = [x % a.ndim for x in (axes_v if not np.isscalar(axes_v) else [axes_v])]
    rest = [i for i in range(a.ndim) if i not in axes_v]
    rows, cols = int(np.prod([a.shape[i] for i in rest])), int(np.prod([a.shape[i] for i in axes_v]))
    u, s, vh = svd(reshape(transpose(a, [*rest, *axes_v]), (rows, cols)), full_matrices=False)
    k = min(chi, s.shape[0])
    return reshape(u[:, :k], (*(a.shape[i] for i in rest), k)), s[:k], reshape(vh[:k, :], (k, *(a.shape[i] for i in axes_v)))


@register("linalg.norm")
def norm(a: Tensor, ord=None, axis=None, keepdims: bool = False) -> Tensor:  # noqa: A002
    """Frobenius or 2-norm by default; 1, inf, -inf, 'nuc' and 2 of matrices; any p of vectors."""
    size = np.absolute(a)
    if ord is None or ord == "fro" or ord == 2 and (a.ndim == 1 or np.isscalar(axis)):
        return np.sqrt(sum_(np.square(size), axis, keepdims=keepdims))
    if a.ndim == 1 or np.isscalar(axis):
        from .reduction import ufunc_reduce

        if ord == np.inf:
            return ufunc_reduce(np.maximum, size, axis, keepdims)
        if ord == -np.inf:
            return ufunc_reduce(np.minimum, size, axis, keepdims)
        if ord == 0:
            return sum_((size != 0).astype(float), axis, keepdims=keepdims)
        return sum_(size**float(ord), axis, keepdims=keepdims) ** (1.0 / ord)
    from .reduction import ufunc_reduce

    if ord in (1, -1):
        return ufunc_reduce(np.maximum if ord == 1 else np.minimum, sum_(size, 0), None)
    if ord in (np.inf, -np.inf):
        return ufunc_reduce(np.maximum if ord == np.inf else np.minimum, sum_(size, 1), None)
    s = svdvals(a)
    return sum_(s) if ord == "nuc" else ufunc_reduce(np.maximum if ord == 2 else np.minimum, s, None)


@register("linalg.cond")
def cond(a: Tensor, p=None) -> Tensor:
    if p not in (None, 2):
        return _back(a, np.linalg.cond(small(a), p))
    s = svdvals(a).to_numpy()
    return _back(a, s[0] / s[-1] if s[-1] else np.inf)


@register("linalg.matrix_rank")
def matrix_rank(a: Tensor, tol=None) -> Tensor:
    s = svdvals(a).to_numpy()
    limit = s.max(initial=0) * max(a.shape) * np.finfo(float).eps if tol is None else tol
    return _back(a, int((s > limit).sum()))


@register("linalg.lstsq")
def lstsq(a: Tensor, b, rcond=None):
    """Tall full-rank systems through TSQR: x = R^-1 (Q^T b)."""
    b = as_tensor(b, a.spark)
    m, n = a.shape
    if m >= n:
        blocks, r, _ = tsqr(a)
        if full_rank(r):
            q, r = _orthogonal(a, blocks, r)
            qb = small(tensordot(np.conjugate(q), b, (0, 0)))
            x = _back(a, np.linalg.solve(r, qb))
            gap = tensordot(a, x, 1) - b
            residual = sum_(np.square(np.absolute(gap)), 0)
            return x, residual if b.ndim > 1 else reshape(residual, 1), n, _back(a, np.linalg.svd(r, compute_uv=False))
    x, residual, rank, s = np.linalg.lstsq(small(a), small(b), rcond)
    return _back(a, x), _back(a, residual), int(rank), _back(a, s)


@register("linalg.pinv")
def pinv(a: Tensor, rcond: float = 1e-15) -> Tensor:
    m, n = a.shape
    if m >= n:
        blocks, r, _ = tsqr(a)
        if full_rank(r):
            q, r = _orthogonal(a, blocks, r)
            return matmul(_back(a, np.linalg.inv(r)), transpose(np.conjugate(q)))
    return _back(a, np.linalg.pinv(small(a), rcond))
