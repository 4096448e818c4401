"""Tensor: a lazy DataFrame of coordinates (d0, d1, ..., v) or (.., re, im), with its shape and dtype."""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Sequence
from functools import reduce
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.meta import Meta, strides

#: Cells that are made from one row at most, cells of a task, and tasks at most.
STRETCH, TASK_CELLS, MOST_TASKS = 1 << 14, 1 << 20, 1 << 12

#: NumPy function name -> implementation; operator modules register theirs.
FUNCTIONS: dict[str, Callable] = {}
UFUNC: dict[str, Callable] = {}


def register(*names: str):
    """Make a function reachable as np.<name>(tensor, ...) and latticeframe.<name>(...)."""
    def keep(f):
        for n in names:
            FUNCTIONS[n] = f
        return f
    return keep


REPO = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package where it is not installed."""
    env = spark.sparkContext.environment
    if REPO not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), REPO) if x)


def sql_type(dtype: np.dtype) -> str:
    kind = np.dtype(dtype).kind
    return {"b": "boolean", "i": "bigint", "u": "bigint", "f": "double", "M": "timestamp_ntz", "U": "string", "S": "binary", "O": "string"}[kind] if kind != "c" else "double"


class Tensor(np.lib.mixins.NDArrayOperatorsMixin):
    """An n-dimensional array held as rows. Building one, its shape, dtype and repr never run a job."""

    __array_priority__ = 100

    def __init__(self, df: DataFrame, meta: Meta, runs: DataFrame | None = None):
        """runs: the same cells, all of the shape, as stretches of equal values (first position __p in C order, length
        __n, value)."""
        self.df, self.meta, self.runs = df, meta, runs
        importable(df.sparkSession)

    def __setattr__(self, name: str, value) -> None:
        super().__setattr__(name, value)
        if name == "df":
            super().__setattr__("runs", None)

    # -- metadata
    shape = property(lambda self: self.meta.shape, lambda self, shape: FUNCTIONS["reshape"](self, shape, inplace=True))
    dtype = property(lambda self: self.meta.dtype)
    ndim = property(lambda self: self.meta.ndim)
    size = property(lambda self: self.meta.size)
    itemsize = property(lambda self: self.meta.itemsize)
    nbytes = property(lambda self: self.meta.nbytes)

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def dims(self) -> list[str]:
        return [f"d{i}" for i in range(self.ndim)]

    @property
    def values(self) -> list[str]:
        return ["re", "im"] if self.meta.is_complex else ["v"]

    def __repr__(self) -> str:
        return f"Tensor(shape={self.shape}, dtype={self.dtype})"

    __str__ = __repr__

    def __len__(self) -> int:
        if not self.ndim:
            raise TypeError("len() of unsized object")
        return self.shape[0]

    # -- sinks
    def to_numpy(self) -> np.ndarray:
        """Bring the tensor to the driver; its dense size must fit there."""
        out = np.zeros(self.shape, self.dtype)
        table = self.df.select(*self.dims, *self.values).toArrow()
        if table.num_rows:
            columns = [c.to_numpy() for c in table.columns]
            at = tuple(c.astype(np.int64) for c in columns[: self.ndim])
            value = columns[self.ndim] + 1j * columns[self.ndim + 1] if self.meta.is_complex else columns[self.ndim]
            out[at if self.ndim else ()] = value if self.ndim else value[0]
        return out

    collect = to_numpy

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        out = self.to_numpy()
        return out if dtype is None else out.astype(dtype)

    def item(self):
        return self.to_numpy().item()

    __float__ = lambda self: float(self.item())
    __int__ = lambda self: int(self.item())
    __complex__ = lambda self: complex(self.item())
    __bool__ = lambda self: bool(self.to_numpy())

    def persist(self) -> Tensor:
        self.df.persist()
        return self

    def unpersist(self) -> Tensor:
        self.df.unpersist()
        return self

    def checkpoint(self) -> Tensor:
        """Cut a long lineage; needs spark.checkpoint.dir."""
        return Tensor(self.df.checkpoint(), self.meta)

    def write(self, path: str) -> None:
        """Store as Parquet; the shape and dtype go into the column comments' place, a file of one row beside it."""
        self.df.select(*self.dims, *self.values).write.mode("overwrite").parquet(f"{path}/cells")
        self.spark.createDataFrame([(list(self.shape), self.dtype.str)], "shape array<long>, dtype string").write.mode("overwrite").parquet(f"{path}/meta")

    def copy(self) -> Tensor:
        return Tensor(self.df, self.meta)

    __copy__ = copy
    __deepcopy__ = lambda self, memo: self.copy()

    # -- NumPy protocols
    def __array_ufunc__(self, ufunc, method, *inputs, **kwargs):
        from . import elementwise

        return elementwise.apply(ufunc, method, *inputs, **kwargs)

    def __array_function__(self, func, types, args, kwargs):
        name = func.__name__ if "linalg" not in func.__module__ else f"linalg.{func.__name__}"
        f = FUNCTIONS.get(name) or FUNCTIONS.get(func.__name__)
        return NotImplemented if f is None else f(*args, **kwargs)

    # -- method forms
    def __getattr__(self, name: str):
        if not name.startswith("_") and name in METHODS:
            f = FUNCTIONS[name]
            return lambda *args, **kwargs: f(self, *args, **kwargs)
        raise AttributeError(name)

    @property
    def T(self) -> Tensor:  # noqa: N802
        return FUNCTIONS["transpose"](self)

    @property
    def real(self) -> Tensor:
        return Tensor(self.df.select(*self.dims, F.col("re").alias("v")), self.meta.with_(dtype=np.float64)) if self.meta.is_complex else self

    @property
    def imag(self) -> Tensor:
        return Tensor(self.df.select(*self.dims, (F.col("im") if self.meta.is_complex else F.lit(0.0)).alias("v")), self.meta.with_(dtype=np.float64))

    def transpose(self, *axes):
        return FUNCTIONS["transpose"](self, *axes)

    def reshape(self, *shape, order: str = "C"):
        return FUNCTIONS["reshape"](self, shape[0] if len(shape) == 1 else shape, order=order)

    def conj(self):
        return np.conjugate(self)

    def __getitem__(self, key):
        return FUNCTIONS["getitem"](self, key)

    def __setitem__(self, key, value) -> None:
        """Point this handle at a new table; other handles keep the old one."""
        new = FUNCTIONS["setitem"](self, key, value)
        self.df, self.meta = new.df, new.meta

    # -- building blocks for operators
    def select(self, coords: Sequence[Column], shape: Sequence[int], dtype=None) -> Tensor:
        """The same values at other coordinates."""
        cols = [c.cast("long").alias(f"d{i}") for i, c in enumerate(coords)]
        return Tensor(self.df.select(*cols, *self.values), Meta(tuple(shape), dtype or self.dtype))

    def map(self, values: Sequence[Column], dtype) -> Tensor:
        """Other values at the same coordinates."""
        meta = self.meta.with_(dtype=np.dtype(dtype))
        names = ["re", "im"] if meta.is_complex else ["v"]
        return Tensor(self.df.select(*self.dims, *(c.cast(sql_type(dtype)).alias(n) for c, n in zip(values, names, strict=True))), meta)

    def dense(self) -> Tensor:
        """Store every coordinate. Only stored cells and a mark for each stretch of positions are shuffled; the zeros
        behind them are made in place, as runs that functions of one tensor map before they become cells."""
        if not self.size or self.runs is not None:
            return self
        if not self.ndim:
            return Tensor(grid(self.spark, ()).join(self.df, how="left").select(*(F.coalesce(F.col(c), self.zero).alias(c) for c in self.values)), self.meta)
        cells = until(marked(self, STRETCH), STRETCH, self.size)
        own, after = F.col(self.values[0]).isNotNull(), F.col("__e") - F.col("__i")
        first = F.struct(F.col("__i").alias("__p"), F.when(own, F.lit(1).cast("long")).otherwise(after).alias("__n"), *(F.coalesce(F.col(c), self.zero).alias(c) for c in self.values))
        rest = F.struct((F.col("__i") + 1).alias("__p"), F.when(own, after - 1).otherwise(F.lit(0).cast("long")).alias("__n"), *(self.zero.alias(c) for c in self.values))
        return from_runs(cells.select(F.inline(F.array(first, rest))).where("__n > 0"), self.meta)

    @property
    def zero(self) -> Column:
        """What a cell that is not stored holds."""
        return (F.lit(False) if self.dtype.kind == "b" else F.lit(0)).cast(sql_type(self.dtype))

    def inside(self) -> DataFrame:
        """The stored cells that lie in the shape."""
        return self.df.where(reduce(lambda p, q: p & q, [(F.col(d) >= 0) & (F.col(d) < n) for d, n in zip(self.dims, self.shape, strict=True)], F.lit(True)))


def marked(t: Tensor, block: int) -> DataFrame:
    """Stored cells by position in C order (__i) and block of positions (__b), with a mark, whose values are NULL, at the
    start of every stretch of a block."""
    each = -(-block // STRETCH)
    place = " + ".join(f"{d} * {s}L" for d, s in zip(t.dims, strides(t.shape, "C"), strict=True))
    stored = t.inside().select(F.expr(place).alias("__i"), *(F.coalesce(F.col(c), t.zero).alias(c) for c in t.values)).withColumn("__b", F.expr(f"__i div {block}L"))
    marks = t.spark.range(-(-t.size // block) * each).select(F.expr(f"id div {each}L").alias("__b"), F.expr(f"(id % {each}L) * {STRETCH}L").alias("__o"))
    marks = marks.select("__b", (F.col("__b") * block + F.col("__o")).alias("__i"), "__o").where(f"__o < {block}L and __i < {t.size}L")
    both = stored.unionByName(marks.select("__i", *(F.lit(None).cast(sql_type(t.dtype)).alias(c) for c in t.values), "__b"))
    return both.repartition(max(1, min(MOST_TASKS, -(-t.size // block), -(-t.size // TASK_CELLS))), "__b")


def until(cells: DataFrame, block: int, size: int) -> DataFrame:
    """With the position of the next row (__e)."""
    value = next(c for c in cells.columns if not c.startswith("__"))
    w = Window.partitionBy("__b").orderBy("__i", F.col(value).isNotNull())
    return cells.withColumn("__e", F.coalesce(F.lead("__i").over(w), F.least((F.col("__b") + 1) * block, F.lit(size).cast("long"))))


def from_runs(runs: DataFrame, meta: Meta) -> Tensor:
    """Cells of the runs, made where the runs are."""
    values = ["re", "im"] if meta.is_complex else ["v"]
    cells = runs.select(F.explode(F.expr("sequence(__p, __p + __n - 1)")).alias("__i"), *values)
    return Tensor(cells.select(*(c.alias(f"d{i}") for i, c in enumerate(unravel(F.col("__i"), meta.shape))), *values), meta, runs)


METHODS = {"astype", "flatten", "ravel", "sum", "prod", "max", "min", "mean", "std", "var", "any", "all", "cumsum", "cumprod", "dot", "trace", "squeeze", "swapaxes", "count_nonzero", "argmax", "argmin"}


def unravel(index: Column, shape: Sequence[int], order: str = "C") -> list[Column]:
    """Coordinates of a linear index."""
    step = strides(shape, order)
    return [F.expr(f"({{i}} div {max(1, s)}) % {max(1, n)}".replace("{i}", "`__i`")) for s, n in zip(step, shape, strict=True)]


def grid(spark: SparkSession, shape: Sequence[int]) -> DataFrame:
    """All coordinates of a shape, generated in parallel."""
    cells = spark.range(math.prod(shape)).withColumnRenamed("id", "__i")
    return cells.select(*(c.cast("long").alias(f"d{i}") for i, c in enumerate(unravel(F.col("__i"), shape)))) if shape else cells.select()


def as_tensor(value, spark: SparkSession) -> Tensor:
    from ..sources.create import array

    return value if isinstance(value, Tensor) else array(np.asarray(value), spark=spark)


def session(*items) -> SparkSession:
    """The session of the first tensor among the arguments, or the active one."""
    for x in items:
        if isinstance(x, Tensor):
            return x.spark
        if isinstance(x, list | tuple):
            for y in x:
                if isinstance(y, Tensor):
                    return y.spark
    found = SparkSession.getActiveSession()
    if found is None:
        raise RuntimeError("no active Spark session")
    return found
