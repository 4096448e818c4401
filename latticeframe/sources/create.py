"""Constructors. Fills and random values are generated in parallel, never on the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tensor import Tensor, grid, register, session, sql_type
from ..plans.meta import Meta


def _shape(shape) -> tuple[int, ...]:
    return (int(shape),) if np.isscalar(shape) else tuple(int(n) for n in shape)


def array(value, dtype=None, spark: SparkSession | None = None) -> Tensor:
    """A tensor from anything NumPy can read (arrays, scalars, nested lists); cells equal to zero are not stored."""
    if isinstance(value, Tensor):
        return value.copy() if dtype is None else value.astype(dtype)
    value, spark = np.asarray(value, dtype=dtype), spark or session()
    meta = Meta(value.shape, value.dtype)
    at = np.nonzero(value) if value.ndim else ((np.zeros(1, np.int64),) if value else (np.zeros(0, np.int64),))
    cells = value[at] if value.ndim else value.reshape(1)[at]
    data = {f"d{i}": x for i, x in enumerate(at)} if value.ndim else {}
    data |= {"re": cells.real.astype(float), "im": cells.imag.astype(float)} if meta.is_complex else {"v": cells.astype({"u": np.int64, "i": np.int64, "f": np.float64}.get(value.dtype.kind, value.dtype))}
    kinds = ", ".join([f"d{i} long" for i in range(value.ndim)] + ([f"{c} double" for c in ("re", "im")] if meta.is_complex else [f"v {sql_type(value.dtype)}"]))
    frame = pd.DataFrame(data)
    return Tensor(spark.createDataFrame(frame if len(frame) else [], kinds), meta)


def full(shape, fill_value, dtype=None, order: str = "C", blockshape=None, spark: SparkSession | None = None) -> Tensor:
    """A constant tensor; zero is an empty table. blockshape and order say how blocks would be laid out and change no value."""
    shape, spark = _shape(shape), spark or session()
    meta = Meta(shape, np.dtype(dtype or np.asarray(fill_value).dtype))
    value = np.asarray(fill_value).astype(meta.dtype)
    kind = sql_type(meta.dtype)
    parts = [("re", value.real), ("im", value.imag)] if meta.is_complex else [("v", value)]
    cells = grid(spark, shape)
    if not value:
        cells = cells.limit(0)
    return Tensor(cells.select(*cells.columns, *(F.lit(x.item()).cast(kind).alias(n) for n, x in parts)), meta)


def zeros(shape, dtype=np.float64, order: str = "C", blockshape=None, spark=None) -> Tensor:
    return full(shape, 0, dtype or np.float64, order, blockshape, spark)


def ones(shape, dtype=np.float64, order: str = "C", blockshape=None, spark=None) -> Tensor:
    return full(shape, 1, dtype or np.float64, order, blockshape, spark)


empty = zeros


def rand(shape, blockshape=None, seed: int = 0, spark: SparkSession | None = None) -> Tensor:
    """Uniform on [0, 1): the first 52 bits of the MD5 of seed and coordinate, so recomputed partitions, and any other
    engine, give the same values."""
    shape, spark = _shape(shape), spark or session()
    cells = grid(spark, shape)
    digest = F.md5(F.concat_ws(",", F.lit(str(seed)), *(F.col(c).cast("string") for c in cells.columns)))
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return Tensor(cells.withColumn("v", u), Meta(shape, np.float64))


def identity(n: int, dtype=np.float64, spark: SparkSession | None = None) -> Tensor:
    spark = spark or session()
    one = full((n,), 1, dtype, spark=spark)
    return Tensor(one.df.select(F.col("d0"), F.col("d0").alias("d1"), *one.values), Meta((n, n), dtype))


def identity_block(blockshape: Sequence[int], n: int, i: int, j: int, dtype=np.float64, spark=None) -> Tensor:
    """Block (i, j) of the identity of n rows cut into blocks of blockshape."""
    a, b = blockshape
    rows, cols = min(a, n - i * a), min(b, n - j * b)
    eye = identity(n, dtype, spark)
    df = eye.df.where(f"d0 >= {i * a} and d0 < {i * a + rows} and d1 >= {j * b} and d1 < {j * b + cols}")
    return Tensor(df, eye.meta).select([F.col("d0") - i * a, F.col("d1") - j * b], (rows, cols))


def _like(a, fill, dtype, shape):
    shape = a.shape if shape is None else _shape(shape)
    return full(shape, fill, dtype or a.dtype, spark=session(a))


@register("zeros_like")
def zeros_like(a, dtype=None, order="K", subok=True, shape=None):
    out = _like(a, 0, dtype, shape)
    return out if subok else out.to_numpy()


@register("ones_like")
def ones_like(a, dtype=None, order="K", subok=True, shape=None):
    out = _like(a, 1, dtype, shape)
    return out if subok else out.to_numpy()


@register("full_like")
def full_like(a, fill_value, dtype=None, order="K", subok=True, shape=None):
    out = _like(a, fill_value, dtype, shape)
    return out if subok else out.to_numpy()


@register("empty_like")
def empty_like(a, dtype=None, order="K", subok=True, shape=None):
    return zeros_like(a, dtype, order, subok, shape)


def from_table(df: DataFrame, dims: Sequence[str], value: str, shape: Sequence[int], dtype=np.float64) -> Tensor:
    """A tensor from rows: dims are dense 0-based coordinates, values at equal coordinates are summed."""
    cols = [F.col(c).cast("long").alias(f"d{i}") for i, c in enumerate(dims)]
    cells = df.select(*cols, F.col(value).cast(sql_type(dtype)).alias("v")).groupBy(*(f"d{i}" for i in range(len(dims)))).agg(F.sum("v").alias("v"))
    return Tensor(cells, Meta(tuple(shape), dtype))


def from_vectors(df: DataFrame, key: str, vector: str, rows: int, width: int) -> Tensor:
    """A matrix from a column of arrays: one row per key, one column per position."""
    exploded = df.select(F.col(key).cast("long").alias("d0"), F.posexplode(vector).alias("p", "x"))
    return Tensor(exploded.select("d0", F.col("p").cast("long").alias("d1"), F.col("x").cast("double").alias("v")), Meta((rows, width), np.float64))


def read(path: str, spark: SparkSession | None = None) -> Tensor:
    """A tensor stored with Tensor.write; the one-row description is read at once."""
    spark = spark or session()
    shape, dtype = spark.read.parquet(f"{path}/meta").first()
    meta = Meta(tuple(shape), np.dtype(dtype))
    kinds = ", ".join([f"d{i} long" for i in range(meta.ndim)] + ([f"{c} double" for c in ("re", "im")] if meta.is_complex else [f"v {sql_type(meta.dtype)}"]))
    return Tensor(spark.read.schema(kinds).parquet(f"{path}/cells"), meta)


@register("to_numpy")
def to_numpy(a):
    """NumPy arrays and scalars pass through; tensors are brought to the driver."""
    return a.to_numpy() if hasattr(a, "to_numpy") else a


def dense_size(shape) -> int:
    return math.prod(_shape(shape))
