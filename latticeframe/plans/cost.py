"""Cost formulas: multiply-adds and bytes, from shapes alone."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import SparkSession

from .meta import Meta, contraction_axes, result_shape


class flops:
    @staticmethod
    def tensordot(a, b, axes) -> int:
        left, _ = contraction_axes(a.shape, b.shape, axes)
        return math.prod(result_shape(a.shape, b.shape, axes)) * math.prod(a.shape[i] for i in left)

    @staticmethod
    def full(shape: Sequence[int]) -> int:
        return math.prod(shape)

    @staticmethod
    def reshape(a, *_) -> int:
        return 1

    @staticmethod
    def transpose(a, *_) -> int:
        return math.prod(a.shape)


class mem:
    @staticmethod
    def _bytes(a) -> int:
        return math.prod(a.shape) * np.dtype(a.dtype).itemsize

    @staticmethod
    def tensordot(a, b, axes) -> int:
        out = math.prod(result_shape(a.shape, b.shape, axes)) * np.result_type(a.dtype, b.dtype).itemsize
        return mem._bytes(a) + mem._bytes(b) + out

    @staticmethod
    def sequential(a: Sequence, b: Sequence, axes) -> int:
        out = math.prod(result_shape(a[0].shape, b[0].shape, axes)) * np.result_type(a[0].dtype, b[0].dtype).itemsize
        return sum(map(mem._bytes, [*a, *b])) + out

    @staticmethod
    def commutative(a, b, axes) -> int:
        return mem.tensordot(a, b, axes)

    @staticmethod
    def full(shape: Sequence[int], dtype) -> int:
        return math.prod(shape) * np.dtype(dtype).itemsize

    @staticmethod
    def reshape(a, *_) -> int:
        return mem._bytes(a)

    @staticmethod
    def transpose(a, *_) -> int:
        return 2 * mem._bytes(a)

    @staticmethod
    def qr(a, mode: str = "reduced") -> int:
        """Leading dimensions are a batch."""
        *batch, m, n = a.shape
        k, size = min(m, n), np.dtype(a.dtype).itemsize
        out = {"reduced": m * k + k * n, "complete": m * m + m * n, "r": k * n, "raw": m * n + k}[mode]
        return mem._bytes(a) + math.prod(batch) * out * size

    @staticmethod
    def einsum(pattern: str, *operands) -> int:
        from .planner import parse

        inputs, output = parse(pattern, [o.shape for o in operands])
        sizes = {c: n for labels, o in zip(inputs, operands, strict=True) for c, n in zip(labels, o.shape, strict=True)}
        out = math.prod(sizes[c] for c in output) * np.result_type(*(o.dtype for o in operands)).itemsize
        return sum(map(mem._bytes, operands)) + out


def core_count(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def node_count(spark: SparkSession) -> int:
    """Executors, or one in local mode."""
    return max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)


__all__ = ["Meta", "core_count", "flops", "mem", "node_count"]
