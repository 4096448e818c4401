"""What the driver knows of a tensor without touching its data, and shape arithmetic."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np


@dataclass(frozen=True)
class Meta:
    """Shape, dtype and layout. A missing coordinate of a coordinate table holds zero."""

    shape: tuple[int, ...]
    dtype: np.dtype
    blockshape: tuple[int, ...] | None = None

    def __post_init__(self):
        object.__setattr__(self, "shape", tuple(int(n) for n in self.shape))
        object.__setattr__(self, "dtype", np.dtype(self.dtype))
        if any(n < 0 for n in self.shape):
            raise ValueError("negative dimensions are not allowed")

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def itemsize(self) -> int:
        return self.dtype.itemsize

    @property
    def nbytes(self) -> int:
        return self.size * self.itemsize

    @property
    def is_complex(self) -> bool:
        return self.dtype.kind == "c"

    @property
    def grid(self) -> tuple[int, ...]:
        """Blocks along each dimension; blocks at the end may be smaller."""
        return tuple(-(-n // b) for n, b in zip(self.shape, self.blockshape or self.shape, strict=True)) if self.size else (0,) * self.ndim

    def with_(self, **changes) -> Meta:
        return replace(self, **changes)


def strides(shape: Sequence[int], order: str = "C") -> tuple[int, ...]:
    """How far the linear index moves with each coordinate."""
    if order not in ("C", "F"):
        raise ValueError("order must be 'C' or 'F'")
    out, step = [], 1
    for n in reversed(shape) if order == "C" else shape:
        out.append(step)
        step *= n
    return tuple(reversed(out)) if order == "C" else tuple(out)


def normal_axis(axis: int, ndim: int) -> int:
    if not -ndim <= axis < ndim:
        raise np.exceptions.AxisError(axis, ndim)
    return axis % ndim


def normal_axes(axis, ndim: int) -> tuple[int, ...]:
    """None means all axes."""
    if axis is None:
        return tuple(range(ndim))
    out = tuple(normal_axis(a, ndim) for a in ((axis,) if np.isscalar(axis) else axis))
    if not isunique(out):
        raise ValueError("repeated axis")
    return out


def contraction_axes(a: Sequence[int], b: Sequence[int], axes) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Axes of a tensordot: an integer count, or two (lists of) axes; negative ones count from the end."""
    if np.isscalar(axes):
        left, right = list(range(len(a) - axes, len(a))), list(range(axes))
    else:
        left, right = axes
        left, right = ([x] if np.isscalar(x) else list(x) for x in (left, right))
    left, right = tuple(normal_axis(x, len(a)) for x in left), tuple(normal_axis(x, len(b)) for x in right)
    if len(left) != len(right) or any(a[i] != b[j] for i, j in zip(left, right, strict=True)):
        raise ValueError("shape-mismatch for sum")
    if not (isunique(left) and isunique(right)):
        raise ValueError("repeated axis")
    return left, right


def isunique(items: Sequence) -> bool:
    return len(set(items)) == len(items)


def result_shape(a: Sequence[int], b: Sequence[int], axes) -> tuple[int, ...]:
    """Free dimensions of a, then those of b."""
    left, right = contraction_axes(a, b, axes)
    return tuple(n for i, n in enumerate(a) if i not in left) + tuple(n for i, n in enumerate(b) if i not in right)


def nest_level(nested) -> int:
    """Depth of nested lists."""
    return 1 + nest_level(nested[0]) if isinstance(nested, list | tuple) and len(nested) else int(isinstance(nested, list | tuple))


def measure_shape(nested) -> tuple[int, ...]:
    """Lengths of evenly nested lists."""
    if not isinstance(nested, list | tuple):
        return ()
    inner = {measure_shape(x) for x in nested}
    if len(inner) > 1:
        raise ValueError("lists are not nested evenly")
    return (len(nested), *next(iter(inner), ()))


def infer_shape(shape, size: int) -> tuple[int, ...]:
    """A reshape target with at most one -1."""
    shape = [int(shape)] if np.isscalar(shape) else [int(n) for n in shape]
    if shape.count(-1) > 1:
        raise ValueError("can only specify one unknown dimension")
    if -1 in shape:
        known = math.prod(n for n in shape if n != -1)
        if not known or size % known:
            raise ValueError(f"cannot reshape array of size {size} into {tuple(shape)}")
        shape[shape.index(-1)] = size // known
    if math.prod(shape) != size:
        raise ValueError(f"cannot reshape array of size {size} into {tuple(shape)}")
    return tuple(shape)
