"""Streaming over Arrow batches that are sorted by a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False)


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut so that no group is split, with the bounds of the groups in each; only the last group is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and all(column(held[-1], k)[-1] == column(batch, k)[0] for k in keys) and all(column(batch, k)[0] == column(batch, k)[-1] for k in keys):
            held.append(batch)
            continue
        joined = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0] if held else batch
        bounds = _bounds(joined, keys)
        if len(bounds) > 2:
            yield joined.slice(0, int(bounds[-2])), bounds[:-1]
        held = [joined.slice(int(bounds[-2]))]
    if held:
        joined = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield joined, _bounds(joined, keys)


def _bounds(batch: pa.RecordBatch, keys: tuple[str, ...]) -> np.ndarray:
    change = np.zeros(batch.num_rows - 1, bool)
    for k in keys:
        v = numbers(batch, k)
        change |= v[1:] != v[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1, [batch.num_rows]))


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j
