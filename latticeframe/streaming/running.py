"""A tensor that sums events as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_sum(events: DataFrame, dims: Sequence[str], value: str, time: str | None = None, window: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Cells (d0, ..., v) of a batch or streaming table of events, summed by coordinate.

    With time and window the cells are those of each tumbling window; the watermark `late` bounds the state, and later
    events are dropped. Without, a streaming query needs output mode update or complete and keeps all coordinates.
    """
    keys = [F.col(c).cast("long").alias(f"d{i}") for i, c in enumerate(dims)]
    if time:
        events = events.withWatermark(time, late) if events.isStreaming else events
        keys.insert(0, F.window(time, window).alias("window"))
    return events.groupBy(*keys).agg(F.sum(F.col(value).cast("double")).alias("v"))
