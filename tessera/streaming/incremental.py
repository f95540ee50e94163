"""Kernels over streams.

A map is a projection and works on a streaming frame as it is. A fold of a
known kind (sum, product, least, greatest, all, any) becomes a streaming
aggregate, by event-time windows if a column of times is named; folds that need
an order of elements have no streaming form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.adverbs import MONOIDS, monoid


def running_reduce(stream: DataFrame, f: Callable, value: Column, by: tuple[str, ...] = (), time: str | None = None, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Columns ``by`` (and the window) with the fold ``v`` of ``value`` so far; rows later than ``late`` are left out of windows."""
    name = monoid(f)
    if name is None:
        raise ValueError("only sums, products, extremes and logical folds run on streams")
    keys = [F.col(c) for c in by]
    if time is not None:
        stream = stream.withWatermark(time, late)
        keys.append(F.window(time, window).alias("window"))
    return stream.groupBy(*keys).agg(MONOIDS[name](value).alias("v"))
