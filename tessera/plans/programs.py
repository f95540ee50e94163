"""Whole programs over tensors: option pricing, k-means, cosine transform."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernel import kernel
from ..operators import adverbs
from ..operators.tensor import Tensor


@kernel
def cnd(x):
    """Cumulative normal distribution, by a polynomial of degree five."""
    size = abs(x)
    k = 1.0 / (1.0 + 0.2316419 * size)
    poly = k * (0.31938153 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    w = 1.0 - math.exp(-size * size / 2.0) / math.sqrt(2.0 * math.pi) * poly
    if x < 0:
        return 1.0 - w
    return w


@kernel
def black_scholes(call, spot, strike, years, rate, volatility):
    """The price of a European option, a call or a put."""
    spread = volatility * math.sqrt(years)
    d1 = (math.log(spot / strike) + (rate + volatility * volatility / 2.0) * years) / spread
    d2 = d1 - spread
    discounted = strike * math.exp(-rate * years)
    if call:
        price = spot * cnd(d1) - discounted * cnd(d2)
    else:
        price = discounted * cnd(-d2) - spot * cnd(-d1)
    return price


@kernel
def sqdist(x, y):
    d = x - y
    return sum(d * d)


@kernel
def inner(x, y):
    return sum(x * y)


def norm(x: Tensor) -> Tensor:
    squares = adverbs.map(lambda v: v * v, x)
    total = adverbs.reduce(lambda a, b: a + b, squares)
    return total.with_column(F.sqrt(total.column))


# -- k-means

#: Centroids go into the plan as literals: at most so many numbers.
MAX_CENTROID_CELLS = 1 << 16


def nearest(points: Tensor, centroids: np.ndarray) -> Tensor:
    """The number of each row's nearest centroid, the first of equals."""
    if centroids.size > MAX_CENTROID_CELLS:
        raise ValueError("too many centroids for literals")
    table = F.lit([[float(v) for v in c] for c in centroids])
    x = F.transform(points.column, lambda v: v.cast("double"))
    far = F.transform(table, lambda c: F.aggregate(F.zip_with(x, c, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda a, d: a + d))
    return points.with_column((F.array_position(far, F.array_min(far)) - 1).cast("int"), 0)


def centroid_sums(points: Tensor, labels: Tensor, width: int) -> DataFrame:
    """cluster, n and the mean of each coordinate (m0, m1 ...): one aggregation, with partial sums."""
    frame = points.frame.select(labels.column.alias("cluster"), points.column.alias("v"))
    means = [F.avg(F.get(F.col("v"), F.lit(i)).cast("double")).alias(f"m{i}") for i in range(width)]
    return frame.groupBy("cluster").agg(F.count("*").alias("n"), *means)


#: Numbers that the sums of a round bring to the driver at most, and tasks of a round.
MAX_SUM_CELLS, MAX_ROUND_TASKS = 1 << 22, 256

_PACKED = pa.schema([("n", pa.int32()), ("data", pa.binary())])
_SUMS = pa.schema([("part", pa.int32()), ("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.float64()))])


def _pack(kind: str):
    """Points of a batch as bytes in one row, which later passes read without taking elements apart."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                data = np.asarray(batch.column(0).flatten()).astype(kind).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int32()), pa.array([data], pa.binary())], schema=_PACKED)

    return run


def nearest_rows(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The number of each row's nearest centroid by the sum of squared differences, the first of equals.

    A matrix product decides where it is sure to; its error is far below ``slack``.
    """
    at = np.arange(len(x))
    with np.errstate(all="ignore"):
        size = (centroids**2).sum(axis=1)
        far = size - 2 * (x @ centroids.T)
        near = far.argmin(axis=1)
        best = far[at, near]
        far[at, near] = np.inf
        slack = 1e-9 * ((x**2).sum(axis=1) + size.max())
        unsure = np.flatnonzero(~(far.min(axis=1) - best > slack))
        if len(unsure):
            near[unsure] = np.stack([((x[unsure] - c) ** 2).sum(axis=1) for c in centroids], axis=1).argmin(axis=1)
    return near


def _cluster_totals(centroids: np.ndarray, kind: str):
    """Of a partition the number of rows nearest to each centroid, and their sum."""

    def run(batches):
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape)
        for batch in batches:
            for rows, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(data.as_buffer(), kind).reshape(rows, -1).astype(float)
                near = nearest_rows(x, centroids)
                here = np.bincount(near, minlength=len(n))
                at = np.flatnonzero(here)
                total[at] += np.add.reduceat(x[np.argsort(near, kind="stable")], (np.cumsum(here) - here)[at], axis=0)
                n += here
        at = np.flatnonzero(n)
        part = np.full(len(at), TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(at, pa.int32()), pa.array(n[at]), pa.array(list(total[at]), pa.list_(pa.float64()))], schema=_SUMS)

    return run


def kmeans(points: Tensor, k: int, rounds: int = 1000, start: np.ndarray | None = None) -> tuple[np.ndarray, Tensor, int]:
    """Centroids, labels and rounds run. Starts from the first ``k`` rows; an empty cluster keeps its centroid.

    Runs until no centroid moves, and raises if that takes more than ``rounds``.
    The points are read once and kept by the executors, packed; a round is one
    stage without a shuffle, whose sums, a vector a cluster and task, come to the driver.
    """
    if points.inner != 1:
        points = points.rows()
    if start is None:
        first = points.frame.where(F.col(points.index[0]) < k).select(F.col(points.index[0]).alias("i"), points.column.alias("v")).collect()
        start = np.array([r["v"] for r in sorted(first, key=lambda r: r["i"])], float)
    centroids = np.array(start, float)
    kind = np.dtype(points.dtype.numpy).str
    tasks = max(1, min(MAX_ROUND_TASKS, MAX_SUM_CELLS // max(1, centroids.size)))
    held = points.frame.select(points.column.alias("v")).coalesce(tasks).mapInArrow(_pack(kind), "n int, data binary").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for done in range(1, rounds + 1):
            parts = held.mapInArrow(_cluster_totals(centroids, kind), "part int, cluster int, n long, total array<double>").collect()
            n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape)
            for r in sorted(parts, key=lambda r: r["part"]):  # sums of doubles depend on their order, and must be the same in each round
                n[r["cluster"]] += r["n"]
                total[r["cluster"]] += r["total"]
            moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)
            if np.array_equal(moved, centroids):
                return centroids, nearest(points, centroids), done
            centroids = moved
    finally:
        held.unpersist()
    raise RuntimeError(f"centroids still move after {rounds} rounds")


# -- cosine transform


def dct_basis(n: int = 8) -> np.ndarray:
    """Row u * n + v: what the coefficient (u, v) multiplies the n by n samples, row by row, with."""
    at = np.arange(n)
    one = np.cos((2 * at[None] + 1) * at[:, None] * np.pi / (2 * n)) * np.where(at == 0, np.sqrt(1 / n), np.sqrt(2 / n))[:, None]
    return np.kron(one, one)


def linear(x: Tensor, matrix: np.ndarray) -> Tensor:
    """Each row of ``x`` times the transpose of a small matrix: batches of rows are multiplied in numpy, nothing is shuffled."""
    if matrix.size > MAX_CENTROID_CELLS:
        raise ValueError("the matrix goes to every task, so it must be small")
    weights = np.array(matrix, float).T

    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(rows.to_numpy()).astype(float) @ weights) if len(rows) else [], dtype=object)

    run.__annotations__ = {"rows": pd.Series, "return": pd.Series}
    return x.with_column(F.pandas_udf(run, "array<double>")(x.column), 1)


def dct_blocks(blocks: Tensor, n: int = 8) -> Tensor:
    """The two-dimensional cosine transform of rows that are n by n blocks."""
    return linear(blocks, dct_basis(n))


@kernel
def to_ycc(red, green, blue):
    """Luminance and the two colour differences; the coefficients are fixed values of the JPEG colour space."""
    light = 0.299 * red + 0.587 * green + 0.114 * blue
    blueness = 128 - 0.168736 * red - 0.331264 * green + 0.5 * blue
    redness = 128 + 0.5 * red - 0.418688 * green - 0.081312 * blue
    return light, blueness, redness


@kernel
def to_rgb(light, blueness, redness):
    """What ``to_ycc`` had; the coefficients are fixed values of the JPEG colour space."""
    red = light + 1.402 * (redness - 128)
    green = light - 0.34414 * (blueness - 128) - 0.71414 * (redness - 128)
    blue = light + 1.772 * (blueness - 128)
    return red, green, blue
