"""First-order array operators and views: indexing, gathering, masks, slices, transposition and the like.

Tensors are not changed in place; what stores an element returns a new tensor.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .. import types
from ..functions import ir
from .adverbs import SCAN_BLOCK, align, map_op
from .tensor import Tensor


def _vector(x: Tensor) -> Tensor:
    if x.rank != 1 or x.inner:
        raise ValueError("a vector with one row an element is wanted")
    x._positions()
    return x


def renumbered(x: Tensor) -> Tensor:
    """The elements of a vector with positions from 0 without gaps, in the order of their present positions.

    Counts of blocks of positions come first, so that no task numbers all rows.
    """
    x = _vector(x)
    frame = x.df().withColumn("__block", F.floor(F.col("i0") / SCAN_BLOCK))
    counts = frame.groupBy("__block").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    frame = frame.join(counts.select("__block", before.alias("__before")), "__block")
    here = F.row_number().over(Window.partitionBy("__block").orderBy("i0")) - 1
    return Tensor(frame.select((F.col("__before") + here).alias("i0"), "v"), ("i0",), F.col("v"))


def index(x: Tensor, at):
    """``x[at]``: numbers drop leading axes; slices, vectors of positions and masks select along the first."""
    if isinstance(at, tuple):
        for a in at:
            if not isinstance(a, (int, np.integer)):
                raise TypeError("several indices must be numbers")
            x = fix_dim(x, 0, int(a))
        return x
    if isinstance(at, (int, np.integer)):
        return fix_dim(x, 0, int(at))
    if isinstance(at, slice):
        return slice_(x, at.start or 0, at.stop, at.step or 1)
    if isinstance(at, Tensor):
        return mask(x, at) if at.dtype is types.BOOL else gather(x, at)
    raise TypeError(f"index {at!r}")


def fix_dim(x: Tensor, axis: int, at: int) -> Tensor:
    """One position of an axis, which goes. No such position: no elements."""
    if at < 0:
        at += x.shape[axis]
    if x.inner and axis == x.rank - 1:
        return x.with_column(F.get(x.column, F.lit(at)), 0)
    names = x._positions()
    keep = [c for k, c in enumerate(names) if k != axis]
    shape = None if x._shape is None else tuple(n for k, n in enumerate(x._shape) if k != axis)
    frame = x.frame.where(F.col(names[axis]) == at)
    return Tensor(frame, keep, x.column, x.inner, shape)


def gather(x: Tensor, positions: Tensor) -> Tensor:
    """``x[positions]``: rows of ``x`` in the order of the positions, which may repeat."""
    positions = _vector(positions)
    name = x._positions()[0]
    left = positions.frame.select(F.col(positions.index[0]).alias("i0"), positions.column.cast("long").alias("__at"))
    rest = [F.col(c).alias(f"i{k}") for k, c in enumerate(x.index[1:], 1)]
    right = x.frame.select(F.col(name).cast("long").alias("__at"), *rest, x.column.alias("v"))
    shape = None if x._shape is None or positions._shape is None else positions._shape + x._shape[1:]
    return Tensor(left.join(right, "__at"), [f"i{k}" for k in range(len(x.index))], F.col("v"), x.inner, shape)


def mask(x: Tensor, keep: Tensor) -> Tensor:
    """``x[keep]``: the elements where the mask is true, numbered anew."""
    x, keep = align([x, keep])
    return renumbered(Tensor(x.frame.where(keep.column), x.index, x.column))


def select_where(x: Tensor, keep: Tensor) -> Tensor:
    """The elements where the mask is true at their old positions, as aggregates need them."""
    x, keep = align([x, keep])
    return Tensor(x.frame.where(keep.column), x.index, x.column, x.inner)


def where(x: Tensor) -> Tensor:
    """The positions of the true elements, ascending."""
    x = _vector(x)
    position = F.col(x.index[0]).cast("int")
    return renumbered(Tensor(x.frame.where(x.column), x.index, position))


def find(x: Tensor, value) -> Tensor:
    """The first position that has ``value``; null if none has."""
    x = _vector(x)
    found = x.frame.where(x.column == F.lit(value)).agg(F.min(x.index[0]).cast("int").alias("v"))
    return Tensor(found, (), F.col("v"), 0, ())


def slice_(x: Tensor, start: int, stop: int | None, step: int = 1) -> Tensor:
    """``x[start:stop:step]`` along the first axis."""
    if step < 1:
        raise ValueError("steps must be positive")
    if stop is None or start < 0 or stop < 0:
        start, stop, step = slice(start, stop, step).indices(x.shape[0])
    name = x._positions()[0]
    at = F.col(name)
    frame = x.frame.where((at >= start) & (at < stop) & ((at - start) % step == 0))
    rest = [F.col(c).alias(f"i{k}") for k, c in enumerate(x.index[1:], 1)]
    frame = frame.select(((at - start) / step).cast("long").alias("i0"), *rest, x.column.alias("v"))
    return Tensor(frame, [f"i{k}" for k in range(len(x.index))], F.col("v"), x.inner)


def transpose(x: Tensor) -> Tensor:
    """The axes in reverse order."""
    if x.rank < 2:
        return x
    x = x.long()
    shape = None if x._shape is None else tuple(reversed(x._shape))
    return Tensor(x.frame, tuple(reversed(x._positions())), x.column, 0, shape)


def flatten(x: Tensor) -> Tensor:
    """All elements row by row."""
    if x.rank < 2:
        return x
    shape = x.shape
    x = x.long()
    at = F.lit(0).cast("long")
    for name, n in zip(x.index, shape):
        at = at * n + F.col(name)
    return Tensor(x.frame.select(at.alias("i0"), x.column.alias("v")), ("i0",), F.col("v"), 0, (int(np.prod(shape)),))


def copy(x: Tensor) -> Tensor:
    """Tensors don't change, so this is the same one."""
    return x


def set_index(x: Tensor, at: int | Sequence[int], value) -> Tensor:
    """``x`` with the element at a position (one number for each axis) replaced."""
    x = x.long()
    at = (at,) if isinstance(at, (int, np.integer)) else tuple(at)
    if len(at) != x.rank:
        raise ValueError("a position for each axis is wanted")
    here = None
    for name, a in zip(x._positions(), at):
        here = (F.col(name) == a) if here is None else here & (F.col(name) == a)
    return x.with_column(F.when(here, F.lit(value).cast(x.dtype.sql)).otherwise(x.column))


def sort(x: Tensor) -> Tensor:
    """A vector's elements in ascending order.

    A range sort cuts the values into partitions; counts of the partitions
    before give the positions, so that no task sorts all.
    """
    x = _vector(x)
    frame = x.frame.select(x.column.alias("v")).repartitionByRange("v").sortWithinPartitions("v")
    frame = frame.select("v", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__row"))
    counts = frame.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    frame = frame.join(counts.select("__part", before.alias("__before")), "__part")
    return Tensor(frame.select((F.col("__before") + F.col("__row")).alias("i0"), "v"), ("i0",), F.col("v"), 0, x._shape)


def rotate(x: Tensor, k: int, axis: int = 0) -> Tensor:
    """Element i goes to position i + k, around the end."""
    n = x.shape[axis]
    return _moved(x, axis, lambda i: F.pmod(i + k, F.lit(max(n, 1))))


def _moved(x: Tensor, axis: int, to) -> Tensor:
    x = x.long()
    names = x.names()
    frame = x.frame.select(*((to(F.col(c)) if a == axis else F.col(c)).cast("long").alias(n) for a, (c, n) in enumerate(zip(x._positions(), names))), x.column.alias("v"))
    return Tensor(frame, names, F.col("v"), 0, x._shape)


def shift(x: Tensor, k: int, fill, axis: int = 0) -> Tensor:
    """Element i goes to position i + k; those that nothing goes to get ``fill``."""
    n = x.shape[axis]
    x = x.long()
    kept = _moved(Tensor(x.frame.where((F.col(x.index[axis]) + k).between(0, n - 1)), x.index, x.column, 0, x._shape), axis, lambda i: i + k)
    gap = (F.col(x.index[axis]) < k) if k > 0 else (F.col(x.index[axis]) >= n + k)
    filled = Tensor(x.frame.where(gap), x.index, F.lit(fill).cast(x.dtype.sql), 0, x._shape)
    return Tensor(kept.df().union(filled.df()), kept.index, F.col("v"), 0, x._shape)


def explode(x: Tensor, value) -> Tensor:
    """A tensor of the shape of ``x`` with one value everywhere."""
    return x.long().with_column(F.lit(value))


def shape_vector(x: Tensor) -> Column:
    return F.array(*(F.lit(n) for n in x.shape))


# -- positions of extremes


def _extreme(x: Tensor, best, sign: int, axis: int | None) -> Tensor:
    if x.inner and axis == x.rank - 1:
        return x.with_column(ir.to_column(ir.ArrayCall("argmin" if sign > 0 else "argmax", (ir.Var("x", 1),)), {"x": x.column}), 0)
    if axis is None and x.rank > 1:
        x = flatten(x)
    x = x.long()
    axis = axis or 0
    names = x._positions()
    keep = [F.col(c).alias(f"i{k}") for k, c in enumerate(n for a, n in enumerate(names) if a != axis)]
    pick = best(F.struct(x.column.alias("v"), (sign * F.col(names[axis])).alias("i")))
    out = (x.frame.groupBy(*keep) if keep else x.frame).agg((sign * pick["i"]).cast("int").alias("v"))
    return Tensor(out, [f"i{k}" for k in range(len(keep))], F.col("v"), 0)


def argmin(x: Tensor, axis: int | None = None) -> Tensor:
    """The first position of the least element."""
    return _extreme(x, F.min, 1, axis)


def argmax(x: Tensor, axis: int | None = None) -> Tensor:
    """The first position of the greatest element."""
    return _extreme(x, F.max, -1, axis)


def select(condition: Tensor, a, b) -> Tensor:
    """Elementwise ``a`` where the condition holds, else ``b``."""
    return map_op("select", condition, a, b)


def cast(x: Tensor, to: types.ElementType) -> Tensor:
    return x.with_column(F.transform(x.column, lambda v: v.cast(to.sql)) if x.inner else x.column.cast(to.sql))
