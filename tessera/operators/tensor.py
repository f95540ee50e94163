"""Tensors: dense arrays held in DataFrames.

A tensor is a column expression over a frame. Its axes are, in this order, the
frame's index columns (positions from 0) and, if the column is an array, the
position within it. Tensors over one frame are combined in one projection;
those over different frames are joined on their index columns. A frame without
a key can be mapped and reduced, but has no positions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types


class Tensor:
    def __init__(self, frame: DataFrame, index: Sequence[str] | None, column: Column, inner: int = 0, shape: tuple[int, ...] | None = None):
        self.frame, self.index, self.column, self.inner = frame, None if index is None else tuple(index), column, inner
        self._shape = shape

    # -- what it is

    @property
    def rank(self) -> int:
        return (1 if self.index is None else len(self.index)) + self.inner

    @property
    def dtype(self) -> types.ElementType:
        kind = self.frame.select(self.column.alias("v")).schema["v"].dataType
        return types.of_spark(kind.elementType if self.inner else kind)

    @property
    def shape(self) -> tuple[int, ...]:
        """Extents: one more than the largest position of each index column. Counted on first use."""
        if self._shape is None:
            outer = [F.count("*")] if self.index is None else [F.coalesce(F.max(c) + 1, F.lit(0)) for c in self.index]
            inner = [F.coalesce(F.max(F.size(self.column)), F.lit(0))] if self.inner else []
            self._shape = tuple(int(x) for x in self.frame.agg(*(x.alias(f"n{i}") for i, x in enumerate(outer + inner))).first())
        return self._shape

    def __len__(self) -> int:
        return self.shape[0]

    @property
    def strides(self) -> tuple[int, ...]:
        """Bytes between neighbours along each axis, were the array stored row by row."""
        size, out = self.dtype.size, []
        for n in reversed(self.shape):
            out.append(size)
            size *= n
        return tuple(reversed(out))

    @property
    def T(self) -> Tensor:
        from .arrays import transpose

        return transpose(self)

    def names(self) -> tuple[str, ...]:
        return () if self.index is None else tuple(f"i{k}" for k in range(len(self.index)))

    def df(self, value: str = "v") -> DataFrame:
        """Columns i0, i1 ... and the value."""
        return self.frame.select(*(F.col(c).alias(n) for c, n in zip(self.index or (), self.names())), self.column.alias(value))

    def with_column(self, column: Column, inner: int | None = None) -> Tensor:
        inner = self.inner if inner is None else inner
        return Tensor(self.frame, self.index, column, inner, self._shape if inner == self.inner else None)

    # -- other encodings

    def long(self) -> Tensor:
        """One row an element."""
        if not self.inner:
            return self
        keys = [F.col(c).alias(n) for c, n in zip(self.index, self.names())]
        frame = self.frame.select(*keys, F.posexplode(self.column).alias(f"i{len(keys)}", "v"))
        frame = frame.withColumn(f"i{len(keys)}", F.col(f"i{len(keys)}").cast("long"))
        return Tensor(frame, [f"i{k}" for k in range(len(keys) + 1)], F.col("v"), 0, self._shape)

    def rows(self, axis: int = 0) -> Tensor:
        """A matrix by rows (``axis`` 0) or columns, each an array; an array must fit in memory."""
        if self.inner and axis == 0:
            return self
        x = self.long()
        if x.rank != 2:
            raise ValueError("only matrices have rows")
        keep, within = x.index[axis], x.index[1 - axis]
        items = F.array_sort(F.collect_list(F.struct(F.col(within).alias("i"), x.column.alias("v"))))
        frame = x.frame.groupBy(F.col(keep).alias("i0")).agg(F.transform(items, lambda s: s["v"]).alias("v"))
        return Tensor(frame, ("i0",), F.col("v"), 1)

    def vectors(self) -> Tensor:
        """The last axis as arrays; an array must fit in memory."""
        if self.inner:
            return self
        *keep, last = self._positions()
        items = F.array_sort(F.collect_list(F.struct(F.col(last).alias("i"), self.column.alias("v"))))
        names = [f"i{k}" for k in range(len(keep))]
        frame = self.frame.groupBy(*(F.col(c).alias(n) for c, n in zip(keep, names))).agg(F.transform(items, lambda s: s["v"]).alias("v"))
        return Tensor(frame, names, F.col("v"), 1, self._shape)

    def cell(self) -> DataFrame:
        """One row with the whole vector as an array in column ``cell``; meant for small ones."""
        self._positions()
        if self.rank != 1:
            raise ValueError("only vectors fit into a cell")
        items = F.array_sort(F.collect_list(F.struct(F.col(self.index[0]).alias("i"), self.column.alias("v"))))
        return self.frame.agg(F.transform(items, lambda s: s["v"]).alias("cell"))

    def _positions(self) -> tuple[str, ...]:
        if self.index is None:
            raise ValueError("the frame has no key, so its rows have no positions")
        return self.index

    def numpy(self) -> np.ndarray:
        """All elements on the driver."""
        kind = np.dtype(self.dtype.numpy)
        if self.rank == 0:
            return np.array(self.frame.select(self.column.alias("v")).first()["v"], kind)
        self._positions()
        rows = self.df().toPandas().sort_values(list(self.names()))
        values = np.stack(rows["v"].to_list()) if self.inner and len(rows) else rows["v"].to_numpy()
        return values.astype(kind).reshape(self.shape)

    def item(self):
        """The value of a tensor without axes."""
        return self.frame.select(self.column.alias("v")).first()["v"]

    # -- arithmetic, as in kernels

    def _map(self, name: str, *others, swap: bool = False) -> Tensor:
        from .adverbs import map_op

        args = (*others, self) if swap else (self, *others)
        return map_op(name, *args)

    def __add__(self, o):
        return self._map("add", o)

    __radd__ = __add__

    def __sub__(self, o):
        return self._map("sub", o)

    def __rsub__(self, o):
        return self._map("sub", o, swap=True)

    def __mul__(self, o):
        return self._map("mult", o)

    __rmul__ = __mul__

    def __truediv__(self, o):
        return self._map("truediv", o)

    def __rtruediv__(self, o):
        return self._map("truediv", o, swap=True)

    def __mod__(self, o):
        return self._map("pymod", o)

    def __pow__(self, o):
        return self._map("pow", o)

    def __neg__(self):
        return self._map("neg")

    def __invert__(self):
        return self._map("not")

    def __and__(self, o):
        return self._map("and", o)

    def __or__(self, o):
        return self._map("or", o)

    def __eq__(self, o):
        return self._map("eq", o)

    def __ne__(self, o):
        return self._map("neq", o)

    def __lt__(self, o):
        return self._map("lt", o)

    def __le__(self, o):
        return self._map("lte", o)

    def __gt__(self, o):
        return self._map("gt", o)

    def __ge__(self, o):
        return self._map("gte", o)

    __hash__ = object.__hash__

    def __getitem__(self, at):
        from . import arrays

        return arrays.index(self, at)


def column(frame: DataFrame, value: str | Column, index: str | Sequence[str] | None = None) -> Tensor:
    """A vector (or more axes, by several index columns) from a frame's column; positions must be dense from 0."""
    index = (index,) if isinstance(index, str) else index
    value = F.col(value) if isinstance(value, str) else value
    kind = frame.select(value.alias("v")).schema["v"].dataType
    return Tensor(frame, index, value, int(isinstance(kind, T.ArrayType)))


def from_numpy(spark: SparkSession, array) -> Tensor:
    """A tensor of a NumPy array; matrices by rows."""
    array = np.asarray(array)
    kind = types.of_numpy(array.dtype)
    if array.ndim == 0:
        return Tensor(spark.createDataFrame([(array.item(),)], f"v {kind.sql}"), (), F.col("v"), 0, ())
    if array.ndim == 1:
        rows, schema, inner = [(i, v) for i, v in enumerate(array.tolist())], f"i0 long, v {kind.sql}", 0
    elif array.ndim == 2:
        rows, schema, inner = [(i, v) for i, v in enumerate(array.tolist())], f"i0 long, v array<{kind.sql}>", 1
    else:
        names = [f"i{k}" for k in range(array.ndim)]
        rows = [(*map(int, at), v.item()) for at, v in np.ndenumerate(array)]
        return Tensor(spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names) + f", v {kind.sql}"), names, F.col("v"), 0, array.shape)
    return Tensor(spark.createDataFrame(rows, schema), ("i0",), F.col("v"), inner, array.shape)


def arange(spark: SparkSession, start: int, stop: int | None = None, step: int = 1) -> Tensor:
    """0, 1 ... as int32, as Python's ranges."""
    turns = range(start) if stop is None else range(start, stop, step)
    frame = spark.range(len(turns)).select(F.col("id").alias("i0"), (F.col("id") * turns.step + turns.start).cast("int").alias("v"))
    return Tensor(frame, ("i0",), F.col("v"), 0, (len(turns),))
