"""Element types, their NumPy and Spark forms, and promotion.

Promotion is NumPy's: a float with an integer that it can't hold exactly gives
the next float that can (float32 with int64: float64).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import types as T


@dataclass(frozen=True)
class ElementType:
    name: str
    numpy: str
    spark: T.DataType
    size: int

    @property
    def sql(self) -> str:
        return self.spark.simpleString()

    @property
    def is_float(self) -> bool:
        return self.name.startswith("float")


BOOL = ElementType("bool", "bool", T.BooleanType(), 1)
CHAR = ElementType("char", "int8", T.ByteType(), 1)
INT16 = ElementType("int16", "int16", T.ShortType(), 2)
INT32 = ElementType("int32", "int32", T.IntegerType(), 4)
INT64 = ElementType("int64", "int64", T.LongType(), 8)
FLOAT32 = ElementType("float32", "float32", T.FloatType(), 4)
FLOAT64 = ElementType("float64", "float64", T.DoubleType(), 8)
ALL = (BOOL, CHAR, INT16, INT32, INT64, FLOAT32, FLOAT64)

_BY_NUMPY = {np.dtype(t.numpy): t for t in ALL}
_BY_SPARK = {t.spark.simpleString(): t for t in ALL}


def of_numpy(dtype) -> ElementType:
    found = _BY_NUMPY.get(np.dtype(dtype))
    if found is None:
        raise TypeError(f"arrays of {np.dtype(dtype)} are not supported")
    return found


def of_spark(kind: T.DataType) -> ElementType:
    found = _BY_SPARK.get(kind.simpleString())
    if found is None:
        raise TypeError(f"columns of {kind.simpleString()} are not numbers")
    return found


def of_value(value) -> ElementType:
    if isinstance(value, np.generic):
        return of_numpy(value.dtype)
    if isinstance(value, bool):
        return BOOL
    if isinstance(value, int):
        return INT32 if -(1 << 31) <= value < 1 << 31 else INT64
    if isinstance(value, float):
        return FLOAT64
    raise TypeError(f"{type(value).__name__} is not a number")


def common(*types: ElementType) -> ElementType:
    """The type that holds all of ``types``."""
    return of_numpy(np.result_type(*(np.dtype(t.numpy) for t in types)))
