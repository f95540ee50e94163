"""NumPy-like functions of tensors, in terms of the operators."""

from __future__ import annotations

import builtins
import operator

from pyspark.sql import functions as F

from .. import types
from ..operators import adverbs, arrays
from ..operators.adverbs import map_op
from ..operators.tensor import Tensor
from .kernel import named


def add(x, y):
    return map_op("add", x, y)


def sub(x, y):
    return map_op("sub", x, y)


def mult(x, y):
    return map_op("mult", x, y)


def div(x, y):
    """Of integers the quotient without its fraction, in their type; else the quotient."""
    kinds = [v.dtype for v in (x, y) if isinstance(v, Tensor)]
    if builtins.any(k.is_float for k in kinds) or isinstance(x, float) or isinstance(y, float):
        return map_op("truediv", x, y)
    out = map_op("intdiv", x, y)
    return arrays.cast(out, types.common(*kinds))


def safe_div(x, y):
    """Of integers the quotient rounded up, in their type."""
    kinds = [v.dtype for v in (x, y) if isinstance(v, Tensor)]
    return arrays.cast(map_op("safediv", x, y), types.common(*kinds))


def mod(x, y):
    """The remainder with the sign of ``x``; the operator % has that of Python."""
    return map_op("mod", x, y)


def power(x, y):
    return map_op("pow", x, y)


def minimum(x, y):
    return map_op("min", x, y)


def maximum(x, y):
    return map_op("max", x, y)


def unary(name: str, x: Tensor) -> Tensor:
    """abs, sqrt, exp, exp2, log, log2, log10, sin, cos, tan, sinh, cosh, tanh, sign, reciprocal, ceil, floor, round, neg, not.

    sign, ceil, floor and round keep the element type.
    """
    out = map_op(name, x)
    return arrays.cast(out, x.dtype) if name in ("sign", "ceil", "floor", "round") else out


def absolute(x: Tensor) -> Tensor:
    return unary("abs", x)


def sum(x: Tensor, axis=None):
    return adverbs.reduce(operator.add, x, axis=axis, init=0)


def prod(x: Tensor, axis=None):
    return adverbs.reduce(operator.mul, x, axis=axis, init=1)


def min(x: Tensor, axis=None):
    return adverbs.reduce(named("min"), x, axis=axis)


def max(x: Tensor, axis=None):
    return adverbs.reduce(named("max"), x, axis=axis)


def all(x: Tensor, axis=None):
    return adverbs.reduce(named("and"), x, axis=axis, init=True)


def any(x: Tensor, axis=None):
    return adverbs.reduce(named("or"), x, axis=axis, init=False)


argmin = arrays.argmin
argmax = arrays.argmax


def mean(x: Tensor, axis=None):
    """Sum over count; the mean of nothing is null."""
    if axis is None or x.rank == 1:
        if x.inner:
            x = x.long()
        return adverbs._scalar(F.avg(x.column), x.frame)
    axis = adverbs._normal_axis(axis, x.rank)
    x = x.long()
    keep = [F.col(c).alias(f"i{k}") for k, c in enumerate(n for a, n in enumerate(x._positions()) if a != axis)]
    return Tensor(x.frame.groupBy(*keep).agg(F.avg(x.column).alias("v")), [f"i{k}" for k in range(len(keep))], F.col("v"))


def dot(x: Tensor, y: Tensor):
    """Of vectors the sum of products; of matrices the matrix product."""
    if x.rank == y.rank == 1:
        return sum(mult(x, y))
    if x.rank == y.rank == 2:
        return adverbs.contract(x, y)
    raise ValueError("dot of two vectors or two matrices")


def cumsum(x: Tensor, axis: int = 0):
    return adverbs.scan(operator.add, x, axis=axis)


def cumprod(x: Tensor, axis: int = 0):
    return adverbs.scan(operator.mul, x, axis=axis)


class ufunc:
    """reduce and accumulate of a binary operation, along axis 0 unless another is named."""

    def __init__(self, name: str):
        self.f = named(name)

    def __call__(self, x, y):
        return adverbs.map(self.f, x, y)

    def reduce(self, x: Tensor, axis: int = 0):
        return adverbs.reduce(self.f, x, axis=axis if x.rank > 1 else None)

    def accumulate(self, x: Tensor, axis: int = 0):
        return adverbs.scan(self.f, x, axis=axis)
