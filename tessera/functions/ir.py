"""Expressions that kernels are compiled to, their rewriting, and their Spark columns.

Scalars and one-dimensional arrays within a row are told apart by ``rank``.
Array expressions become higher-order functions; the rewriting fuses chains of
them, which Catalyst doesn't do.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_names = itertools.count()


def fresh(stem: str = "v") -> str:
    return f"{stem}_{next(_names)}"


@dataclass(frozen=True)
class Expr:
    @property
    def rank(self) -> int:
        return 0

    @property
    def parts(self) -> tuple[Expr, ...]:
        return ()

    def rebuilt(self, parts: tuple[Expr, ...]) -> Expr:
        return self


@dataclass(frozen=True)
class Const(Expr):
    value: object


@dataclass(frozen=True)
class Var(Expr):
    name: str
    of_rank: int = 0

    @property
    def rank(self):
        return self.of_rank


@dataclass(frozen=True)
class Op(Expr):
    """A scalar operation; on arrays it is mapped when built (see ``op``)."""

    name: str
    args: tuple[Expr, ...]

    @property
    def rank(self):
        return max((a.rank for a in self.args), default=0)  # a scalar condition may choose between arrays

    @property
    def parts(self):
        return self.args

    def rebuilt(self, parts):
        return replace(self, args=parts)


@dataclass(frozen=True)
class Cast(Expr):
    arg: Expr
    to: str

    @property
    def parts(self):
        return (self.arg,)

    def rebuilt(self, parts):
        return replace(self, arg=parts[0])


@dataclass(frozen=True)
class Tuple(Expr):
    items: tuple[Expr, ...]

    @property
    def parts(self):
        return self.items

    def rebuilt(self, parts):
        return replace(self, items=parts)


@dataclass(frozen=True)
class ArrayMap(Expr):
    """``body`` for the elements of ``arrays``, which ``names`` stand for."""

    names: tuple[str, ...]
    body: Expr
    arrays: tuple[Expr, ...]

    @property
    def rank(self):
        return 1

    @property
    def parts(self):
        return (self.body, *self.arrays)

    def rebuilt(self, parts):
        return replace(self, body=parts[0], arrays=parts[1:])


@dataclass(frozen=True)
class ArrayFilter(Expr):
    array: Expr
    mask: Expr

    @property
    def rank(self):
        return 1

    @property
    def parts(self):
        return (self.array, self.mask)

    def rebuilt(self, parts):
        return replace(self, array=parts[0], mask=parts[1])


@dataclass(frozen=True)
class ArrayReduce(Expr):
    """Left fold: ``body`` of the accumulator ``acc`` and the element ``item``, from ``init`` (None: the first element)."""

    acc: str
    item: str
    body: Expr
    array: Expr
    init: Expr | None

    @property
    def parts(self):
        return (self.body, self.array) + ((self.init,) if self.init is not None else ())

    def rebuilt(self, parts):
        return replace(self, body=parts[0], array=parts[1], init=parts[2] if len(parts) > 2 else None)


@dataclass(frozen=True)
class ArrayScan(ArrayReduce):
    @property
    def rank(self):
        return 1


@dataclass(frozen=True)
class ArrayCall(Expr):
    """Array functions that Spark has: size, get, min, max, argmin, argmax, where, range, array, sort, product."""

    name: str
    args: tuple[Expr, ...]

    @property
    def rank(self):
        return int(self.name in ("where", "range", "array", "sort", "gather", "slice"))

    @property
    def parts(self):
        return self.args

    def rebuilt(self, parts):
        return replace(self, args=parts)


@dataclass(frozen=True)
class Loop(Expr):
    """``outs`` take the place of the variables ``names``, which begin as ``inits``, while ``test`` holds. It has no column form."""

    names: tuple[str, ...]
    test: Expr
    outs: tuple[Expr, ...]
    inits: tuple[Expr, ...]

    @property
    def parts(self):
        return (self.test, *self.outs, *self.inits)

    def rebuilt(self, parts):
        k = len(self.names)
        return replace(self, test=parts[0], outs=parts[1 : k + 1], inits=parts[k + 1 :])


@dataclass(frozen=True)
class LoopItem(Expr):
    """A variable's value after a loop."""

    loop: Loop
    place: int

    @property
    def parts(self):
        return (self.loop,)

    def rebuilt(self, parts):
        return replace(self, loop=parts[0])


def has_loop(e: Expr) -> bool:
    return isinstance(e, Loop) or any(map(has_loop, e.parts))


def op(name: str, *args: Expr) -> Expr:
    """A scalar operation, mapped over those arguments that are arrays."""
    arrays = [a for a in args if a.rank]
    if not arrays:
        return Op(name, args)
    names = [fresh("e") for _ in arrays]
    at = iter(names)
    return ArrayMap(tuple(names), Op(name, tuple(Var(next(at)) if a.rank else a for a in args)), tuple(arrays))


def cast(arg: Expr, to: str) -> Expr:
    if not arg.rank:
        return Cast(arg, to)
    name = fresh("e")
    return ArrayMap((name,), Cast(Var(name), to), (arg,))


# -- rewriting


def variables(e: Expr) -> set[str]:
    return {e.name} if isinstance(e, Var) else set().union(*map(variables, e.parts))


def substitute(e: Expr, values: dict[str, Expr]) -> Expr:
    if isinstance(e, Var):
        return values.get(e.name, e)
    return e.rebuilt(tuple(substitute(p, values) for p in e.parts)) if e.parts else e


_FOLDED: dict[str, Callable] = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mult": lambda a, b: a * b, "neg": lambda a: -a,
    "eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b,
    "and": lambda a, b: a and b, "or": lambda a, b: a or b, "not": lambda a: not a, "truediv": lambda a, b: a / b, "floordiv": lambda a, b: a // b, "pymod": lambda a, b: a % b,
    "sqrt": math.sqrt, "exp": math.exp, "log": math.log, "pow": lambda a, b: a**b, "min": min, "max": max, "abs": abs,
}


def fold(e: Expr) -> Expr:
    """Constant folding, and ``select`` on a constant condition."""
    e = e.rebuilt(tuple(fold(p) for p in e.parts)) if e.parts else e
    if isinstance(e, Op):
        if e.name == "select" and isinstance(e.args[0], Const):
            return e.args[1] if e.args[0].value else e.args[2]
        if e.name in _FOLDED and all(isinstance(a, Const) for a in e.args):
            try:
                return Const(_FOLDED[e.name](*(a.value for a in e.args)))
            except (ArithmeticError, ValueError, TypeError):
                return e
    return e


def fuse(e: Expr) -> Expr:
    """map of map, fold of map and scan of map become one pass over the array."""
    e = e.rebuilt(tuple(fuse(p) for p in e.parts)) if e.parts else e
    if isinstance(e, ArrayMap):
        names, arrays, values = [], [], {}
        for name, array in zip(e.names, e.arrays):
            if isinstance(array, ArrayMap):
                names += array.names
                arrays += array.arrays
                values[name] = array.body
            elif array in arrays:
                values[name] = Var(names[arrays.index(array)])
            else:
                names.append(name)
                arrays.append(array)
        if values:
            return ArrayMap(tuple(names), substitute(e.body, values), tuple(arrays))
    if isinstance(e, ArrayReduce) and e.init is not None and isinstance(e.array, ArrayMap) and len(e.array.names) == 1:
        inner = e.array
        return replace(e, item=inner.names[0], body=substitute(e.body, {e.item: inner.body}), array=inner.arrays[0])
    return e


PASSES: dict[str, Callable[[Expr], Expr]] = {"fold": fold, "fuse": fuse}


def optimize(e: Expr, passes: tuple[str, ...] = ("fold", "fuse"), rounds: int = 100) -> Expr:
    """The passes in order, until nothing changes."""
    for _ in range(rounds):
        before = e
        for name in passes:
            e = PASSES[name](e)
        if e == before:
            break
    return e


def explain(e: Expr, indent: int = 0) -> str:
    label = {Const: lambda x: repr(x.value), Var: lambda x: x.name, Op: lambda x: x.name, Cast: lambda x: f"cast to {x.to}", ArrayCall: lambda x: x.name}.get(type(e), lambda x: type(x).__name__)(e)
    return "\n".join(["  " * indent + label, *(explain(p, indent + 1) for p in e.parts)])


# -- shared parts


def _always(e: Expr, found: dict[Expr, None]) -> dict[Expr, None]:
    """The scalar operations that are computed whatever the data, inner ones first."""
    if isinstance(e, Op) and e.name == "select":
        _always(e.args[0], found)
        yes, no = (_always(a, {}) for a in e.args[1:])
        found.update((x, None) for x in yes if x in no)
    elif isinstance(e, Op) and e.name in ("and", "or"):
        _always(e.args[0], found)
    elif isinstance(e, (Op, Cast, Tuple)):
        for p in e.parts:
            _always(p, found)
        if not isinstance(e, Tuple) and not e.rank:
            found[e] = None
    return found


def _uses(e: Expr, wanted: dict[Expr, None], counts: dict[Expr, int]) -> None:
    """How often each of ``wanted`` is named, if each is computed once."""
    if e in wanted:
        counts[e] = counts.get(e, 0) + 1
        if counts[e] > 1:
            return
    for p in e.parts:
        _uses(p, wanted, counts)


def replaced(e: Expr, values: dict[Expr, Expr]) -> Expr:
    """``e`` with whole parts replaced."""
    if e in values:
        return values[e]
    return e.rebuilt(tuple(replaced(p, values) for p in e.parts)) if e.parts else e


def shared(e: Expr) -> tuple[list[tuple[str, Expr]], Expr]:
    """Names for the scalar operations that are used more than once and always computed, in order of use, and ``e`` by these names.

    What only a branch computes stays there: it may fail on other data.
    """
    always = _always(e, {})
    counts: dict[Expr, int] = {}
    _uses(e, always, counts)
    out, values = [], {}
    for part in always:
        if counts.get(part, 0) > 1 and any(not isinstance(p, Const) for p in part.parts):
            name = fresh("shared")
            out.append((name, replaced(part, values)))
            values[part] = Var(name)
    return out, replaced(e, values)


# -- Spark columns


def _equal(a: Column, b: Column) -> Column:
    """IEEE: NaN equals nothing. Spark holds NaN equal to itself."""
    return (a == b) & ~_nan(a)


def _nan(a: Column) -> Column:
    return F.isnan(a.cast("double"))


def _log(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Spark's logarithms are null where C has -inf or NaN."""
    return lambda a: F.when(a == 0, F.lit(float("-inf"))).when(a < 0, F.lit(float("nan"))).otherwise(f(a))


def _ordered(f: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    """Comparisons with NaN are false; Spark sorts NaN above all."""
    return lambda a, b: f(a, b) & ~_nan(a) & ~_nan(b)


SCALAR: dict[str, Callable[..., Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mult": lambda a, b: a * b,
    "truediv": lambda a, b: a.cast("double") / b.cast("double"),
    "div": lambda a, b: a / b,
    "intdiv": lambda a, b: F.call_function("div", a, b),
    "safediv": lambda a, b: F.call_function("div", a + b - 1, b),
    "floordiv": lambda a, b: F.floor(a / b),
    "mod": lambda a, b: a % b,
    "pymod": F.pmod,
    "pow": F.pow,
    "min": F.least,
    "max": F.greatest,
    "and": lambda a, b: a & b,
    "or": lambda a, b: a | b,
    "not": lambda a: ~a,
    "eq": _equal,
    "neq": lambda a, b: ~_equal(a, b),
    "lt": _ordered(lambda a, b: a < b),
    "lte": _ordered(lambda a, b: a <= b),
    "gt": _ordered(lambda a, b: a > b),
    "gte": _ordered(lambda a, b: a >= b),
    "hypot": F.hypot,
    "neg": lambda a: -a,
    "sqrt": F.sqrt,
    "sign": F.signum,
    "reciprocal": lambda a: F.lit(1.0) / a,
    "abs": F.abs,
    "ceil": F.ceil,
    "floor": F.floor,
    "round": F.rint,
    "exp": F.exp,
    "exp2": lambda a: F.pow(F.lit(2.0), a),
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "log": _log(F.ln),
    "log2": _log(F.log2),
    "log10": _log(F.log10),
    "select": lambda c, a, b: F.when(c, a).otherwise(b),
}
ARITY = {"select": 3} | {n: 2 for n in ("add", "sub", "mult", "truediv", "div", "intdiv", "safediv", "floordiv", "mod", "pymod", "pow", "hypot", "min", "max", "and", "or", "eq", "neq", "lt", "lte", "gt", "gte")}


def _zipped(arrays: list[Column], f: Callable[..., Column]) -> Column:
    if len(arrays) == 1:
        return F.transform(arrays[0], lambda x: f(x))
    if len(arrays) == 2:
        return F.zip_with(arrays[0], arrays[1], lambda x, y: f(x, y))
    names = [f"f{i}" for i in range(len(arrays))]
    rows = F.arrays_zip(*(a.alias(n) for a, n in zip(arrays, names)))
    return F.transform(rows, lambda r: f(*(r.getField(n) for n in names)))


def to_column(e: Expr, env: dict[str, Column]) -> Column:
    def go(x: Expr) -> Column:
        return to_column(x, env)

    if isinstance(e, Const):
        return F.lit(e.value)
    if isinstance(e, Var):
        return env[e.name]
    if isinstance(e, Op):
        return SCALAR[e.name](*map(go, e.args))
    if isinstance(e, Cast):
        return go(e.arg).cast(e.to)
    if isinstance(e, Tuple):
        return F.struct(*(go(x).alias(f"_{i}") for i, x in enumerate(e.items)))
    if isinstance(e, ArrayMap):
        return _zipped([go(a) for a in e.arrays], lambda *xs: to_column(e.body, env | dict(zip(e.names, xs))))
    if isinstance(e, ArrayFilter):
        pairs = F.arrays_zip(go(e.array).alias("v"), go(e.mask).alias("m"))
        return F.transform(F.filter(pairs, lambda p: p["m"]), lambda p: p["v"])
    if isinstance(e, ArrayScan):
        array, init = go(e.array), None if e.init is None else go(e.init)

        def step(s, x):
            first = x if init is None else to_column(e.body, env | {e.acc: init, e.item: x})
            after = F.when(F.size(s) == 0, first).otherwise(to_column(e.body, env | {e.acc: F.element_at(s, -1), e.item: x}))
            return F.concat(s, F.array(after))

        return F.aggregate(array, F.slice(array, 1, 0), step)
    if isinstance(e, ArrayReduce):
        array = go(e.array)

        def fold_from(start: Column, rest: Column) -> Column:
            return F.aggregate(rest, start, lambda a, x: to_column(e.body, env | {e.acc: a, e.item: x}))

        if e.init is not None:
            return fold_from(go(e.init), array)
        if isinstance(e.array, Var):
            return fold_from(F.get(array, F.lit(0)), _tail(array))
        # the array is named once, or it would be computed for its first element, its length and its rest
        return F.get(F.transform(F.array(array), lambda a: fold_from(F.get(a, F.lit(0)), _tail(a))), F.lit(0))
    if isinstance(e, ArrayCall):
        return _ARRAY[e.name](*map(go, e.args))
    raise TypeError(type(e).__name__)


def _tail(array: Column) -> Column:
    return F.when(F.size(array) > 1, F.slice(array, 2, F.greatest(F.size(array) - 1, F.lit(1)))).otherwise(F.slice(array, 1, 0))


def contraction(e: Expr, x: str, y: str) -> str | None:
    """``dot`` or ``sqdist`` if ``e`` is the sum of products, or of squared differences, of the arrays ``x`` and ``y``."""
    if not (isinstance(e, ArrayReduce) and not isinstance(e, ArrayScan) and e.init is None and isinstance(e.array, ArrayMap) and e.body in (Op("add", (Var(e.acc), Var(e.item))), Op("add", (Var(e.item), Var(e.acc))))):
        return None
    names = dict(zip(e.array.arrays, e.array.names))
    if set(names) != {Var(x, 1), Var(y, 1)}:
        return None
    p, q = Var(names[Var(x, 1)]), Var(names[Var(y, 1)])
    if e.array.body in (Op("mult", (p, q)), Op("mult", (q, p))):
        return "dot"
    for d in (Op("sub", (p, q)), Op("sub", (q, p))):
        if e.array.body == Op("mult", (d, d)):
            return "sqdist"
    return None


def _arg(best: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda a: (F.array_position(a, best(a)) - 1).cast("int")


_ARRAY: dict[str, Callable[..., Column]] = {
    "size": F.size,
    "get": lambda a, i: F.get(a, i.cast("int")),
    "min": F.array_min,
    "max": F.array_max,
    "argmin": _arg(F.array_min),
    "argmax": _arg(F.array_max),
    "where": lambda m: F.transform(F.filter(F.transform(m, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda p: p["v"]), lambda p: p["i"]),
    "range": lambda n: F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>")),
    "array": lambda *xs: F.array(*xs),
    "sort": F.array_sort,
    "gather": lambda a, ix: F.transform(ix, lambda i: F.get(a, i.cast("int"))),
    "slice": lambda a, lo, n: F.slice(a, lo + 1, n),
    "all": lambda a: F.forall(a, lambda x: x),
    "any": lambda a: F.exists(a, lambda x: x),
}


# -- NumPy, for what has no column form

NUMPY: dict[str, Callable] = {
    "add": np.add, "sub": np.subtract, "mult": np.multiply, "truediv": np.true_divide, "div": np.true_divide, "intdiv": lambda a, b: np.trunc(a / b).astype(np.int64), "safediv": lambda a, b: -((-a) // b),
    "floordiv": np.floor_divide, "mod": np.fmod, "pymod": np.mod, "pow": lambda a, b: np.power(np.asarray(a, float), b), "hypot": np.hypot, "min": np.minimum, "max": np.maximum, "and": np.logical_and, "or": np.logical_or, "not": np.logical_not,
    "eq": np.equal, "neq": np.not_equal, "lt": np.less, "lte": np.less_equal, "gt": np.greater, "gte": np.greater_equal, "neg": np.negative, "sqrt": np.sqrt, "sign": np.sign, "reciprocal": lambda a: 1.0 / a, "abs": np.abs,
    "ceil": np.ceil, "floor": np.floor, "round": np.rint, "exp": np.exp, "exp2": np.exp2, "sin": np.sin, "cos": np.cos, "tan": np.tan, "sinh": np.sinh, "cosh": np.cosh, "tanh": np.tanh, "log": np.log, "log2": np.log2, "log10": np.log10, "select": np.where,
}
_NUMPY_CASTS = {"int": np.int32, "double": np.float64, "boolean": np.bool_, "tinyint": np.int8, "smallint": np.int16, "bigint": np.int64, "float": np.float32}


def evaluate(e: Expr, env: dict[str, np.ndarray], n: int):
    """``e`` for ``n`` elements at once; a loop goes on with those elements whose test holds."""
    done: dict[int, object] = {}

    def go(x: Expr):
        if id(x) not in done:
            done[id(x)] = one(x)
        return done[id(x)]

    def one(x: Expr):
        if isinstance(x, Const):
            return x.value
        if isinstance(x, Var):
            return env[x.name]
        if isinstance(x, Op):
            return NUMPY[x.name](*map(go, x.args))
        if isinstance(x, Cast):
            return np.asarray(go(x.arg)).astype(_NUMPY_CASTS[x.to])
        if isinstance(x, Tuple):
            return tuple(map(go, x.items))
        if isinstance(x, Loop):
            return _run_loop(x, [go(i) for i in x.inits], env, n)
        if isinstance(x, LoopItem):
            return go(x.loop)[x.place]
        raise TypeError(f"{type(x).__name__} over arrays")

    return go(e)


def _run_loop(x: Loop, inits: list, env: dict[str, np.ndarray], n: int) -> list[np.ndarray]:
    given = [*env.values(), *inits]
    kind = np.float64 if any(np.asarray(v).dtype.kind == "f" for v in given) else np.int64
    state = [np.broadcast_to(np.asarray(v), n).astype(bool if np.asarray(v).dtype.kind == "b" else kind) for v in inits]
    at = np.arange(n)
    while True:
        here = {k: np.asarray(v)[at] if np.ndim(v) else v for k, v in env.items()} | {k: v[at] for k, v in zip(x.names, state)}
        holds = np.broadcast_to(evaluate(x.test, here, len(at)), len(at))
        at, here = at[holds], {k: v[holds] if np.ndim(v) else v for k, v in here.items()}
        if not len(at):
            return state
        new = [np.broadcast_to(evaluate(o, here, len(at)), len(at)) for o in x.outs]
        for v, o in zip(state, new):
            v[at] = o
