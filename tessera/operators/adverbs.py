"""map, reduce, scan and allpairs.

The functions they take are kernels (or plain Python functions, compiled the
same way). Known combinations such as sums become Spark's own aggregates and
windows; any other fold runs in order of position within one row per result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import types
from ..functions import ir
from ..functions.kernel import Kernel, KernelError, compile_kernel, named
from .tensor import Tensor

#: Aggregates of the payloads that Spark has itself.
MONOIDS: dict[str, Callable[[Column], Column]] = {"add": F.sum, "mult": F.product, "min": F.min, "max": F.max, "and": F.bool_and, "or": F.bool_or}
#: Positions that one task scans in order, if a scan has no other axis to split it by.
SCAN_BLOCK = 1 << 16
#: Accumulators that a partition's fold keeps at once, if its payload compiles.
FOLD_LANES = 256


def _normal_axis(axis, rank: int) -> int | None:
    if isinstance(axis, (list, tuple)):
        if sorted(axis) == list(range(rank)):
            return None
        if len(axis) != 1:
            raise ValueError("one axis or all of them")
        axis = axis[0]
    if axis is None:
        return None
    if not -rank <= axis < rank:
        raise ValueError(f"axis {axis} of a tensor with {rank} axes")
    return axis % rank


# -- bringing tensors onto one frame

#: Attribute of a frame that is another one with more columns: that one.
_BASE = "_tessera_base"


def _with_columns(frame: DataFrame, columns: Sequence[tuple[str, Column]]) -> DataFrame:
    """``frame`` with more columns, each of which may use those before it; Spark computes what is used twice once."""
    out = frame
    for name, column in columns:
        out = out.withColumn(name, column)
    if columns:
        setattr(out, _BASE, frame)
    return out


def _bases(frame: DataFrame | None) -> list[DataFrame]:
    found = []
    while frame is not None:
        found.append(frame)
        frame = getattr(frame, _BASE, None)
    return found


def _on_one(xs: Sequence[Tensor]) -> list[Tensor] | None:
    """The same tensors over the one of their frames that has the columns of all, if there is one."""
    if any(x.index != xs[0].index for x in xs):
        return None
    for top in xs:
        bases = _bases(top.frame)
        if all(any(x.frame is b for b in bases) for x in xs):
            return [x if x.frame is top.frame else Tensor(top.frame, x.index, x.column, x.inner, x._shape) for x in xs]
    return None


def align(xs: Sequence[Tensor], rows: bool = False) -> list[Tensor]:
    """The same tensors over one frame; of different ranks, trailing axes are matched. With ``rows`` only the index columns are."""
    if (same := _on_one(xs)) is not None:
        return same
    if not rows and len({x.inner for x in xs if x.rank}) > 1:
        xs = [x.long() for x in xs]
    if any(x.index is None for x in xs):
        raise ValueError("tensors over different frames need positions to be matched")
    rank = max(len(x.index) for x in xs)
    extents = {}
    for x in xs:
        if x._shape is not None:
            for k, n in enumerate(reversed(x._shape[: len(x.index)] if rows else x._shape)):
                if extents.setdefault(k, n) != n:
                    raise ValueError(f"extents {extents[k]} and {n} of one axis")
    frames: list[tuple[DataFrame, tuple, Tensor]] = []
    out = []
    for k, x in enumerate(xs):
        names = [f"i{rank - len(x.index) + j}" for j in range(len(x.index))]
        frame = x.frame.select(*(F.col(c).alias(n) for c, n in zip(x.index, names)), x.column.alias(f"v{k}"))
        frames.append((frame, tuple(names), x))
    frames.sort(key=lambda f: -len(f[1]))
    joined = frames[0][0]
    for frame, names, _ in frames[1:]:
        joined = joined.join(frame, list(names)) if names else joined.crossJoin(frame)
    index = [f"i{k}" for k in range(rank)]
    shape = next((x._shape for x in xs if x._shape is not None and len(x._shape) == rank + x.inner and len(x.index) == rank), None)
    for k, x in enumerate(xs):
        out.append(Tensor(joined, index, F.col(f"v{k}"), x.inner, shape if shape and len(shape) == rank + x.inner else None))
    return out


def _with_fixed(tensors: list[Tensor], fixed: Sequence) -> tuple[list[Tensor], list[object], dict[str, Column]]:
    """Closure arguments as expressions, and the columns they stand for."""
    args, env = [], {}
    for k, value in enumerate(fixed):
        if isinstance(value, Tensor):
            name, cell = f"fixed{k}", f"__fixed{k}"
            if value.rank == 0:
                side, rank = value.frame.select(value.column.alias(cell)), 0
            else:
                side, rank = value.cell().withColumnRenamed("cell", cell), 1
            frame = tensors[0].frame.crossJoin(side)  # one row
            tensors = [Tensor(frame, t.index, t.column, t.inner, t._shape) for t in tensors]
            env[name] = F.col(cell)
            args.append(ir.Var(name, rank))
        elif isinstance(value, (np.ndarray, list)):
            name, array = f"fixed{k}", np.asarray(value)
            env[name] = F.lit(array.tolist()) if array.ndim == 1 else F.array(*(F.lit(r) for r in array.tolist()))
            args.append(ir.Var(name, 1))
        else:
            args.append(value)
    return tensors, args, env


# -- map


def map(f: Callable, *xs, fixed: Sequence = (), axis=None, dtype: types.ElementType = types.FLOAT64, **kwargs):
    """``f`` of the elements (or, along ``axis``, of the sub-arrays) of ``xs``; scalars are the same everywhere.

    Several results make several tensors. If ``f`` can't be compiled it runs
    over Arrow batches and gives elements of ``dtype``.
    """
    tensors = [x for x in xs if isinstance(x, Tensor)]
    if not tensors:
        raise TypeError("map needs a tensor")
    top = max(t.rank for t in tensors)
    axis = _normal_axis(axis, top)
    if axis is not None and top > 2:
        return _map_slices(f, xs, axis, fixed, kwargs)
    along = axis is not None and top == 2
    if along:
        tensors = [t.rows(axis) if t.rank == 2 else t for t in tensors]
    tensors = align(tensors, rows=along)
    tensors, closure, env = _with_fixed(tensors, fixed)
    arrays = [t for t in tensors if t.inner]
    names = [f"x{k}" for k in range(len(tensors))]
    env |= {n: t.column for n, t in zip(names, tensors)}
    # without an axis the payload sees scalars, also of rows
    at = iter([ir.Var(n, t.inner if along else 0) for n, t in zip(names, tensors)])
    args = [next(at) if isinstance(x, Tensor) else x for x in xs]
    base = tensors[0] if not arrays else arrays[0]
    try:
        body = compile_kernel(f, [*closure, *args], kwargs)
    except KernelError:
        if arrays or closure:
            raise
        return base.with_column(_arrow(f, xs, tensors, kwargs, dtype))

    if ir.has_loop(body):
        if arrays or closure:
            raise KernelError("a loop whose end depends on the data takes elements only")
        looped = tuple(base.with_column(_looped(e, names, tensors, dtype)) for e in (body.items if isinstance(body, ir.Tuple) else (body,)))
        return looped if isinstance(body, ir.Tuple) else looped[0]
    if along or not arrays:
        parts, body = ir.shared(body)
        columns = []
        for name, part in parts:
            columns.append((name, ir.to_column(part, env)))
            env[name] = F.col(name)
        base = Tensor(_with_columns(base.frame, columns), base.index, base.column, base.inner, base._shape)

    def result(e: ir.Expr) -> Tensor:
        if along or not arrays:
            return base.with_column(ir.to_column(e, env), e.rank)
        lifted = {n: ir.fresh("e") for n, t in zip(names, tensors) if t.inner}
        inside = ir.substitute(e, {n: ir.Var(v) for n, v in lifted.items()})
        return base.with_column(ir.to_column(ir.optimize(ir.ArrayMap(tuple(lifted.values()), inside, tuple(ir.Var(n, 1) for n in lifted))), env), 1)

    return tuple(result(e) for e in body.items) if isinstance(body, ir.Tuple) else result(body)


#: What a payload may do with a slice of several axes: these go over all its elements, row by row.
_OVER_ALL = ("min", "max", "argmin", "argmax", "all", "any")


def _over_all(e: ir.Expr) -> bool:
    if isinstance(e, (ir.ArrayCall, ir.ArrayScan, ir.ArrayFilter)) and getattr(e, "name", "") not in _OVER_ALL:
        return False
    return all(_over_all(p) for p in e.parts)


def _map_slices(f: Callable, xs: Sequence, axis: int, fixed: Sequence, kwargs: dict):
    """``map`` along an axis of tensors of more than two axes, all of one shape.

    ``f`` may work on the elements of a slice and fold them all; what depends
    on a slice's own axes, as an index does, is refused. A slice must fit in memory.
    """
    tensors = [x.long() for x in xs if isinstance(x, Tensor)]
    rank = tensors[0].rank
    if any(t.rank != rank for t in tensors):
        raise ValueError("a map along an axis of more than two axes takes tensors of the same rank and scalars")
    tensors = align(tensors)
    index = tensors[0]._positions()
    others = [c for k, c in enumerate(index) if k != axis]
    names = [f"x{k}" for k in range(len(tensors))]
    items = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"j{k}") for k, c in enumerate(others)), *(t.column.alias(n) for n, t in zip(names, tensors)))))
    slices = Tensor(tensors[0].frame.groupBy(F.col(index[axis]).alias("i0")).agg(items.alias("items")), ("i0",), F.col("items"), 1)
    (slices,), closure, env = _with_fixed([slices], fixed)
    env |= {n: F.col(f"items.{n}") for n in names}
    at = iter(names)
    body = compile_kernel(f, [*closure, *(ir.Var(next(at), 1) if isinstance(x, Tensor) else x for x in xs)], kwargs)
    if not _over_all(body):
        raise ValueError("the payload depends on the axes of a slice")
    results = []
    for e in body.items if isinstance(body, ir.Tuple) else (body,):
        if not e.rank:
            results.append(slices.with_column(ir.to_column(e, env), 0))
            continue
        places = F.transform(F.col("items"), lambda r: F.struct(*(r.getField(f"j{k}").alias(f"j{k}") for k in range(len(others)))))
        frame = slices.frame.select("i0", F.explode(F.arrays_zip(places.alias("at"), ir.to_column(e, env).alias("v"))).alias("cell"))
        moved = iter(range(len(others)))
        columns = [F.col("i0").alias(f"k{k}") if k == axis else F.col(f"cell.at.j{next(moved)}").alias(f"k{k}") for k in range(rank)]
        results.append(Tensor(frame.select(*columns, F.col("cell.v").alias("v")), [f"k{k}" for k in range(rank)], F.col("v"), 0, tensors[0]._shape))
    return tuple(results) if isinstance(body, ir.Tuple) else results[0]


def _looped(e: ir.Expr, names: Sequence[str], tensors: Sequence[Tensor], dtype: types.ElementType) -> Column:
    """An expression without a column form, for batches of elements at once."""

    def run(*series: pd.Series) -> pd.Series:
        n = len(series[0])
        with np.errstate(all="ignore"):
            found = ir.evaluate(e, {k: x.to_numpy() for k, x in zip(names, series)}, n)
        return pd.Series(np.broadcast_to(found, n).astype(dtype.numpy))

    run.__annotations__ = {"series": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, dtype.spark)(*(t.column for t in tensors))


def _arrow(f: Callable, xs: Sequence, tensors: Sequence[Tensor], kwargs: dict, dtype: types.ElementType) -> Column:
    """``f`` applied to batches of elements."""
    plain = f.f if isinstance(f, Kernel) else f
    places = [None if isinstance(x, Tensor) else x for x in xs]
    kind = dtype.numpy

    def run(*series: pd.Series) -> pd.Series:
        at = iter(series)
        args = [next(at).to_numpy() if p is None else p for p in places]
        return pd.Series(np.vectorize(lambda *a: plain(*a, **kwargs), otypes=[kind])(*args) if len(series[0]) else np.zeros(0, kind))

    run.__annotations__ = {"series": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, dtype.spark)(*(t.column for t in tensors))


def map_op(name: str, *xs):
    """A named scalar operation over tensors and scalars."""
    return map(named(name), *xs)


# -- reduce


def monoid(f: Callable) -> str | None:
    """The aggregate that ``f`` of two arguments is, if it is one."""
    try:
        body = compile_kernel(f, [ir.Var("a"), ir.Var("b")])
    except (KernelError, TypeError):
        return None
    if isinstance(body, ir.Op) and body.name in MONOIDS and set(body.args) == {ir.Var("a"), ir.Var("b")}:
        return body.name
    return None


def _scalar(column: Column, frame: DataFrame) -> Tensor:
    return Tensor(frame.agg(column.alias("v")), (), F.col("v"), 0, ())


def _integral(x: Tensor) -> bool:
    return not x.dtype.is_float


def _aggregate(name: str, column: Column, whole: bool) -> Column:
    out = MONOIDS[name](column)
    return F.round(out).cast("long") if name == "mult" and whole else out


def reduce(f: Callable, *xs: Tensor, axis=None, init=None, fixed: Sequence = (), combine: Callable | None = None):
    """Fold all elements, or those along ``axis``, into one.

    Without ``init`` the fold starts with the first element. ``init`` is folded
    in once; on an empty input it is the result. A tuple of initial values makes
    several accumulators: ``f(*fixed, *accumulators, *elements)``. ``combine``
    merges accumulators and lets partitions be folded on their own; then the
    order of elements must not matter.
    """
    x = xs[0]
    axis = _normal_axis(axis, x.rank)
    name = monoid(f) if len(xs) == 1 and not fixed and not isinstance(init, tuple) else None
    if name:
        return _reduce_monoid(name, x, axis, init)
    if axis is not None and x.rank > 1:
        if len(xs) > 1 or fixed:
            raise ValueError("a fold along one axis takes one tensor")
        rows = x.rows(1 - axis)
        acc, item = ir.fresh("acc"), ir.fresh("x")
        body = compile_kernel(f, [ir.Var(acc), ir.Var(item)])
        start = None if init is None else ir.Const(init)
        return rows.with_column(ir.to_column(ir.ArrayReduce(acc, item, body, ir.Var("x", 1), start), {"x": rows.column}), 0)
    if isinstance(init, tuple) and (names := _independent(f, len(xs), init, fixed)):
        return _reduce_independent(names, [t.long() for t in align(xs)], init)
    if combine is not None:
        return _reduce_partitions(f, [t.long() for t in align(xs)], init, fixed, combine)
    return _reduce_ordered(f, [t.long() for t in xs], init, fixed)


def _reduce_monoid(name: str, x: Tensor, axis: int | None, init) -> Tensor:
    whole = _integral(x)

    def started(c: Column) -> Column:
        return c if init is None else F.coalesce(ir.SCALAR[name](F.lit(init), c), F.lit(init))

    if axis is None or x.rank == 1:
        if x.inner:
            acc, item = ir.fresh("acc"), ir.fresh("x")
            fold = ir.ArrayReduce(acc, item, ir.Op(name, (ir.Var(acc), ir.Var(item))), ir.Var("x", 1), None)
            wide = F.transform(x.column, lambda v: v.cast("long")) if whole and name in ("add", "mult") else x.column
            return _scalar(started(_aggregate(name, ir.to_column(fold, {"x": wide}), whole)), x.frame)
        return _scalar(started(_aggregate(name, x.column, whole)), x.frame)
    if x.inner and axis == x.rank - 1:
        acc, item = ir.fresh("acc"), ir.fresh("x")
        fold = ir.ArrayReduce(acc, item, ir.Op(name, (ir.Var(acc), ir.Var(item))), ir.Var("x", 1), None)
        wide = F.transform(x.column, lambda v: v.cast("long")) if whole and name in ("add", "mult") else x.column
        return x.with_column(started(ir.to_column(fold, {"x": wide})), 0)
    x = x.long()
    keep = [c for k, c in enumerate(x.index) if k != axis]
    frame = x.frame.groupBy(*(F.col(c).alias(f"i{k}") for k, c in enumerate(keep))).agg(started(_aggregate(name, x.column, whole)).alias("v"))
    return Tensor(frame, [f"i{k}" for k in range(len(keep))], F.col("v"))


def _independent(f: Callable, n: int, init: tuple, fixed: Sequence) -> list[tuple[str, ir.Expr]] | None:
    """For each accumulator its aggregate and what of the elements it takes, if each is a known fold of its own."""
    if fixed:
        return None
    accs, elements = [ir.Var(f"acc{k}") for k in range(len(init))], [ir.Var(f"e{k}") for k in range(n)]
    try:
        body = compile_kernel(f, [*accs, *elements])
    except (KernelError, TypeError):
        return None
    if not isinstance(body, ir.Tuple) or len(body.items) != len(init):
        return None
    out = []
    for acc, e in zip(accs, body.items):
        if not isinstance(e, ir.Op) or e.name not in MONOIDS or acc not in e.args:
            return None
        (value,) = [a for k, a in enumerate(e.args) if k != e.args.index(acc)]
        if any(a.name in ir.variables(value) for a in accs):
            return None
        out.append((e.name, value))
    return out


def _reduce_independent(folds: list[tuple[str, ir.Expr]], xs: Sequence[Tensor], init: tuple):
    """Several known folds in one aggregation."""
    env = {f"e{k}": x.column for k, x in enumerate(xs)}
    columns = []
    for k, ((name, value), start) in enumerate(zip(folds, init)):
        kind = "boolean" if isinstance(start, bool) else "bigint" if isinstance(start, (int, np.integer)) and not any(x.dtype.is_float for x in xs) else "double"
        folded = _aggregate(name, ir.to_column(value, env).cast(kind), kind == "bigint")
        columns.append(F.coalesce(ir.SCALAR[name](F.lit(start).cast(kind), folded), F.lit(start).cast(kind)).alias(f"acc{k}"))
    frame = xs[0].frame.agg(*columns)
    return tuple(Tensor(frame, (), F.col(f"acc{k}"), 0, ()) for k in range(len(init)))


def _reduce_ordered(f: Callable, xs: Sequence[Tensor], init, fixed: Sequence):
    """One row holds the elements in order of position; for folds that nothing else is known of."""
    xs = align(xs)
    xs, closure, env = _with_fixed(list(xs), fixed)
    xs[0]._positions()
    n = len(xs)
    many = isinstance(init, tuple)
    starts = list(init) if many else [] if init is None else [init]
    kind = "double" if any(x.dtype.is_float for x in xs) or any(isinstance(v, (float, np.floating)) for v in starts) else "bigint"
    if all(x.dtype is types.BOOL for x in xs) and all(isinstance(v, bool) for v in starts):
        kind = "boolean"
    items = F.struct(*(F.col(c).alias(f"i{k}") for k, c in enumerate(xs[0].index)), *(x.column.cast(kind).alias(f"e{k}") for k, x in enumerate(xs)))
    sides = {k: f"__env_{k}" for k in env}
    row = xs[0].frame.agg(F.array_sort(F.collect_list(items)).alias("items"), *(F.first(c).alias(sides[k]) for k, c in env.items()))
    if init is None and n != 1:
        raise ValueError("several tensors need initial values")
    accs = [f"acc{k}" for k in range(max(1, len(starts)))]
    elements = [f"e{k}" for k in range(n)]
    body = compile_kernel(f, [*closure, *(ir.Var(a) for a in accs), *(ir.Var(e) for e in elements)])
    bodies = body.items if isinstance(body, ir.Tuple) else (body,)
    if len(bodies) != len(accs):
        raise ValueError(f"{len(bodies)} results for {len(accs)} accumulators")
    side = {k: F.col(c) for k, c in sides.items()}
    whole = [isinstance(v, (int, np.integer)) and not isinstance(v, bool) and kind == "double" and len(starts) > 1 for v in starts] or [False]
    kinds = [kind if not w else "double" for w in whole]

    def step(a: Column, r: Column) -> Column:
        scope = side | {e: r.getField(e) for e in elements} | {c: a.getField(c) for c in accs}
        return F.struct(*(ir.to_column(b, scope).cast(k).alias(c) for b, k, c in zip(bodies, kinds, accs)))

    items = F.col("items")
    if init is None:
        first = F.struct(F.get(items, F.lit(0)).getField("e0").alias("acc0"))
        folded = F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), first, step)
    else:
        first = F.struct(*(F.lit(v).cast(k).alias(c) for v, k, c in zip(starts, kinds, accs)))
        folded = F.aggregate(items, first, step)
    frame = row.select(folded.alias("folded"))
    out = tuple(Tensor(frame, (), F.col(f"folded.{c}"), 0, ()) for c in accs)
    return out if many else out[0]


def _reduce_partitions(f: Callable, xs: Sequence[Tensor], init, fixed: Sequence, combine: Callable):
    """Fold every partition from ``init`` where it lies, then merge the partitions' results."""
    if init is None:
        raise ValueError("combine needs a neutral init")
    many = isinstance(init, tuple)
    starts = init if many else (init,)
    plain, merge = (g.f if isinstance(g, Kernel) else g for g in (f, combine))
    kinds = ["double" if isinstance(v, float) or any(x.dtype.is_float for x in xs) else "boolean" if isinstance(v, bool) else "bigint" for v in starts]
    schema = ", ".join(f"acc{k} {t}" for k, t in enumerate(kinds))
    closure = tuple(fixed)

    def packed(accs) -> pd.DataFrame:
        return pd.DataFrame([accs], columns=[f"acc{k}" for k in range(len(accs))])

    def as_tuple(v) -> tuple:
        return tuple(v) if many else (v,)

    names = [f"acc{k}" for k in range(len(starts))], [f"e{k}" for k in range(len(xs))]
    try:
        body = compile_kernel(f, [*closure, *(ir.Var(k) for part in names for k in part)])
        bodies = body.items if isinstance(body, ir.Tuple) else (body,)
    except (KernelError, TypeError):
        bodies = None

    def lanes(batch: pd.DataFrame, accs: list[np.ndarray]) -> list[np.ndarray]:
        """Folds of a batch in as many lanes, which ``combine`` merges in the end."""
        columns = [batch[c].to_numpy() for c in batch.columns]
        for at in range(0, len(batch), FOLD_LANES):
            n = min(FOLD_LANES, len(batch) - at)
            env = {k: a[:n] for k, a in zip(names[0], accs)} | {k: c[at : at + n] for k, c in zip(names[1], columns)}
            with np.errstate(all="ignore"):
                new = [np.broadcast_to(ir.evaluate(e, env, n), n) for e in bodies]
            accs = [np.concatenate([v.astype(a.dtype), a[n:]]) for v, a in zip(new, accs)]
        return accs

    def fold(batches):
        if bodies is not None:
            accs = [np.full(FOLD_LANES, v, {"double": float, "boolean": bool, "bigint": np.int64}[k]) for v, k in zip(starts, kinds)]
            for b in batches:
                accs = lanes(b, accs)
            rows = zip(*(a.tolist() for a in accs))
            total = next(rows)
            for row in rows:
                total = as_tuple(merge(*total, *row))
            yield packed(total)
            return
        accs, seen = starts, False
        for b in batches:
            for row in b.itertuples(index=False):
                accs, seen = as_tuple(plain(*closure, *accs, *row)), True
        if seen:
            yield packed(accs)

    def join(batches):
        accs = None
        for b in batches:
            for row in b.itertuples(index=False):
                accs = tuple(row) if accs is None else as_tuple(merge(*accs, *row))
        yield packed(starts if accs is None else accs)

    frame = xs[0].frame.select(*(x.column.alias(f"e{k}") for k, x in enumerate(xs)))
    merged = frame.mapInPandas(fold, schema).coalesce(1).mapInPandas(join, schema)  # one row a partition
    out = tuple(Tensor(merged, (), F.col(f"acc{k}"), 0, ()) for k in range(len(starts)))
    return out if many else out[0]


# -- scan


def scan(f: Callable, *xs: Tensor, axis=None, init=None, fixed: Sequence = ()):
    """Running results of the fold, inclusive: as many as elements. ``init`` goes before the first.

    Several tensors, ``fixed`` arguments or a tuple of initial values are as in
    ``reduce``: ``f(*fixed, *accumulators, *elements)``, a tensor for each accumulator.
    """
    if len(xs) > 1 or fixed or isinstance(init, tuple):
        return _scan_many(f, [x.long() for x in xs], axis, init, fixed)
    return _scan_one(f, xs[0], axis, init)


def _scan_many(f: Callable, xs: Sequence[Tensor], axis, init, fixed: Sequence):
    """Scans in order of position: one row holds the elements that are scanned together, those along ``axis``."""
    xs = align(xs)
    rank = len(xs[0]._positions())
    axis = _normal_axis(0 if axis is None else axis, rank)
    axis = 0 if axis is None else axis
    many = isinstance(init, tuple)
    if init is None and len(xs) > 1:
        raise ValueError("several tensors need initial values")
    if many and (folds := _independent(f, len(xs), init, fixed)):
        env = {f"e{k}": x.column for k, x in enumerate(xs)}
        return tuple(_scan_one(named(name), xs[0].with_column(ir.to_column(value, env), 0), axis, start) for (name, value), start in zip(folds, init))
    xs, closure, env = _with_fixed(list(xs), fixed)
    index = xs[0].index
    starts = list(init) if many else [] if init is None else [init]
    accs, elements = [f"acc{k}" for k in range(max(1, len(starts)))], [f"e{k}" for k in range(len(xs))]
    body = compile_kernel(f, [*closure, *(ir.Var(a) for a in accs), *(ir.Var(e) for e in elements)])
    bodies = body.items if isinstance(body, ir.Tuple) else (body,)
    if len(bodies) != len(accs):
        raise ValueError(f"{len(bodies)} results for {len(accs)} accumulators")
    kind = "double" if any(x.dtype.is_float for x in xs) or any(isinstance(v, (float, np.floating)) for v in starts) else "bigint"
    others = [c for k, c in enumerate(index) if k != axis]
    keys = [F.col(c).alias(f"g{k}") for k, c in enumerate(others)]
    items = F.array_sort(F.collect_list(F.struct(F.col(index[axis]).alias("at"), *(x.column.cast(kind).alias(e) for x, e in zip(xs, elements)))))
    sides = {k: f"__env_{k}" for k in env}
    rows = xs[0].frame.groupBy(*keys).agg(items.alias("items"), *(F.first(c).alias(sides[k]) for k, c in env.items()))
    side = {k: F.col(c) for k, c in sides.items()}

    def step(done: Column, r: Column) -> Column:
        before = {a: F.element_at(done, -1).getField(a) for a in accs}
        scope = side | {e: r.getField(e) for e in elements}
        after = F.struct(r.getField("at").cast("long").alias("at"), *(ir.to_column(b, scope | before).cast(kind).alias(a) for b, a in zip(bodies, accs)))
        return F.concat(done, F.array(after))

    items = F.col("items")
    first = F.get(items, F.lit(0))
    if init is None:
        start = F.struct(first.getField("at").cast("long").alias("at"), first.getField("e0").cast(kind).alias("acc0"))
        rest = F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))
    else:
        start, rest = F.struct(F.lit(-1).cast("long").alias("at"), *(F.lit(v).cast(kind).alias(a) for v, a in zip(starts, accs))), items
    found = rows.select(*(f"g{k}" for k in range(len(others))), F.explode(F.aggregate(rest, F.array(start), step)).alias("r"))
    found = found.where("r.at >= 0") if init is not None else found
    moved = iter(range(len(others)))
    columns = [F.col("r.at").alias(f"k{k}") if k == axis else F.col(f"g{next(moved)}").alias(f"k{k}") for k in range(rank)]
    frame = found.select(*columns, *(F.col(f"r.{a}").alias(a) for a in accs))
    out = tuple(Tensor(frame, [f"k{k}" for k in range(rank)], F.col(a), 0, xs[0]._shape) for a in accs)
    return out if many else out[0]


def _scan_one(f: Callable, x: Tensor, axis=None, init=None):
    axis = _normal_axis(0 if axis is None else axis, x.rank)
    name = monoid(f)
    if x.rank > 2:
        raise ValueError("scan of at most two axes")
    if name is None:
        acc, item = ir.fresh("acc"), ir.fresh("x")
        body = compile_kernel(f, [ir.Var(acc), ir.Var(item)])
        start = None if init is None else ir.Const(init)
        if x.rank == 2:
            rows = x.rows(1 - axis)
            out = rows.with_column(ir.to_column(ir.ArrayScan(acc, item, body, ir.Var("x", 1), start), {"x": rows.column}))
            return out if axis == 1 else out.long().T
        cell = x.cell().select(F.posexplode(ir.to_column(ir.ArrayScan(acc, item, body, ir.Var("x", 1), start), {"x": F.col("cell")})).alias("i0", "v"))
        return Tensor(cell.withColumn("i0", F.col("i0").cast("long")), ("i0",), F.col("v"))
    x = x.long()
    x._positions()
    whole = _integral(x)
    others = [c for k, c in enumerate(x.index) if k != axis]
    names = x.names()
    along = names[axis]
    frame = x.df()
    value = F.col("v")

    def started(c: Column) -> Column:
        return c if init is None else ir.SCALAR[name](F.lit(init), c)

    def running(by: list, column: Column) -> Column:
        return _aggregate(name, column, False).over(Window.partitionBy(*by).orderBy(along).rowsBetween(Window.unboundedPreceding, 0))

    if others:
        out = started(running([n for n in names if n != along], value))
    else:
        # totals of blocks of positions first, so that no task scans all
        block = F.floor(F.col(along) / SCAN_BLOCK)
        frame = frame.withColumn("__block", block)
        totals = frame.groupBy("__block").agg(_aggregate(name, value, False).alias("__total"))
        before = _aggregate(name, F.col("__total"), False).over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
        frame = frame.join(totals.select("__block", before.alias("__before")), "__block")
        here = running(["__block"], value)
        out = started(F.when(F.col("__before").isNull(), here).otherwise(ir.SCALAR[name](F.col("__before"), here)))
    if name == "mult" and whole:
        out = F.round(out).cast("long")
    frame = frame.select(*names, out.alias("v"))
    return Tensor(frame, names, F.col("v"), 0, x._shape)


# -- allpairs


def allpairs(f: Callable, x: Tensor, y: Tensor, fixed: Sequence = (), axis: int = 0) -> Tensor:
    """``f`` of every element (row, of matrices) of ``x`` with every one of ``y``; the pairs are the result."""
    if axis not in (0, 1) or axis and max(x.rank, y.rank) < 2:
        raise ValueError("allpairs along axis 0, or 1 of matrices")
    if max(x.rank, y.rank) > 2:
        raise ValueError("allpairs of vectors and matrices only")
    left, right = (t.rows(axis) if t.rank == 2 else t for t in (x, y))
    a = left.frame.select(F.col(left._positions()[0]).cast("long").alias("i0"), left.column.alias("x"))
    b = right.frame.select(F.col(right._positions()[0]).cast("long").alias("i1"), right.column.alias("y"))
    if left.inner and right.inner and not fixed:
        kind = ir.contraction(compile_kernel(f, [ir.Var("x", 1), ir.Var("y", 1)]), "x", "y")
        if kind and left.dtype == right.dtype and left.dtype.is_float:
            return _paired_blocks(a, b, kind, left.dtype)
    # the work is in the pairs, so few partitions of the left side would leave most cores idle
    both = Tensor(a.repartition("i0").crossJoin(b), ("i0", "i1"), F.col("x"))
    (both,), closure, env = _with_fixed([both], fixed)
    body = compile_kernel(f, [*closure, ir.Var("x", left.inner), ir.Var("y", right.inner)])
    return Tensor(both.frame, ("i0", "i1"), ir.to_column(body, env | {"x": F.col("x"), "y": F.col("y")}), body.rank)


#: Rows of each side that one matrix product takes.
PAIR_BLOCK = 256


def _paired_blocks(a: DataFrame, b: DataFrame, kind: str, dtype: types.ElementType) -> Tensor:
    """Inner products or squared distances of all rows: blocks of rows are paired, and each pair is one product in numpy.

    Each side is shuffled once. Tasks read a part of the left and one of the
    right side and pair their blocks, so that no pair of blocks is ever written.
    """
    parts = a.sparkSession.sparkContext.defaultParallelism

    def side(of: DataFrame, at: str, value: str) -> DataFrame:
        block = F.floor(F.col(at) / PAIR_BLOCK)
        return of.withColumn("block", block).repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct(at, value)).alias(value)).select(value)

    blocks = side(a, "i0", "x").crossJoin(side(b, "i1", "y").hint("shuffle_replicate_nl"))
    kind_of = np.dtype(dtype.numpy)
    schema = pa.schema([("i0", pa.int64()), ("i1", pa.int64()), ("v", pa.from_numpy_dtype(kind_of))])

    def matrix(rows) -> tuple[np.ndarray, np.ndarray]:
        at, values = rows.values.field(0), rows.values.field(1)
        return np.asarray(at), np.asarray(values.flatten()).reshape(len(at), -1)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                (i, x), (j, y) = matrix(batch.column(0)[k]), matrix(batch.column(1)[k])
                if x.shape[1] != y.shape[1]:
                    raise ValueError(f"rows of {x.shape[1]} and {y.shape[1]} elements")
                v = x @ y.T if kind == "dot" else np.stack([((row - y) ** 2).sum(axis=1) for row in x])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(i, len(j))), pa.array(np.tile(j, len(i))), pa.array(v.ravel().astype(kind_of))], schema=schema)

    return Tensor(blocks.mapInArrow(run, f"i0 long, i1 long, v {dtype.sql}"), ("i0", "i1"), F.col("v"))


def contract(x: Tensor, y: Tensor, body: Callable[[Column, Column], Column] | None = None) -> Tensor:
    """Sums over the inner axis of x[i, k] with y[k, j]: a join on k and an aggregation, without pairing rows."""
    x, y = x.long(), y.long()
    a = x.frame.select(F.col(x._positions()[0]).alias("i0"), F.col(x.index[1]).alias("k"), x.column.alias("x"))
    b = y.frame.select(F.col(y._positions()[0]).alias("k"), F.col(y.index[1]).alias("i1"), y.column.alias("y"))
    value = (body or (lambda p, q: p * q))(F.col("x"), F.col("y"))
    return Tensor(a.join(b, "k").groupBy("i0", "i1").agg(F.sum(value).alias("v")), ("i0", "i1"), F.col("v"))

