"""Python functions compiled to expressions.

A kernel's source is parsed when it is first used and compiled for the ranks of
its arguments. Statements become one expression: branches turn into ``select``
(also with early returns), loops whose conditions are known are unrolled, and
calls of other Python functions are inlined. What can't be compiled raises
KernelError; adverbs then run the function itself over Arrow batches.
"""

from __future__ import annotations

import ast
import builtins
import inspect
import linecache
import math
import operator
import types as pytypes
from collections.abc import Callable

import numpy as np

from . import ir
from .ir import ArrayCall, ArrayFilter, ArrayMap, ArrayReduce, ArrayScan, Const, Expr, Var

MAX_UNROLLED = 10_000
MAX_DEPTH = 50


class KernelError(Exception):
    """The function can't be expressed as a column."""


class Kernel:
    """A function that the operators take; calling it with plain values runs the Python."""

    def __init__(self, f: Callable):
        self.f = f
        self.__name__ = getattr(f, "__name__", "kernel")
        self.__doc__ = f.__doc__

    def call_original(self, *args, **kwargs):
        return self.f(*args, **kwargs)

    def __call__(self, *args, **kwargs):
        from ..operators import adverbs
        from ..operators.tensor import Tensor

        if any(isinstance(a, Tensor) for a in (*args, *kwargs.values())):
            return adverbs.map(self, *args, **kwargs)
        return self.f(*args, **kwargs)

    def map(self, *xs, **kwargs):
        from ..operators import adverbs

        return adverbs.map(self, *xs, **kwargs)

    def reduce(self, *xs, **kwargs):
        from ..operators import adverbs

        return adverbs.reduce(self, *xs, **kwargs)

    def scan(self, *xs, **kwargs):
        from ..operators import adverbs

        return adverbs.scan(self, *xs, **kwargs)

    def allpairs(self, x, y, **kwargs):
        from ..operators import adverbs

        return adverbs.allpairs(self, x, y, **kwargs)


def kernel(f: Callable) -> Kernel:
    return f if isinstance(f, Kernel) else Kernel(f)


#: What replaces library functions, by identity.
_SCALAR: dict[object, str] = {
    operator.add: "add", operator.sub: "sub", operator.mul: "mult", operator.truediv: "truediv", operator.neg: "neg", operator.mod: "pymod", operator.and_: "and", operator.or_: "or",
    np.add: "add", np.subtract: "sub", np.multiply: "mult", np.divide: "truediv", np.mod: "pymod", np.fmod: "mod", np.power: "pow", np.minimum: "min", np.maximum: "max",
    np.logical_and: "and", np.logical_or: "or", np.logical_not: "not", np.equal: "eq", np.not_equal: "neq", np.less: "lt", np.less_equal: "lte", np.greater: "gt", np.greater_equal: "gte",
    np.negative: "neg", np.sqrt: "sqrt", np.sign: "sign", np.reciprocal: "reciprocal", np.abs: "abs", np.absolute: "abs", np.ceil: "ceil", np.floor: "floor", np.rint: "round", np.exp: "exp", np.exp2: "exp2",
    np.sin: "sin", np.cos: "cos", np.tan: "tan", np.sinh: "sinh", np.cosh: "cosh", np.tanh: "tanh", np.log: "log", np.log2: "log2", np.log10: "log10", np.where: "select",
    math.sqrt: "sqrt", math.exp: "exp", math.log: "log", math.pow: "pow", math.sin: "sin", math.cos: "cos", math.tan: "tan", math.sinh: "sinh", math.cosh: "cosh", math.tanh: "tanh",
    math.log2: "log2", math.log10: "log10", math.ceil: "ceil", math.floor: "floor", math.fabs: "abs", abs: "abs", math.hypot: "hypot", np.hypot: "hypot",
}
_NAMED: dict[str, Callable] = {}


def named(name: str) -> Callable:
    """A function that compiles to the scalar operation ``name``."""
    if name not in _NAMED:

        def f(*args):
            raise NotImplementedError(name)

        _NAMED[name] = f
        _SCALAR[f] = name
    return _NAMED[name]


_CASTS: dict[object, str] = {int: "int", float: "double", bool: "boolean", np.int8: "tinyint", np.int16: "smallint", np.int32: "int", np.int64: "bigint", np.float32: "float", np.float64: "double", np.bool_: "boolean"}
_BINARY = {ast.Add: "add", ast.Sub: "sub", ast.Mult: "mult", ast.Div: "truediv", ast.FloorDiv: "floordiv", ast.Mod: "pymod", ast.Pow: "pow", ast.BitAnd: "and", ast.BitOr: "or"}
_COMPARE = {ast.Eq: "eq", ast.NotEq: "neq", ast.Lt: "lt", ast.LtE: "lte", ast.Gt: "gt", ast.GtE: "gte"}
_UNARY = {ast.USub: "neg", ast.Not: "not", ast.Invert: "not"}


def _reduction(name: str, init: object, array: Expr) -> Expr:
    acc, item = ir.fresh("acc"), ir.fresh("x")
    return ArrayReduce(acc, item, ir.Op(name, (Var(acc), Var(item))), array, None if init is None else Const(init))


def _sum(x: Expr) -> Expr:
    return _reduction("add", None, x)


def _size(x: Expr) -> Expr:
    return ArrayCall("size", (x,))


#: Functions of one array.
_ARRAY: dict[object, Callable[[Expr], Expr]] = {
    sum: _sum, np.sum: _sum, np.prod: lambda x: _reduction("mult", None, x), len: _size, np.size: _size,
    np.mean: lambda x: ir.Op("truediv", (_sum(x), _size(x))), min: lambda x: ArrayCall("min", (x,)), max: lambda x: ArrayCall("max", (x,)), np.min: lambda x: ArrayCall("min", (x,)), np.max: lambda x: ArrayCall("max", (x,)),
    np.argmin: lambda x: ArrayCall("argmin", (x,)), np.argmax: lambda x: ArrayCall("argmax", (x,)), all: lambda x: ArrayCall("all", (x,)), any: lambda x: ArrayCall("any", (x,)), np.all: lambda x: ArrayCall("all", (x,)), np.any: lambda x: ArrayCall("any", (x,)),
    np.sort: lambda x: ArrayCall("sort", (x,)), sorted: lambda x: ArrayCall("sort", (x,)), np.cumsum: lambda x: ArrayScan((a := ir.fresh("acc")), (i := ir.fresh("x")), ir.Op("add", (Var(a), Var(i))), x, None), np.flatnonzero: lambda x: ArrayCall("where", (x,)),
}


_TREES: dict[str, tuple[int, ast.Module]] = {}


def _definition(f: Callable) -> ast.FunctionDef | ast.Lambda:
    """Where ``f`` is defined: by line, and among several lambdas of a line by the place of its code."""
    code = f.__code__
    lines = linecache.getlines(code.co_filename, f.__globals__)
    source = "".join(lines)
    cached = _TREES.get(code.co_filename)
    if cached is None or cached[0] != hash(source):
        try:
            cached = _TREES[code.co_filename] = hash(source), ast.parse(source)
        except SyntaxError as e:
            raise KernelError(f"the source of {f.__name__} can't be parsed") from e
    found = []
    for node in ast.walk(cached[1]):
        if isinstance(node, ast.FunctionDef) and node.name == f.__name__ and min([node.lineno, *(d.lineno for d in node.decorator_list)]) == code.co_firstlineno:
            found.append(node)
        elif isinstance(node, ast.Lambda) and f.__name__ == "<lambda>" and node.lineno <= code.co_firstlineno <= node.end_lineno:
            places = [p for p in code.co_positions() if p[0] is not None and p[2] is not None and p[1] is not None and p[3] is not None and (p[0], p[2]) != (p[1], p[3])]
            body = node.body
            if all((body.lineno, body.col_offset) <= (p[0], p[2]) and (p[1], p[3]) <= (body.end_lineno, body.end_col_offset) for p in places):
                found.append(node)
    if not found:
        raise KernelError(f"no source for {f.__name__}")
    return min(found, key=lambda n: (n.end_lineno - n.lineno, n.end_col_offset - n.col_offset))


class Compiler:
    def __init__(self, f: Callable, depth: int = 0):
        if depth > MAX_DEPTH:
            raise KernelError(f"{getattr(f, '__name__', f)} calls itself")
        self.f, self.depth = f, depth
        self.node = _definition(f)
        if self.node.args.vararg or self.node.args.kwarg:
            raise KernelError("*args and **kwargs are not supported")

    def run(self, args: tuple, kwargs: dict) -> object:
        try:
            bound = inspect.signature(self.f).bind(*args, **kwargs)
        except TypeError as e:
            raise TypeError(f"{self.f.__name__}: {e}") from e
        bound.apply_defaults()
        env = {k: _lift(v) for k, v in bound.arguments.items()}
        if isinstance(self.node, ast.Lambda):
            return self.expr(self.node.body, env)
        found = self.block(self.node.body, env)
        if found is None:
            raise KernelError(f"{self.f.__name__} may end without return")
        return found

    # statements: the value returned, or None if the block falls through (env is changed in place)

    def block(self, body: list[ast.stmt], env: dict) -> object:
        for k, s in enumerate(body):
            rest = body[k + 1 :]
            if isinstance(s, ast.Return):
                return self.expr(s.value, env) if s.value else _lift(None)
            if isinstance(s, ast.Assign):
                value = self.expr(s.value, env)
                for target in s.targets:
                    self.assign(target, value, env)
            elif isinstance(s, ast.AugAssign):
                self.assign(s.target, self.binary(s.op, self.expr(_load(s.target), env), self.expr(s.value, env)), env)
            elif isinstance(s, ast.AnnAssign) and s.value:
                self.assign(s.target, self.expr(s.value, env), env)
            elif isinstance(s, ast.If):
                test = ir.fold(_as_expr(self.expr(s.test, env)))
                if isinstance(test, Const):
                    return self.block([*(s.body if test.value else s.orelse), *rest], env)
                if _returns(s.body) or _returns(s.orelse):
                    yes, no = self.block([*s.body, *rest], dict(env)), self.block([*s.orelse, *rest], dict(env))
                    if yes is None or no is None:
                        raise KernelError("a branch may end without return")
                    return _merge(test, yes, no)
                yes_env, no_env = dict(env), dict(env)
                self.block(s.body, yes_env)
                self.block(s.orelse, no_env)
                for name in yes_env.keys() & no_env.keys():
                    env[name] = yes_env[name] if yes_env[name] is no_env[name] else _merge(test, yes_env[name], no_env[name])
            elif isinstance(s, ast.While):
                if s.orelse or _returns(s.body):
                    raise KernelError("while with else or return")
                for _ in range(MAX_UNROLLED):
                    test = ir.fold(_as_expr(self.expr(s.test, env)))
                    if not isinstance(test, Const):
                        self.loop(s, env)
                        break
                    if not test.value:
                        break
                    self.block(s.body, env)
                else:
                    raise KernelError("a loop of too many rounds")
            elif isinstance(s, ast.For):
                if _returns(s.body) or s.orelse:
                    raise KernelError("for with else or return")
                turns = self.host(s.iter, env)
                for value in turns:
                    self.assign(s.target, _lift(value), env)
                    self.block(s.body, env)
            elif isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) or isinstance(s, ast.Pass):
                continue
            else:
                raise KernelError(f"{type(s).__name__} statement")
        return None

    def loop(self, s: ast.While, env: dict) -> None:
        """A loop whose end depends on the data: its variables become those of an expression that is run over arrays."""
        stored = [n.id for x in s.body for n in ast.walk(x) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)]
        names = [n for n in dict.fromkeys(stored) if n in env]
        inits = tuple(_as_expr(env[n]) for n in names)
        if any(i.rank or isinstance(i, ir.Tuple) for i in inits):
            raise KernelError("a loop over arrays whose end depends on the data")
        variables = tuple(ir.fresh("loop") for _ in names)
        inside = env | {n: Var(v) for n, v in zip(names, variables)}
        test = _as_expr(self.expr(s.test, inside))
        self.block(s.body, inside)
        found = ir.Loop(variables, test, tuple(_as_expr(inside[n]) for n in names), inits)
        env.update((n, ir.LoopItem(found, k)) for k, n in enumerate(names))

    def host(self, node: ast.expr, env: dict) -> range:
        """A range whose bounds are known."""
        if isinstance(node, ast.Call) and self.resolve(node.func, env) is range:
            bounds = [ir.fold(_as_expr(self.expr(a, env))) for a in node.args]
            if all(isinstance(b, Const) for b in bounds):
                turns = range(*(b.value for b in bounds))
                if len(turns) <= MAX_UNROLLED:
                    return turns
        raise KernelError("for over something else than a known range")

    def assign(self, target: ast.expr, value: object, env: dict) -> None:
        if isinstance(target, ast.Name):
            env[target.id] = value
        elif isinstance(target, (ast.Tuple, ast.List)):
            items = value.items if isinstance(value, ir.Tuple) else value
            if not isinstance(items, (tuple, list)) or len(items) != len(target.elts):
                raise KernelError("unpacking something else than a tuple of that length")
            for t, v in zip(target.elts, items):
                self.assign(t, v, env)
        elif isinstance(target, ast.Subscript) and isinstance(target.value, ast.Name):
            array, at = _as_expr(env[target.value.id]), _as_expr(self.expr(target.slice, env))
            if not array.rank:
                raise KernelError("storing into a scalar")
            env[target.value.id] = _stored(array, at, _as_expr(value))
        else:
            raise KernelError("assignment to something else than a name or an element")

    # expressions

    def expr(self, node: ast.expr, env: dict) -> object:
        if isinstance(node, ast.Constant):
            return _lift(node.value)
        if isinstance(node, ast.Name):
            return env[node.id] if node.id in env else _lift(self.resolve(node, env))
        if isinstance(node, ast.BinOp):
            return self.binary(node.op, self.expr(node.left, env), self.expr(node.right, env))
        if isinstance(node, ast.UnaryOp):
            if isinstance(node.op, ast.UAdd):
                return self.expr(node.operand, env)
            return ir.op(_UNARY[type(node.op)], _as_expr(self.expr(node.operand, env)))
        if isinstance(node, ast.BoolOp):
            name, out = "and" if isinstance(node.op, ast.And) else "or", None
            for v in node.values:
                x = _as_expr(self.expr(v, env))
                out = x if out is None else ir.op(name, out, x)
            return out
        if isinstance(node, ast.Compare):
            left, out = self.expr(node.left, env), None
            for o, right in zip(node.ops, node.comparators):
                right = self.expr(right, env)
                if type(o) in (ast.Is, ast.IsNot) and isinstance(right, Const) and right.value is None:
                    one = Const((isinstance(left, Const) and left.value is None) == isinstance(o, ast.Is))
                elif type(o) in _COMPARE:
                    one = ir.op(_COMPARE[type(o)], _as_expr(left), _as_expr(right))
                else:
                    raise KernelError(f"{type(o).__name__} comparison")
                left, out = right, one if out is None else ir.op("and", out, one)
            return out
        if isinstance(node, ast.IfExp):
            test = ir.fold(_as_expr(self.expr(node.test, env)))
            if isinstance(test, Const):
                return self.expr(node.body if test.value else node.orelse, env)
            return _merge(test, self.expr(node.body, env), self.expr(node.orelse, env))
        if isinstance(node, (ast.Tuple, ast.List)):
            return ir.Tuple(tuple(_as_expr(self.expr(x, env)) for x in node.elts))
        if isinstance(node, ast.Call):
            return self.call(node, env)
        if isinstance(node, ast.Subscript):
            return self.subscript(_as_expr(self.expr(node.value, env)), node.slice, env)
        if isinstance(node, ast.Attribute):
            return self.attribute(node, env)
        if isinstance(node, ast.Lambda):
            return _Closure(self, node, dict(env))
        raise KernelError(f"{type(node).__name__} expression")

    def binary(self, o: ast.operator, a: object, b: object) -> Expr:
        if type(o) not in _BINARY:
            raise KernelError(f"{type(o).__name__} operator")
        return ir.op(_BINARY[type(o)], _as_expr(a), _as_expr(b))

    def attribute(self, node: ast.Attribute, env: dict) -> object:
        if isinstance(node.value, ast.Name) and node.value.id in env:
            x = _as_expr(env[node.value.id])
            if node.attr == "shape" and x.rank:
                return ir.Tuple((_size(x),))
            if node.attr == "T":
                return x
            raise KernelError(f"attribute {node.attr}")
        return _lift(self.resolve(node, env))

    def subscript(self, x: Expr, at: ast.expr, env: dict) -> object:
        if isinstance(x, ir.Tuple):
            i = ir.fold(_as_expr(self.expr(at, env)))
            if not isinstance(i, Const):
                raise KernelError("a tuple's item is not known")
            return x.items[i.value]
        if not x.rank:
            raise KernelError("indexing a scalar")
        if isinstance(at, ast.Slice):
            if at.step is not None:
                raise KernelError("slice with a step")
            lo = _as_expr(self.expr(at.lower, env)) if at.lower else Const(0)
            hi = _as_expr(self.expr(at.upper, env)) if at.upper else _size(x)
            return ArrayCall("slice", (x, lo, ir.op("sub", hi, lo)))
        i = _as_expr(self.expr(at, env))
        if not i.rank:
            return ArrayCall("get", (x, i))
        return ArrayFilter(x, i) if _is_mask(i) else ArrayCall("gather", (x, i))

    def resolve(self, node: ast.expr, env: dict) -> object:
        """A name's value at the time of the call, outside the function's own variables."""
        if isinstance(node, ast.Attribute):
            return getattr(self.resolve(node.value, env), node.attr)
        if not isinstance(node, ast.Name):
            raise KernelError(f"{type(node).__name__} as a function")
        if node.id in env:
            return env[node.id]
        closed = inspect.getclosurevars(self.f)
        for scope in (closed.nonlocals, self.f.__globals__, vars(builtins)):
            if node.id in scope:
                return scope[node.id]
        raise KernelError(f"name {node.id} is not defined")

    def call(self, node: ast.Call, env: dict) -> object:
        if isinstance(node.func, ast.Attribute):
            owner = node.func.value
            if isinstance(owner, ast.Name) and owner.id in env or not isinstance(owner, (ast.Name, ast.Attribute)):
                return self.method(_as_expr(self.expr(owner, env)), node.func.attr, node)
        f = self.resolve(node.func, env) if not isinstance(node.func, ast.Lambda) else self.expr(node.func, env)
        f = f.f if isinstance(f, Kernel) else f
        if isinstance(f, Const):
            f = f.value
        args = [self.expr(a, env) for a in node.args]
        kwargs = {k.arg: self.expr(k.value, env) for k in node.keywords}
        return self.apply(f, args, kwargs)

    def apply(self, f: object, args: list, kwargs: dict) -> object:
        from ..operators import adverbs

        if isinstance(f, Expr) and f.rank:  # an array may be called: x(i)
            return ArrayCall("get", (f, _as_expr(args[0])))
        if isinstance(f, Const):
            f = f.value
        if isinstance(f, _Closure):
            return f.owner.expr(f.node.body, f.env | dict(zip([a.arg for a in f.node.args.args], args)))
        if f in (adverbs.map, adverbs.reduce, adverbs.scan):
            return self.adverb(f.__name__, args, kwargs)
        hashable = getattr(f, "__hash__", None) is not None
        if hashable and f in _CASTS and len(args) == 1:
            return ir.cast(_as_expr(args[0]), _CASTS[f])
        if hashable and f in _ARRAY and len(args) == 1 and not kwargs:
            x = _as_expr(args[0])
            if x.rank:
                return _ARRAY[f](x)
        if f in (min, max) and len(args) > 1:
            out = _as_expr(args[0])
            for a in args[1:]:
                out = ir.op(f.__name__, out, _as_expr(a))
            return out
        if hashable and f in _SCALAR and not kwargs:
            return ir.op(_SCALAR[f], *map(_as_expr, args))
        if f is np.dot:
            return _sum(ir.op("mult", _as_expr(args[0]), _as_expr(args[1])))
        if f is np.arange:
            return ArrayCall("range", (_as_expr(args[0]),))
        if f is np.array:
            return ArrayCall("array", args[0].items if isinstance(args[0], ir.Tuple) else (_as_expr(args[0]),))
        if isinstance(f, pytypes.FunctionType):
            return Compiler(f, self.depth + 1).run(tuple(args), kwargs)
        raise KernelError(f"call of {getattr(f, '__name__', f)}")

    def method(self, x: Expr, name: str, node: ast.Call) -> object:
        known = {"sum": np.sum, "prod": np.prod, "mean": np.mean, "min": np.min, "max": np.max, "argmin": np.argmin, "argmax": np.argmax, "all": np.all, "any": np.any, "cumsum": np.cumsum}
        if name in ("copy", "flatten", "transpose") and not node.args:
            return x
        if name in known and not node.args:
            return _ARRAY[known[name]](x)
        raise KernelError(f"method {name}")

    def adverb(self, name: str, args: list, kwargs: dict) -> object:
        f, *arrays = args
        fixed = kwargs.pop("fixed", ())
        fixed = list(fixed.items) if isinstance(fixed, ir.Tuple) else list(fixed)
        init = kwargs.pop("init", None)
        if kwargs:
            raise KernelError(f"{', '.join(kwargs)} inside a kernel")
        arrays = [_as_expr(a) for a in arrays]
        if name == "map":
            names = [ir.fresh("e") for a in arrays if a.rank]
            at = iter(names)
            body = _as_expr(self.apply(f, [*fixed, *(Var(next(at)) if a.rank else a for a in arrays)], {}))
            return ArrayMap(tuple(names), body, tuple(a for a in arrays if a.rank))
        if len(arrays) != 1:
            raise KernelError(f"{name} of several arrays inside a kernel")
        acc, item = ir.fresh("acc"), ir.fresh("x")
        body = _as_expr(self.apply(f, [*fixed, Var(acc), Var(item)], {}))
        return (ArrayReduce if name == "reduce" else ArrayScan)(acc, item, body, arrays[0], None if init is None else _as_expr(init))


class _Closure:
    def __init__(self, owner: Compiler, node: ast.Lambda, env: dict):
        self.owner, self.node, self.env = owner, node, env


def _load(node: ast.expr) -> ast.expr:
    return ast.parse(ast.unparse(node), mode="eval").body


def _returns(body: list[ast.stmt]) -> bool:
    return any(isinstance(n, ast.Return) for s in body for n in ast.walk(s))


def _lift(value: object) -> object:
    if isinstance(value, np.generic):
        return Const(value.item())
    if value is None or isinstance(value, (bool, int, float)):
        return Const(value)
    if isinstance(value, (tuple, list)) and all(isinstance(v, (bool, int, float, np.generic, Expr)) for v in value):
        return ir.Tuple(tuple(_lift(v) for v in value))
    return value


def _as_expr(value: object) -> Expr:
    value = _lift(value)
    if not isinstance(value, Expr):
        raise KernelError(f"{type(value).__name__} as a value")
    return value


def _merge(test: Expr, yes: object, no: object) -> Expr:
    yes, no = _as_expr(yes), _as_expr(no)
    if isinstance(yes, ir.Tuple) != isinstance(no, ir.Tuple) or isinstance(yes, ir.Tuple) and len(yes.items) != len(no.items):
        raise KernelError("branches of different forms")
    if isinstance(yes, ir.Tuple):
        return ir.Tuple(tuple(_merge(test, a, b) for a, b in zip(yes.items, no.items)))
    if not test.rank:
        return ir.Op("select", (test, yes, no))
    return ir.op("select", test, yes, no)


def _is_mask(e: Expr) -> bool:
    if isinstance(e, ArrayMap):
        return isinstance(e.body, ir.Op) and e.body.name in ("eq", "neq", "lt", "lte", "gt", "gte", "and", "or", "not")
    return isinstance(e, Var) and e.name.startswith("mask")


def _stored(array: Expr, at: Expr, value: Expr) -> Expr:
    """The array with one element replaced."""
    x, i = ir.fresh("e"), ir.fresh("i")
    positions = ArrayCall("range", (_size(array),))
    return ArrayMap((x, i), ir.Op("select", (ir.Op("eq", (Var(i), at)), value, Var(x))), (array, positions))


def compile_kernel(f: Callable, args: list[object], kwargs: dict[str, object] | None = None, passes: tuple[str, ...] = ("fold", "fuse")) -> Expr:
    """The expression of ``f`` applied to expressions, tensors' variables or plain values."""
    f = f.f if isinstance(f, Kernel) else f
    if f in _SCALAR or f in _ARRAY or f in _CASTS or f in (np.dot, min, max):
        owner = Compiler.__new__(Compiler)
        owner.depth = 0
        out = owner.apply(f, list(args), dict(kwargs or {}))
    else:
        if not isinstance(f, pytypes.FunctionType):
            raise KernelError(f"{f} is no Python function")
        out = Compiler(f).run(tuple(args), dict(kwargs or {}))
    return ir.optimize(_as_expr(out), passes)
