import math
import operator

import numpy as np
import pytest

from tessera import types
from tessera.functions import ir
from tessera.functions.kernel import KernelError, compile_kernel, kernel
from tessera.functions.library import ufunc
from tessera.functions import library as lib
from tessera.operators import adverbs, arrays
from tessera.operators.tensor import arange, from_numpy
from tessera.plans import programs

RNG = np.random.default_rng(0)
SCALE = 3


def early(x):
    if x > 5:
        return x * 2
    if x < 2:
        return -x
    return x


def branches(x, y=1.5):
    if x > y:
        a, b = x, y
    else:
        a, b = y, x
    a += b
    return a - 2 * b


def loops(x):
    total = 0
    for i in range(4):
        total = total + x * i
    n = 3
    while n > 0:
        total -= 1
        n -= 1
    return total


def nested(x):
    return early(x) + SCALE * math.sqrt(abs(x)) + np.pi


def chained(x):
    return 1.0 if 2 < x <= 6 and not x == 4 else 0.0


@pytest.mark.parametrize("f", [early, branches, loops, nested, chained, lambda x: (x % 3) ** 2 - x // 2, lambda x: min(x, 3, 7) + max(x, 2)])
def test_kernels_do_as_the_function(spark, f):
    x = np.arange(-3.0, 9.0)
    got = adverbs.map(f, from_numpy(spark, x)).numpy()
    np.testing.assert_allclose(got, [f(v) for v in x], atol=1e-9)


def test_globals_are_read_when_called(spark):
    global SCALE
    x = from_numpy(spark, np.array([4.0]))
    before = adverbs.map(lambda v: v * SCALE, x).numpy()[0]
    SCALE = 10
    assert (before, adverbs.map(lambda v: v * SCALE, x).numpy()[0]) == (12, 40)
    SCALE = 3


def test_array_kernels(spark):
    m = RNG.normal(size=(6, 5))
    x = from_numpy(spark, m)
    for f in (lambda r: sum(r * r), lambda r: np.mean(r), lambda r: r[2] + len(r), lambda r: np.argmin(r), lambda r: max(r) - min(r), lambda r: r[r > 0].sum() if any(r > 0) else 0.0, lambda r: np.sum(np.cumsum(r)), lambda r: sum(r[1:3])):
        np.testing.assert_allclose(adverbs.map(f, x, axis=0).numpy().astype(float), [f(r) for r in m], atol=1e-9)
    np.testing.assert_allclose(adverbs.map(lambda r: sum(r), x, axis=1).numpy(), m.sum(axis=0), atol=1e-9)

    def stored(r):
        r[1] = 9.0
        return r

    np.testing.assert_allclose(adverbs.map(stored, x, axis=0).numpy(), np.array([stored(r.copy()) for r in m]))


def test_what_cannot_be_compiled(spark):
    def endless(x):
        while x > 1:
            x = x / 2
        return x

    assert ir.has_loop(compile_kernel(endless, [ir.Var("x")]))
    x = np.array([5.0, 0.5, 64.0])
    np.testing.assert_allclose(adverbs.map(endless, from_numpy(spark, x)).numpy(), [endless(v) for v in x])

    def recursive(n):
        return recursive(n - 1)

    with pytest.raises(KernelError):
        compile_kernel(recursive, [ir.Var("x")])


def test_fusion_keeps_results_and_shortens(spark):
    def f(r):
        a = adverbs.map(lambda e: e * 2, r)
        b = adverbs.map(lambda e: e + 1, a)
        return adverbs.reduce(lambda s, e: s + e, b, init=0.0)

    m = RNG.normal(size=(4, 3))
    args = [ir.Var("x", 1)]
    plain, fused = compile_kernel(f, args, passes=()), compile_kernel(f, args)
    assert ir.explain(plain).count("ArrayMap") == 2 and ir.explain(fused).count("ArrayMap") == 0
    frame = from_numpy(spark, m).frame
    for e in (plain, fused):
        got = [r[0] for r in frame.orderBy("i0").select(ir.to_column(e, {"x": frame["v"]})).collect()]
        np.testing.assert_allclose(got, (m * 2 + 1).sum(axis=1))


def test_map(spark):
    m, v = RNG.normal(size=(4, 3)), RNG.normal(size=3)
    x, y = from_numpy(spark, m), from_numpy(spark, v)
    np.testing.assert_allclose((x + x).numpy(), m + m)
    np.testing.assert_allclose((x.long() * y).numpy(), m * v)
    np.testing.assert_allclose((1 - x.T).numpy(), 1 - m.T)
    lo, hi = adverbs.map(lambda a: (a - 1, a + 1), x)
    np.testing.assert_allclose(hi.numpy() - lo.numpy(), np.full_like(m, 2.0))
    np.testing.assert_allclose(adverbs.map(lambda w, r: sum(w * r), x, fixed=(y,), axis=0).numpy(), m @ v)
    with pytest.raises(ValueError):
        (from_numpy(spark, np.arange(3)) + from_numpy(spark, np.arange(4))).numpy()
    assert (from_numpy(spark, np.arange(3, dtype=np.int32)) * 2.0).dtype == types.FLOAT64
    a = kernel(lambda t, u: t * u + 1)
    np.testing.assert_allclose(a(y, y).numpy(), v * v + 1)
    assert a.call_original(2, 3) == 7


def test_map_of_vector_and_rows(spark):
    m, c = RNG.normal(size=(5, 3)), RNG.normal(size=5)
    got = adverbs.map(lambda r, s: sum(r) * s, from_numpy(spark, m), from_numpy(spark, c), axis=0).numpy()
    np.testing.assert_allclose(got, m.sum(axis=1) * c)


def test_reduce(spark):
    m = RNG.integers(0, 99, (13, 5))
    x = from_numpy(spark, m)
    for f, g in ((operator.add, np.sum), (min, np.min), (max, np.max)):
        assert adverbs.reduce(f, x).item() == g(m)
        for axis in (0, 1):
            assert adverbs.reduce(f, x, axis=axis).numpy().tolist() == g(m, axis=axis).tolist()
    v = from_numpy(spark, np.arange(1, 11))
    assert adverbs.reduce(lambda a, b: a - b, v).item() == 1 - sum(range(2, 11))
    assert adverbs.reduce(lambda a, b: 10 * a + b, v, init=0).item() == 1234567900
    assert adverbs.reduce(operator.add, v, init=5).item() == 60
    total, n = adverbs.reduce(lambda s, n, e: (s + e, n + 1), v, init=(0, 0))
    assert (total.item(), n.item()) == (55, 10)
    assert adverbs.reduce(lambda s, e: s + e, v, init=0, combine=lambda a, b: a + b).item() == 55
    assert adverbs.reduce(lambda k, s, e: s + k * e, v, init=0, fixed=(3,)).item() == 165
    empty = arrays.slice_(v, 0, 0)
    assert adverbs.reduce(operator.add, empty, init=7).item() == 7
    assert lib.all(empty > 0).item() is True and lib.any(empty > 0).item() is False
    assert lib.prod(v).item() == math.factorial(10)


def test_scan(spark, monkeypatch):
    monkeypatch.setattr(adverbs, "SCAN_BLOCK", 4)
    v = RNG.normal(size=23)
    x = from_numpy(spark, v)
    np.testing.assert_allclose(lib.cumsum(x).numpy(), np.cumsum(v))
    np.testing.assert_allclose(adverbs.scan(max, x).numpy(), np.maximum.accumulate(v))
    np.testing.assert_allclose(lib.cumprod(x).numpy(), np.cumprod(v))
    np.testing.assert_allclose(adverbs.scan(operator.add, x, init=2.0).numpy(), np.cumsum(v) + 2)
    decayed, want = 0.0, []
    for k, e in enumerate(v):
        decayed = e if not k else decayed * 0.5 + e
        want.append(decayed)
    np.testing.assert_allclose(adverbs.scan(lambda a, e: a * 0.5 + e, x).numpy(), want)
    m = np.array([[1, 2, 3], [4, 5, 6]])
    for axis in (0, 1):
        assert lib.cumsum(from_numpy(spark, m), axis).numpy().tolist() == np.cumsum(m, axis).tolist()
    add = ufunc("add")
    assert add.reduce(from_numpy(spark, m)).numpy().tolist() == [5, 7, 9]
    assert add.reduce(from_numpy(spark, m), 1).numpy().tolist() == [6, 15]
    assert add.accumulate(from_numpy(spark, m)).numpy().tolist() == [[1, 2, 3], [5, 7, 9]]
    assert adverbs.scan(operator.add, x).numpy()[-1] == pytest.approx(adverbs.reduce(operator.add, x).item())


def test_allpairs(spark):
    v = np.arange(16)
    x = from_numpy(spark, v)
    assert adverbs.allpairs(np.add, x, x).numpy().tolist() == np.add.outer(v, v).tolist()
    a, b = RNG.normal(size=(5, 4)), RNG.normal(size=(4, 3))
    p, q = from_numpy(spark, a), from_numpy(spark, b)
    np.testing.assert_allclose(adverbs.allpairs(np.dot, p, q.T.rows()).numpy(), a @ b)
    np.testing.assert_allclose(adverbs.allpairs(np.dot, p, p, axis=1).numpy(), a.T @ a)
    np.testing.assert_allclose(adverbs.allpairs(programs.sqdist, p, p).numpy(), ((a[:, None] - a) ** 2).sum(axis=2))
    np.testing.assert_allclose(lib.dot(p, q).numpy(), a @ b)
    left = adverbs.allpairs(lambda r, s: r, from_numpy(spark, a), from_numpy(spark, a))
    assert left.frame.count() == 25


def test_paired_blocks_are_not_shuffled(spark):
    a = np.arange(1200.0).reshape(600, 2)
    x = from_numpy(spark, a)
    pairs = adverbs.allpairs(programs.sqdist, x, x)
    plan = pairs.frame._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan[: plan.index("CartesianProduct")]
    np.testing.assert_allclose(pairs.numpy(), ((a[:, None] - a) ** 2).sum(axis=2))


def test_array_operators(spark):
    v = np.array([5, 3, 9, 3, 7, 1, 9, 2, 2, 4], np.int64)
    x = from_numpy(spark, v)
    assert x[3].item() == 3 and arrays.find(x, 9).item() == 2 and arrays.find(x, 100).item() is None
    assert x[from_numpy(spark, np.array([3, 5, 3]))].numpy().tolist() == v[[3, 5, 3]].tolist()
    assert x[x > 3].numpy().tolist() == v[v > 3].tolist()
    assert arrays.where(x == 9).numpy().tolist() == [2, 6]
    for s in (slice(2, 8, 3), slice(1, None, 2), slice(-4, -1), slice(0, 0)):
        assert x[s].numpy().tolist() == v[s].tolist()
    assert arrays.sort(x).numpy().tolist() == sorted(v.tolist())
    assert arrays.rotate(x, 3).numpy().tolist() == np.roll(v, 3).tolist()
    assert arrays.rotate(x, -12).numpy().tolist() == np.roll(v, -12).tolist()
    assert arrays.shift(x, 2, 0).numpy().tolist() == [0, 0, *v[:-2]]
    assert arrays.shift(x, -2, 0).numpy().tolist() == [*v[2:], 0, 0]
    assert (arrays.argmin(x).item(), arrays.argmax(x).item()) == (5, 2)
    assert arrays.set_index(x, 2, 8).numpy()[2] == 8 and x.numpy()[2] == 9
    assert arange(spark, 7).numpy().tolist() == list(range(7)) and arange(spark, 0).numpy().tolist() == []
    m = np.arange(12).reshape(3, 4)
    y = from_numpy(spark, m)
    assert y.shape == (3, 4) and len(y) == 3 and y.strides == (32, 8)
    assert y[1, 2].item() == 6 and y[1].numpy().tolist() == m[1].tolist()
    assert y.T.numpy().tolist() == m.T.tolist() and arrays.flatten(y).numpy().tolist() == list(range(12))
    assert arrays.argmin(y, 0).numpy().tolist() == [0] * 4 and arrays.argmax(y, 1).numpy().tolist() == [3] * 3
    assert lib.mean(y).item() == m.mean() and lib.mean(y, 0).numpy().tolist() == m.mean(axis=0).tolist()
    assert arrays.explode(x, 4).numpy().tolist() == [4] * 10 and arrays.copy(x) is x


def test_float_rules(spark):
    v = np.array([np.nan, 1.0, -1.0, 0.0, np.inf])
    x = from_numpy(spark, v)
    for op in (operator.eq, operator.ne, operator.lt, operator.ge):
        assert op(x, x).numpy().tolist() == op(v, v).tolist()
    with np.errstate(all="ignore"):
        np.testing.assert_array_equal(lib.unary("log", x).numpy(), np.log(v))
    half = from_numpy(spark, np.array([0.5, 1.5, 2.5, -2.7]))
    assert lib.unary("round", half).numpy().tolist() == [0, 2, 2, -3]
    ints = from_numpy(spark, np.array([-7, 7], np.int32))
    assert lib.div(ints, from_numpy(spark, np.array([2, 2], np.int32))).numpy().tolist() == [-3, 3]
    assert (ints % 3).numpy().tolist() == [2, 1] and lib.mod(ints, 3).numpy().tolist() == [-1, 1]
    assert types.common(types.FLOAT32, types.INT64) == types.FLOAT64


def test_programs(spark):
    def plain_cnd(x):
        return 0.5 * (1 + math.erf(x / math.sqrt(2)))

    v = np.linspace(-3, 3, 13)
    np.testing.assert_allclose(adverbs.map(programs.cnd, from_numpy(spark, v)).numpy(), [plain_cnd(e) for e in v], atol=1e-5)
    call = programs.black_scholes.call_original(True, 100.0, 95.0, 0.5, 0.02, 0.3)
    put = programs.black_scholes.call_original(False, 100.0, 95.0, 0.5, 0.02, 0.3)
    assert call - put == pytest.approx(100 - 95 * math.exp(-0.01), abs=1e-9)
    m = np.concatenate([RNG.normal(c, 0.1, (20, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    RNG.shuffle(m)
    centroids, labels, _ = programs.kmeans(from_numpy(spark, m), 3)
    got = labels.numpy()
    want = m[:3].copy()
    for _ in range(50):
        near = ((m[:, None] - want[None]) ** 2).sum(axis=2).argmin(axis=1)
        want = np.array([m[near == k].mean(axis=0) if (near == k).any() else want[k] for k in range(3)])
    assert got.tolist() == near.tolist()
    np.testing.assert_allclose(centroids, want, atol=1e-9)
    np.testing.assert_allclose(programs.dct_basis() @ programs.dct_basis().T, np.eye(64), atol=1e-12)
    assert programs.norm(from_numpy(spark, np.array([3.0, 4.0]))).item() == 5


def collatz(x, most=100):
    steps, n = 0, x
    while n > 1 and steps < most:
        if n % 2 == 0:
            n = n // 2
        else:
            n = 3 * n + 1
        steps += 1
    return steps


def test_loops_that_end_on_the_data(spark):
    x = np.arange(1, 40)
    got = adverbs.map(collatz, from_numpy(spark, x), dtype=types.INT64).numpy()
    assert got.tolist() == [collatz(v) for v in x.tolist()]
    got = adverbs.map(collatz, from_numpy(spark, x), dtype=types.INT64, most=5).numpy()
    assert got.tolist() == [collatz(v, 5) for v in x.tolist()]
    assert adverbs.map(collatz, from_numpy(spark, x[:0])).numpy().tolist() == []


def test_shared_parts_are_computed_once(spark):
    call, other = (from_numpy(spark, v) for v in (np.array([True, False] * 4), np.arange(1.0, 9.0)))
    price = adverbs.map(programs.black_scholes, call, other * 10, other * 11, other / 4, 0.02, 0.3)
    plan = price.frame.select(price.column)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("ln(") == 1 and plan.count("sqrt(") <= 2
    want = [programs.black_scholes.f(c, s * 10, s * 11, s / 4, 0.02, 0.3) for c, s in zip([True, False] * 4, range(1, 9))]
    np.testing.assert_allclose(price.numpy(), want, rtol=1e-9)


def test_shared_parts_stay_in_their_branch(spark):
    def safe(x):
        if x != 0:
            y = 10 / x
            return y * y + y
        return 0.0

    x = from_numpy(spark, np.array([0.0, 2.0, 5.0]))
    twice = adverbs.map(lambda v: (v * v + 1) * (v * v + 1) + safe(v), x)
    assert twice.numpy().tolist() == [1.0, 55.0, 682.0]
    # what is computed from a frame goes with what the frame had
    assert (twice + x).numpy().tolist() == [1.0, 57.0, 687.0] and (x - twice).numpy().tolist() == [-1.0, -53.0, -677.0]


def test_map_along_an_axis_of_three(spark):
    m = RNG.normal(size=(2, 3, 4))
    x = from_numpy(spark, m)
    for axis in range(3):
        rows = np.moveaxis(m, axis, 0).reshape(m.shape[axis], -1)
        np.testing.assert_allclose(adverbs.map(lambda r: sum(r), x, axis=axis).numpy(), rows.sum(axis=1))
        np.testing.assert_allclose(adverbs.map(lambda r: np.argmax(r), x, axis=axis).numpy(), rows.argmax(axis=1))
        np.testing.assert_allclose(adverbs.map(lambda r, k: r * k + 1, x, 3.0, axis=axis).numpy(), m * 3 + 1)
    with pytest.raises(ValueError):
        adverbs.map(lambda r: r[1], x, axis=0)


def test_scan_of_several(spark):
    x, y = RNG.normal(size=6), RNG.normal(size=6)
    a, b = from_numpy(spark, x), from_numpy(spark, y)
    total, most = adverbs.scan(lambda s, m, p, q: (s + p * q, max(m, p)), a, b, init=(0.0, -9.0))
    np.testing.assert_allclose(total.numpy(), np.cumsum(x * y))
    np.testing.assert_allclose(most.numpy(), np.maximum.accumulate(x))
    fading, last = adverbs.scan(lambda w, s, m, p, q: (s * w[0] + p, m * 0 + q), a, b, init=(0.0, 0.0), fixed=(np.array([0.5]),))
    want = []
    for v in x:
        want.append((want[-1] if want else 0.0) * 0.5 + v)
    np.testing.assert_allclose(fading.numpy(), want)
    np.testing.assert_allclose(last.numpy(), y)
    m = RNG.normal(size=(3, 4))
    for axis in (0, 1):
        found = adverbs.scan(lambda s, p, q: s * 0.5 + p - q, from_numpy(spark, m), from_numpy(spark, m * 2), axis=axis, init=1.0)
        state, want = np.ones(m.shape[1 - axis]), []
        for row in np.moveaxis(m, axis, 0):
            state = state * 0.5 - row
            want.append(state)
        np.testing.assert_allclose(found.numpy(), np.moveaxis(np.array(want), 0, axis))


def test_independent_folds_are_one_aggregate(spark):
    x = from_numpy(spark, np.array([3, 1, 4, 1, 5]))
    hi, lo, n = adverbs.reduce(lambda a, b, n, v: (max(a, v), min(b, v), n + 1), x, init=(0, 9, 0))
    assert [hi.item(), lo.item(), n.item()] == [5, 1, 5] and "collect_list" not in hi.frame._jdf.queryExecution().toString()
    hi, n = adverbs.reduce(lambda a, n, v: (max(a, n), n + v), x, init=(0, 0))  # not independent
    assert [hi.item(), n.item()] == [9, 14]
    norm = adverbs.reduce(lambda a, v: math.hypot(a, v), x * 1.0, init=0.0, combine=math.hypot)
    assert norm.item() == pytest.approx(np.sqrt(52))


def test_colours_there_and_back(spark):
    rgb = [from_numpy(spark, v) for v in RNG.uniform(0, 255, size=(3, 5))]
    for got, want in zip(programs.to_rgb(*programs.to_ycc(*rgb)), rgb):
        np.testing.assert_allclose(got.numpy(), want.numpy(), atol=1e-2)


def test_a_round_of_kmeans_is_one_job(spark):
    m = np.random.default_rng(4).normal(size=(400, 3)).astype(np.float32)
    points = from_numpy(spark, m)
    sc = spark.sparkContext
    sc.setJobGroup("kmeans rounds", "")
    _, labels, rounds = programs.kmeans(points, 4, start=m[:4].astype(float))
    jobs = len(sc.statusTracker().getJobIdsForGroup("kmeans rounds"))
    sc.setJobGroup("others", "")
    assert rounds > 3 and jobs <= rounds
    x = np.array([[0.0, 0], [1, 1], [np.nan, 1], [0.5, 0.5], [1e200, 0]])
    c = np.array([[0.0, 0], [1, 1], [1, 1]])
    with np.errstate(all="ignore"):
        assert programs.nearest_rows(x, c).tolist() == ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1).tolist()
        assert programs.nearest_rows(m.astype(float), c[:, [0, 1, 1]]).tolist() == ((m[:, None].astype(float) - c[:, [0, 1, 1]]) ** 2).sum(axis=2).argmin(axis=1).tolist()
