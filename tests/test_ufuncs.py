import numpy as np
import pytest

import latticeframe as lf
from compare import close, same
from latticeframe.functions import ufuncs as U

EDGES = np.array([0.0, -0.0, 1, -1, 0.5, -0.5, 2, -2, 2.5, -3.7, 1e-3, 40, -40, np.inf, -np.inf, np.nan])
INTS = np.array([0, 1, -1, 2, -2, 3, 7, -7, 12, 100, -100])


@pytest.fixture(scope="module")
def grid(spark):
    x, y = np.repeat(EDGES, len(EDGES)), np.tile(EDGES, len(EDGES))
    return x, y, lf.array(x, spark=spark).persist(), lf.array(y, spark=spark).persist()


@pytest.mark.parametrize("name", sorted(U.UNARY))
def test_unary(spark, name):
    f = getattr(np, name)
    with np.errstate(all="ignore"):
        x = EDGES[1:] if name == "signbit" else EDGES  # a stored -0.0 equals the cell that is not stored
        x = x[x != 0] if name in ("signbit", "reciprocal") else x
        assert close(np.asarray(f(lf.array(x, spark=spark)), float), np.asarray(f(x), float), rtol=1e-12, atol=1e-12, equal_nan=True)


@pytest.mark.parametrize("name", sorted(set(U.BINARY) - {"ldexp"}))
def test_binary(grid, name):
    x, y, tx, ty = grid
    f = getattr(np, name)
    with np.errstate(all="ignore"):
        want = np.asarray(f(x, y), float)
        got = np.asarray(f(tx, ty), float)
    # cells that are not stored are +0: leave out where the sign of a zero, or NaN and infinity times zero, matters
    skip = np.signbit(x) & (x == 0) | np.signbit(y) & (y == 0)
    if name in ("multiply",):
        skip |= ((x == 0) & ~np.isfinite(y)) | ((y == 0) & ~np.isfinite(x))
    if name == "floor_divide":
        skip |= ~np.isfinite(x) | ~np.isfinite(y)
    assert close(got[~skip], want[~skip], rtol=1e-12, atol=1e-12, equal_nan=True)


@pytest.mark.parametrize("name", sorted(U.INT_UNARY))
def test_int_unary(spark, name):
    f = getattr(np, name)
    assert same(np.asarray(f(lf.array(INTS, spark=spark))), f(INTS))


@pytest.mark.parametrize("name", sorted(set(U.INT_BINARY) - {"power", "left_shift", "right_shift"}))
def test_int_binary(spark, name):
    x, y = np.repeat(INTS, len(INTS)), np.tile(INTS, len(INTS))
    ok = y != 0 if name in ("floor_divide", "remainder", "fmod") else np.ones(len(y), bool)
    f = getattr(np, name)
    assert same(np.asarray(f(lf.array(x[ok], spark=spark), lf.array(y[ok], spark=spark))), f(x[ok], y[ok]))


def test_shifts_and_powers(spark):
    x = np.array([1, 5, 9])
    t = lf.array(x, spark=spark)
    assert same(t << 2, x << 2) and same(t >> 1, x >> 1) and same(t**3, x**3) and same(np.ldexp(t.astype(float), np.int32(3)), np.ldexp(x.astype(float), 3))
    with pytest.raises(Exception, match="negative"):
        np.asarray(np.power(t, -1))


@pytest.mark.parametrize("name", ["divmod", "modf", "frexp"])
def test_two_outputs(spark, name):
    x = np.array([7.5, -7.5, 0.25, -1.0, 12.0])
    args = [x, np.array([2.0, 2, -3, 4, 5])][: 2 if name == "divmod" else 1]
    for got, want in zip(getattr(np, name)(*(lf.array(a, spark=spark) for a in args)), getattr(np, name)(*args), strict=True):
        assert same(np.asarray(got), want)


@pytest.mark.parametrize("name", ["gcd", "lcm"])
def test_by_numpy(spark, name):
    x, y = np.array([4, 6, 9, 0]), np.array([6, 4, 3, 5])
    assert same(getattr(np, name)(lf.array(x, spark=spark), lf.array(y, spark=spark)), getattr(np, name)(x, y))


def test_spacing_nextafter(spark):
    x = np.array([1.0, -2.0, 1e10])
    t = lf.array(x, spark=spark)
    assert same(np.spacing(t), np.spacing(x)) and same(np.nextafter(t, np.inf), np.nextafter(x, np.inf))


def test_broadcast_outer_out(spark):
    x, y = np.arange(12.0).reshape(3, 4), np.arange(4.0)
    t, u = lf.array(x, spark=spark), lf.array(y, spark=spark)
    assert same(t + u, x + y) and same(t * x[:, :1], x * x[:, :1]) and same(np.subtract.outer(u, u), np.subtract.outer(y, y))
    target = lf.zeros((3, 4), spark=spark)
    np.add(t, u, out=target)
    assert same(target, x + y)
    t += 1.0
    assert same(t, x + 1)
    with pytest.raises(ValueError):
        t + lf.array(np.arange(5.0), spark=spark)
    assert same(lf.operate(lambda p: p * 3 + 1, lf.array(x, spark=spark)), x * 3 + 1)


def test_result_dtypes(spark):
    i, f = lf.array(np.arange(1, 4), spark=spark), lf.array(np.arange(1.0, 4), spark=spark)
    assert (i / i).dtype == float and (i > f).dtype == bool and (i + f).dtype == float and np.sqrt(i).dtype == float and (i + 1).dtype == int and (i * 0.5).dtype == float
