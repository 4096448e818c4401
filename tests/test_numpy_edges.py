"""Complex numbers, NaN, large and narrow integers, uneven parts: where a column of doubles would go wrong."""

import numpy as np
import pytest

import latticeframe as lf

RNG = np.random.default_rng(11)
Z = RNG.standard_normal((4, 5)) + 1j * RNG.standard_normal((4, 5))
Y = RNG.integers(1, 6, (3, 4)).astype(float)
NAN = np.array([3.0, np.nan, 1.0, 5.0, np.nan, 0.5])


def agrees(got, want):
    got = np.asarray(got)
    return got.dtype == want.dtype and got.shape == want.shape and np.allclose(got, want, equal_nan=True)


@pytest.mark.parametrize("axis", [None, 0, 1])
def test_complex_spread(spark, axis):
    t = lf.array(Z, spark=spark)
    assert agrees(np.var(t, axis=axis), np.asarray(Z.var(axis))) and agrees(np.std(t, axis=axis), np.asarray(Z.std(axis)))


def test_integer_power_is_exact(spark):
    base, power = np.array([3, -3, 2, 0, 1, -1, 0, 7]), np.array([39, 3, 62, 0, 90, 91, 5, 22])
    assert agrees(np.power(lf.array(base, spark=spark), lf.array(power, spark=spark)), base**power)
    with pytest.raises(Exception, match="negative integer powers"):
        np.asarray(np.power(lf.array(base, spark=spark), lf.array(-power, spark=spark)))


@pytest.mark.parametrize("ufunc", [np.minimum, np.maximum])
@pytest.mark.parametrize("copies", [1, 400])
def test_running_extremes_keep_nan(spark, ufunc, copies):
    long = np.concatenate([np.arange(copies, 0, -1.0), NAN, np.arange(copies)])
    assert agrees(ufunc.accumulate(lf.array(long, spark=spark)), ufunc.accumulate(long))


@pytest.mark.parametrize("dtype", [np.int8, np.uint8, np.int16, np.uint16, np.int32])
def test_integers_wrap_into_narrower_types(spark, dtype):
    wide = np.array([3_000_000_000, -5, 300, 2**31, -(2**31) - 1, 127, -128])
    assert agrees(lf.array(wide, spark=spark).astype(dtype), wide.astype(dtype))


def test_reals_out_of_range(spark):
    got = np.asarray(lf.array(np.array([3e9, -3e9, 5.7, np.nan, -2.9]), spark=spark).astype(np.int32))
    assert got.tolist() == [-(2**31), -(2**31), 5, -(2**31), -2]


@pytest.mark.parametrize("parts", [1, 3, 4, 12])
def test_uneven_parts(spark, parts):
    x = np.arange(10.0)
    for got, want in zip(np.array_split(lf.array(x, spark=spark), parts), np.array_split(x, parts), strict=True):
        assert agrees(got, want)


@pytest.mark.parametrize("ufunc", [np.subtract, np.divide, np.hypot, np.power, np.logaddexp, np.arctan2, np.fmod])
def test_other_functions_fold(spark, ufunc):
    t = lf.array(Y, spark=spark)
    assert agrees(ufunc.reduce(t, axis=1), ufunc.reduce(Y, axis=1)) and agrees(ufunc.accumulate(t, axis=0), ufunc.accumulate(Y, axis=0))
    assert agrees(ufunc.reduce(t, axis=0, keepdims=True), ufunc.reduce(Y, axis=0, keepdims=True))


def test_complex_products_fold(spark):
    assert agrees(np.multiply.reduce(lf.array(Z, spark=spark), axis=0), np.multiply.reduce(Z, axis=0))


def test_long_lines_run_in_blocks(spark):
    v = RNG.choice([1.0, -1.0, 1.001], 3000)
    assert agrees(np.cumprod(lf.array(v, spark=spark)), np.cumprod(v)) and agrees(np.cumsum(lf.array(v > 0, spark=spark)), np.cumsum(v > 0))
    z = np.tile(Z.ravel(), 60)
    assert agrees(np.cumsum(lf.array(z, spark=spark)), np.cumsum(z))


@pytest.mark.parametrize("at", [[0, 2], [1, 2, 3], [2, 1, 3], [3], [0, 0]])
def test_reduceat(spark, at):
    assert agrees(np.add.reduceat(lf.array(Y, spark=spark), at, axis=1), np.add.reduceat(Y, at, axis=1))


@pytest.mark.parametrize("ufunc", [np.negative, np.exp, np.sqrt])
def test_at_with_one_argument(spark, ufunc):
    want = np.array([1.0, 2.0, 3.0, 0.0])
    t = lf.array(want, spark=spark)
    ufunc.at(t, [0, 0, 1, 3])
    ufunc.at(want, [0, 0, 1, 3])
    assert agrees(t, want)


def test_blocks_take_ufuncs(spark):
    b = lf.to_blocks(lf.array(Y, spark=spark), (2, 3))
    sparse = lf.to_blocks(lf.identity(5, spark=spark), (2, 2))
    assert agrees((b * 2.0 + b).to_numpy(), Y * 3) and agrees(np.exp(sparse).to_numpy(), np.exp(np.eye(5)))
    other = lf.to_blocks(lf.array(Y, spark=spark), (1, 4))
    assert agrees(np.add(b, other).to_numpy(), Y * 2) and agrees((b > 2.0).to_numpy(), Y > 2)
    assert agrees(np.multiply(lf.to_blocks(lf.array(Z, spark=spark), (3, 2)), 1j).to_numpy(), Z * 1j)


def test_shape_setter_and_batched_cost(spark):
    t = lf.array(Y, spark=spark)
    t.shape = (2, -1)
    assert agrees(t, Y.reshape(2, 6))
    assert lf.cost.mem.qr(lf.Meta((5, 4, 3), float)) == 5 * lf.cost.mem.qr(lf.Meta((4, 3), float))


def test_large_operands_are_refused(spark):
    big = lf.zeros((1 << 14, 1 << 13), spark=spark)
    with pytest.raises(ValueError, match="too large"):
        np.linalg.solve(lf.identity(1 << 14, spark=spark), big)
    with pytest.raises(ValueError, match="too large"):
        np.add.outer(big, big)
