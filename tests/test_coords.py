import itertools

import numpy as np
import pytest

import latticeframe as lf
from compare import same

RNG = np.random.default_rng(5)
X = RNG.integers(-3, 4, (3, 2, 5, 4)).astype(float)


@pytest.fixture(scope="module")
def x(spark):
    return lf.array(X, spark=spark).persist()


@pytest.mark.parametrize("axes", list(itertools.permutations(range(4))))
def test_transpose(x, axes):
    assert same(np.transpose(x, list(axes)), X.transpose(axes)) and same(x.transpose(*axes), X.transpose(axes))


def test_transpose_defaults(x):
    assert same(x.T, X.T) and same(np.transpose(x), X.T) and same(x.transpose(-2, 3, 0, 1), X.transpose(2, 3, 0, 1))


def test_transpose_rejects(x):
    for bad in [(0, 1), (0, 0, 1, 2), (0, 1, 2, 7)]:
        with pytest.raises((ValueError, np.exceptions.AxisError)):
            x.transpose(bad)


def factorisations(n, most):
    """All shapes of up to `most` dimensions over one with n elements, factors in any order."""
    if most == 1:
        return [(n,)]
    return [(n,)] + [(k, *rest) for k in range(2, n) if n % k == 0 for rest in factorisations(n // k, most - 1)]


SHAPES = factorisations(X.size, 3)


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("at", range(0, len(SHAPES), 3))
def test_reshape(x, at, order):
    shape = SHAPES[at]
    assert same(np.reshape(x, shape, order=order), X.reshape(shape, order=order))
    k = at % len(shape)
    guess, ones = (*shape[:k], -1, *shape[k + 1 :]), (*shape[:k], 1, *shape[k:])
    assert same(np.reshape(x, guess, order=order), X.reshape(guess, order=order)) and same(np.reshape(x, ones, order=order), X.reshape(ones, order=order))


def test_reshape_to_a_number(x):
    assert same(x.reshape(X.size), X.ravel()) and same(x.reshape(-1), X.ravel())


def test_reshape_rejects(x):
    for bad in [(-1, -1), (7, -1), (5, 5)]:
        with pytest.raises(ValueError):
            x.reshape(bad)


def test_reshape_inplace(spark):
    t = lf.array(X, spark=spark)
    assert lf.reshape(t, (8, 15), inplace=True) is t
    assert t.shape == (8, 15)


@pytest.mark.parametrize("key", [0, -1, (1, 0), np.s_[:, 0, 1:3], np.s_[::-1, :, ::2, 7:2:-2], np.s_[..., 3], np.s_[1, None, ..., 2:], np.s_[:, :, [3, 0, 3]], np.s_[[0, 1], :, [1, 2]], np.s_[0, 0, 3:1], np.s_[:, :, :, [-1, 2]]])
def test_getitem(x, key):
    assert same(x[key], X[key])


def test_mask(x):
    assert same(x[x > 0], X[X > 0])
    assert same(x[X < -1], X[X < -1])


def test_getitem_rejects(x):
    with pytest.raises(IndexError):
        x[3]
    with pytest.raises(IndexError):
        x[0, 0, 0, 0, 0]


@pytest.mark.parametrize("key,value", [(np.s_[0, 0, 1:, ::2], 7.0), (np.s_[..., 3], np.arange(5.0)), (np.s_[1, 0, 2, 3], -1.0), (np.s_[:, :, ::-1], np.arange(4.0)), (np.s_[:, 0, 0:0], 3.0)])
def test_setitem(spark, key, value):
    t, y = lf.array(X, spark=spark), X.copy()
    other = t.copy()
    t[key] = value
    y[key] = value
    assert same(t, y)
    assert same(other, X)


def test_set_mask(spark):
    t, y = lf.array(X, spark=spark), X.copy()
    t[X > 1] = 9.0
    y[X > 1] = 9.0
    assert same(t, y)


def test_split_stack_block(x):
    for a, b in zip(np.split(x, 4, axis=3), np.split(X, 4, axis=3), strict=True):
        assert same(a, b)
    for a, b in zip(np.split(x, [1, 3], axis=2), np.split(X, [1, 3], axis=2), strict=True):
        assert same(a, b)
    with pytest.raises(ValueError):
        np.split(x, 3, axis=3)
    for axis in (0, 2, -1):
        assert same(np.stack([x, x * 2.0], axis=axis), np.stack([X, X * 2], axis=axis))
    assert same(np.concatenate([x, x], axis=1), np.concatenate([X, X], axis=1))
    m, n = x[0, 0], X[0, 0]
    assert same(np.block([[m, m], [-m, m]]), np.block([[n, n], [-n, n]]))


@pytest.mark.parametrize("dtype", [int, np.int32, bool, np.float32, complex])
def test_astype(spark, dtype):
    y = np.array([0.0, -0.5, 1.7, -2.9, 3.0])
    got = np.asarray(lf.array(y, spark=spark).astype(dtype))
    assert got.dtype == np.dtype(dtype) and same(got, y.astype(dtype))


def test_repr_and_metadata_run_no_job(spark):
    t = lf.rand((1 << 40, 1 << 10), spark=spark)
    assert t.shape == (1 << 40, 1 << 10) and t.nbytes == 8 << 50 and "float64" in repr(t.T)
