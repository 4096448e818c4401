"""Work goes by stored cells: products of any shapes, dense results, running sums and stretches, against NumPy."""

import numpy as np
import pytest

import latticeframe as lf
from latticeframe.operators import contract, reduction, tensor

Y = np.random.default_rng(3).integers(-3, 4, (23, 37)) * (np.random.default_rng(4).random((23, 37)) < 0.2) * 1.0


def plan(t) -> str:
    return t.df._jdf.queryExecution().optimizedPlan().toString()


def test_products_of_stored_cells_have_no_bound_on_shapes(spark):
    wide = lf.Tensor(spark.createDataFrame([(1 << 19, 1 << 18, 3.0), (5, 7, 2.0)], "d0 long, d1 long, v double"), lf.Meta((1 << 20, 1 << 19), float))
    five = lf.array(np.arange(5.0), spark=spark)
    want = sorted((i, j, k, v * k) for i, j, v in ((1 << 19, 1 << 18, 3.0), (5, 7, 2.0)) for k in range(1, 5))
    assert sorted(map(tuple, np.multiply.outer(wide, five).df.collect())) == want
    assert sorted(map(tuple, np.kron(wide, five).df.collect())) == [(i, j * 5 + k, v) for i, j, k, v in want]
    assert "strategy=broadcast" in plan(np.kron(wide, five))


def test_dense_shuffles_stored_cells_only(spark):
    t = lf.array(Y, spark=spark)
    full = t * 2.0 + 1.0
    assert "Join" not in plan(full) and full.df.count() == Y.size and np.array_equal(full.to_numpy(), Y * 2 + 1)
    assert np.array_equal(np.spacing(np.nextafter(t, np.inf)).to_numpy(), np.spacing(np.nextafter(Y, np.inf)))
    mask = (t >= 2).dense()
    assert mask.df.count() == Y.size and np.array_equal(mask.to_numpy(), Y >= 2)
    outside = lf.Tensor(spark.createDataFrame([(0, 1, 2.0), (9, 0, 1.0), (0, 4, 1.0), (None, 1, 1.0)], "d0 long, d1 long, v double"), lf.Meta((2, 3), float))
    assert sorted(map(tuple, outside.dense().df.collect())) == [(i, j, 2.0 * (i == 0 and j == 1)) for i in range(2) for j in range(3)]
    full[0, 0] = 7.0
    assert np.exp(full).to_numpy()[0, 0] == np.exp(7.0)
    z = Y * (1 + 2j)
    assert np.allclose(np.exp(lf.array(z, spark=spark)).to_numpy(), np.exp(z))


def test_dense_over_several_stretches(spark, monkeypatch):
    monkeypatch.setattr(tensor, "STRETCH", 5)
    monkeypatch.setattr(reduction, "STRETCH", 5)
    for y in (Y, Y.ravel(), np.zeros((3, 4)), np.ones((3, 7)), Y[:, :1]):
        t = lf.array(y, spark=spark)
        assert t.dense().df.count() == y.size and np.array_equal(t.dense().to_numpy(), y)
        assert np.array_equal(np.cumsum(t).to_numpy(), np.cumsum(y)) and np.array_equal(np.cumsum(t, axis=0).to_numpy(), np.cumsum(y, axis=0))


def test_running_sums_by_stored_cells(spark):
    for y in (Y, Y.astype(np.int64), Y > 0, Y * (1 + 2j)):
        t = lf.array(y, spark=spark)
        for axis in (None, 0, 1):
            got = np.cumsum(t, axis=axis)
            assert got.df.count() == y.size and got.dtype == np.cumsum(y, axis=axis).dtype and np.array_equal(got.to_numpy(), np.cumsum(y, axis=axis))
    assert "Join" not in plan(np.cumsum(lf.array(Y, spark=spark), axis=1))


@pytest.mark.parametrize("ufunc", [np.add, np.multiply, np.maximum, np.minimum])
@pytest.mark.parametrize("indices", [[0, 3, 8], [2, 30], [5, 1, 1]])
def test_reduceat_by_stored_cells(spark, ufunc, indices):
    for axis in (0, 1):
        got = ufunc.reduceat(lf.array(Y - (Y == 2) * 4, spark=spark), [i % 23 for i in indices], axis=axis)
        want = ufunc.reduceat(Y - (Y == 2) * 4, [i % 23 for i in indices], axis=axis)
        assert got.df.count() == want.size and np.array_equal(got.to_numpy(), want)


def test_short_contractions_go_by_lines(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(contract, "BUNDLE", 4)
    monkeypatch.setattr(contract, "MANY", 1)
    for density in (0.05, 0.6):
        a = rng.integers(-2, 3, (13, 3, 5)) * (rng.random((13, 3, 5)) < density) * 1.0
        b = rng.integers(-2, 3, (5, 11, 3)) * (rng.random((5, 11, 3)) < density) * 1.0
        got = np.tensordot(lf.array(a, spark=spark), lf.array(b, spark=spark), ([1, 2], [2, 0]))
        assert "MapInArrow" in plan(got) and np.array_equal(got.to_numpy(), np.tensordot(a, b, ([1, 2], [2, 0])))
        stored = np.tensordot(a != 0, b != 0, ([1, 2], [2, 0]))
        assert got.df.count() == np.count_nonzero(stored)
    a[0, 0, 0], b[0, 0, 0] = np.inf, 1.0
    got = np.tensordot(lf.array(a, spark=spark), lf.array(b, spark=spark), ([1, 2], [2, 0])).to_numpy()
    assert got[0, 0] == np.inf and np.isfinite(got).sum() + np.isinf(got).sum() == got.size
