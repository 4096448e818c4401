import numpy as np
import pytest

import latticeframe as lf
from compare import close, same

RNG = np.random.default_rng(7)
A, B = RNG.integers(-3, 4, (3, 4, 5)).astype(float), RNG.integers(-3, 4, (4, 5, 3)).astype(float)


@pytest.fixture(scope="module")
def a(spark):
    return lf.array(A, spark=spark)


@pytest.fixture(scope="module")
def b(spark):
    return lf.array(B, spark=spark)


@pytest.mark.parametrize("axes", [([1, 2], [0, 1]), ([0], [2]), (0, -1), ([-1, 1], [1, 0]), 0])
def test_tensordot(a, b, axes):
    assert same(np.tensordot(a, b, axes), np.tensordot(A, B, axes))


def test_tensordot_count(a):
    assert same(np.tensordot(a, a.transpose(1, 2, 0), 2), np.tensordot(A, A.transpose(1, 2, 0), 2))


def test_tensordot_rejects(a, b):
    with pytest.raises(ValueError):
        np.tensordot(a, b, ([0], [0]))
    with pytest.raises(ValueError):
        np.tensordot(a, b, ([1, 1], [0, 0]))


def test_tensordot_of_lists(a, b):
    for method in ("sequential", "commutative", "commutative-but-first"):
        assert same(lf.tensordot([a, a], [b, b * 2.0], ([1, 2], [0, 1]), method=method), 3 * np.tensordot(A, B, ([1, 2], [0, 1])))


def test_blocks_pair_by_coordinate(spark):
    """Axes in another order than memory, and an inner grid of several blocks with ragged ends."""
    p, q = RNG.standard_normal((5, 6, 7)), RNG.standard_normal((7, 6, 4))
    for axes in (([1, 2], [1, 0]), ([2, 1], [0, 1])):
        left, right = lf.to_blocks(lf.array(p, spark=spark), (2, 4, 3)), lf.to_blocks(lf.array(q, spark=spark), (3, 4, 3))
        out = lf.tensordot(left, right, axes)
        assert out.grid == (3, 2)
        assert close(out.to_numpy(), np.tensordot(p, q, axes)) and close(out.to_coo(), np.tensordot(p, q, axes))


def test_block_constructors(spark):
    block = np.ones((4, 8, 1))
    nested = [[[block, block], [block, block]], [[block, block], [block, block]]]
    objects = np.empty((2, 2, 2), object)
    for i in np.ndindex(2, 2, 2):
        objects[i] = block
    for t in (lf.BlockArray(nested, spark=spark), lf.BlockArray([block] * 8, grid=(2, 2, 2), spark=spark), lf.BlockArray(objects, spark=spark)):
        assert (t.grid, t.blockshape, t.shape, t.dtype, t.nblock) == ((2, 2, 2), (4, 8, 1), (8, 16, 2), np.float64, 8)
        assert same(t.to_numpy(), np.ones((8, 16, 2)))
    one = lf.BlockArray(block, spark=spark)
    assert one.grid == (1, 1, 1) and one.shape == one.blockshape
    ones = lf.BlockArray([np.ones((4, 1, 1))] * 8, grid=(2, 2, 2), spark=spark)
    out = np.tensordot(ones, ones, [(0, 1), (0, 2)])
    assert out.shape == (2, 2) and out.blockshape == (1, 1) and (out.to_numpy() == 16).all()
    assert ones[7, 1, 0] == 1 and same(ones.transpose((2, 0, 1)).to_numpy(), np.ones((2, 8, 2)))
    with pytest.raises(ValueError):
        lf.BlockArray([block, np.ones((1, 1, 1))], grid=(2, 1, 1), spark=spark)


@pytest.mark.parametrize("pattern", ["ijk->kij", "ijk->", "ijk->j", "ijk,jki->", "ijk,jki->ik", "ijk,jkl", "ijk,jkl->ilj", "ijk,jkl,lmn->im", "...k,jkl->...jl"])
def test_einsum(a, b, pattern):
    n = pattern.partition("->")[0].count(",") + 1
    left, right = [a, b, a][:n], [A, B, A][:n]
    assert close(np.einsum(pattern, *left), np.einsum(pattern, *right))


@pytest.mark.parametrize("pattern", ["ii", "ii->i", "iji->j", "ij,ji", "ii,i->"])
def test_einsum_repeated(spark, pattern):
    m, v, c = np.arange(9.0).reshape(3, 3), np.arange(3.0), np.arange(18.0).reshape(3, 2, 3)
    ops = {"iji->j": [c], "ii,i->": [m, v], "ij,ji": [m, m]}.get(pattern, [m])
    assert close(np.einsum(pattern, *(lf.array(x, spark=spark) for x in ops)), np.einsum(pattern, *ops))


def test_einsum_one_aggregate_per_step(spark):
    m = lf.rand((6, 6), spark=spark)
    plan = np.einsum("ij,jk,kl->il", m, m, m).df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2


def test_planner_prefers_cheap_orders():
    sizes = {"a": 1000, "b": 10, "c": 1000, "d": 10}
    steps = lf.planner.path(["ab", "bc", "cd"], "ad", sizes)
    assert lf.planner.total_cost(["ab", "bc", "cd"], "ad", sizes, steps)[0] == 200_000
    chain = [chr(97 + i) + chr(98 + i) for i in range(12)]
    assert len(lf.planner.path(chain, "am", {chr(97 + i): 4 for i in range(13)})) == 11
    assert lf.planner.slices(["ab", "bc", "cd"], "", {"a": 8, "b": 8, "c": 8, "d": 8}, 1 << 20) == []


def test_complex(spark):
    z = A + 1j * A[::-1]
    t = lf.array(z, spark=spark)
    assert close(np.einsum("ijk,ijl->kl", t, np.conj(t)), np.einsum("ijk,ijl->kl", z, z.conj()))
    for f in (np.abs, np.negative, np.square, np.exp):
        assert close(f(t), f(z))
    assert close(t * t - t / (2 + 1j), z * z - z / (2 + 1j)) and close(t.real, z.real) and close(t.imag, z.imag)
    assert close(lf.to_blocks(t, (2, 3, 2)).to_coo(), z)


def test_matmul_family(a, b, spark):
    m, v = A[0], A[0, 0]
    tm, tv = a[0], a[0, 0]
    assert same(tm @ tv, m @ v) and same(tv @ tm.T, v @ m.T) and same(a @ b.transpose(2, 1, 0), A @ B.transpose(2, 1, 0))
    assert same(np.dot(tm, tm.T), m @ m.T) and same(np.inner(tm, tm), np.inner(m, m)) and same(np.outer(tv, tv), np.outer(v, v))
    assert float(np.vdot(tm, tm)) == np.vdot(m, m) and same(np.kron(tm, tv), np.kron(m, v)) and float(np.trace(tm)) == np.trace(m)
    assert close(np.linalg.multi_dot([tm, tm.T, tm]), np.linalg.multi_dot([m, m.T, m]))
    s = np.array([[1.0, 2], [3, 4]])
    assert close(np.linalg.matrix_power(lf.array(s, spark=spark), 5), np.linalg.matrix_power(s, 5)) and close(np.linalg.matrix_power(lf.array(s, spark=spark), -2), np.linalg.matrix_power(s, -2))


def test_reductions(a):
    for name in ("sum", "prod", "max", "min", "mean", "var", "std", "any", "all"):
        for axis in (None, 0, (0, 2)):
            assert close(getattr(np, name)(a, axis=axis), getattr(np, name)(A, axis=axis)), (name, axis)
    assert same(np.sum(a, axis=1, keepdims=True), A.sum(1, keepdims=True))
    assert np.count_nonzero(a) == np.count_nonzero(A) and same(np.count_nonzero(a, axis=(0, 1)), np.count_nonzero(A, axis=(0, 1)))
    assert same(np.argmax(a, 1), A.argmax(1)) and same(a.argmin(), A.argmin())
    for f in (np.add, np.multiply, np.maximum, np.logical_or):
        assert close(f.reduce(a, axis=1), f.reduce(A, axis=1))
        assert close(f.accumulate(a, axis=2), f.accumulate(A, axis=2))
    for axis in (None, 0, -1):
        assert same(np.cumsum(a, axis=axis), np.cumsum(A, axis=axis))
    assert same(np.add.reduceat(a, [0, 3, 1], axis=1), np.add.reduceat(A, [0, 3, 1], axis=1))


def test_empty_groups_and_sparse(spark):
    z = np.zeros((3, 4))
    z[1, 2] = -5
    t = lf.array(z, spark=spark)
    for name in ("sum", "max", "min", "prod", "any", "all"):
        assert same(getattr(np, name)(t, axis=1), getattr(np, name)(z, axis=1)), name
    assert same(np.count_nonzero(t, axis=1), [0, 1, 0]) and float(t.sum()) == -5 and float(lf.zeros((2, 2), spark=spark).sum()) == 0


def test_scatter(spark):
    t, y = lf.zeros(5, spark=spark), np.zeros(5)
    np.add.at(t, [0, 1, 1, -1], np.array([1.0, 2, 3, 4]))
    np.add.at(y, [0, 1, 1, -1], np.array([1.0, 2, 3, 4]))
    assert same(t, y)


def test_linalg(spark):
    m = RNG.standard_normal((60, 4))
    t = lf.array(m, spark=spark)
    q, r = np.linalg.qr(t)
    assert close(q.to_numpy() @ r.to_numpy(), m) and close(q.to_numpy().T @ q.to_numpy(), np.eye(4)) and (np.diag(r.to_numpy()) >= 0).all()
    u, s, vh = np.linalg.svd(t, full_matrices=False)
    assert close(u.to_numpy() * s.to_numpy() @ vh.to_numpy(), m) and close(s, np.linalg.svd(m, compute_uv=False))
    u, s, vh = np.linalg.svd(t.T, full_matrices=False)
    assert close(u.to_numpy() * s.to_numpy() @ vh.to_numpy(), m.T)
    for mode in ("complete", "r", "raw"):
        out, ref = np.linalg.qr(t[:6], mode), np.linalg.qr(m[:6], mode)
        assert [x.shape for x in (out if isinstance(out, tuple) else (out,))] == [x.shape for x in (ref if isinstance(ref, tuple) else (ref,))]
    with pytest.raises(ValueError):
        np.linalg.qr(t, "other")
    y = RNG.standard_normal(60)
    assert close(np.linalg.lstsq(t, y)[0], np.linalg.lstsq(m, y, rcond=None)[0]) and close(np.linalg.pinv(t), np.linalg.pinv(m))
    k, sq = lf.array(m[:4], spark=spark), m[:4]
    for f in (np.linalg.inv, np.linalg.det, np.linalg.eigvals):
        assert close(f(k), f(sq))
    assert close(np.linalg.solve(k, y[:4]), np.linalg.solve(sq, y[:4])) and close(np.linalg.cholesky(k @ k.T), np.linalg.cholesky(sq @ sq.T))
    for o in (None, 1, -1, np.inf, 2, "nuc", "fro"):
        assert np.isclose(float(np.linalg.norm(k, o)), np.linalg.norm(sq, o)), o
    assert int(np.linalg.matrix_rank(k)) == 4 and np.isclose(float(np.linalg.cond(k)), np.linalg.cond(sq))
    low = np.outer(np.arange(6.0), np.arange(3.0))
    q, r = np.linalg.qr(lf.array(low, spark=spark))
    assert close(q.to_numpy() @ r.to_numpy(), low) and int(np.linalg.matrix_rank(lf.array(low, spark=spark))) == 1
    u, s, v = lf.schmidt(lf.array(A, spark=spark), [2], chi=2)
    assert u.shape == (3, 4, 2) and close(s, np.linalg.svd(A.reshape(12, 5))[1][:2])


def test_tsqr_levels(spark):
    from latticeframe.operators.linalg import tsqr

    m = RNG.standard_normal((400, 3)) + 1j * RNG.standard_normal((400, 3))
    _, r, _ = tsqr(lf.array(m, spark=spark), rows=4)
    ref = np.linalg.qr(m)[1]
    assert close(np.abs(r), np.abs(ref)) and close(r.conj().T @ r, m.conj().T @ m)


def test_sources(spark, tmp_path):
    assert same(lf.identity(3, spark=spark), np.eye(3)) and lf.zeros((2, 2), spark=spark).dtype == np.float64
    eye = np.zeros((7, 7))
    for i in range(3):
        for j in range(3):
            part = lf.identity_block((3, 3), 7, i, j, spark=spark).to_numpy()
            eye[3 * i : 3 * i + part.shape[0], 3 * j : 3 * j + part.shape[1]] = part
    assert same(eye, np.eye(7))
    assert same(lf.full((2, 3), 2j, spark=spark), np.full((2, 3), 2j)) and same(lf.array(5, spark=spark), 5)
    r = lf.rand((20, 20), seed=3, spark=spark)
    assert same(r, lf.rand((20, 20), seed=3, spark=spark)) and 0.4 < np.asarray(r).mean() < 0.6
    t = lf.array(A, spark=spark)
    for f in (np.zeros_like, np.ones_like, np.empty_like):
        assert f(t, dtype=int).dtype == int and f(t).shape == A.shape
    assert isinstance(np.full_like(t, 2, subok=False), np.ndarray)
    t.write(str(tmp_path / "t"))
    assert same(lf.read(str(tmp_path / "t"), spark), A)
    assert lf.array(np.zeros((0, 3)), spark=spark).to_numpy().shape == (0, 3)


def test_meta_helpers():
    from latticeframe.plans import meta

    assert meta.nest_level([[[1]]]) == 3 and meta.measure_shape([[1, 2], [3, 4]]) == (2, 2)
    assert meta.isunique((1, 2)) and not meta.isunique((1, 1))
    for shape in [(2,), (3, 1), (2, 2, 3)]:
        nested = np.zeros(shape).tolist()
        assert meta.nest_level(nested) == len(shape) and meta.measure_shape(nested) == shape
    with pytest.raises(ValueError):
        meta.measure_shape([[1], [2, 3]])


@pytest.mark.parametrize("m", [0, 3, 1000])
@pytest.mark.parametrize("n", [1, 17])
@pytest.mark.parametrize("k", [5, 4096])
def test_flops(m, n, k):
    a, b = lf.Meta((m, k), float), lf.Meta((k, n), float)
    assert lf.cost.flops.tensordot(a, b, ([1], [0])) == m * n * k
    assert lf.cost.mem.tensordot(a, b, ([1], [0])) == 8 * (m * k + k * n + m * n)


def test_circuit_and_mps(spark):
    """A brick of two-qubit gates and a matrix product overlap, through the planner."""
    h = np.array([[1, 1], [1, -1]]) / np.sqrt(2)
    cz = np.diag([1, 1, 1, -1]).reshape(2, 2, 2, 2)
    zero = np.array([1.0, 0])
    ops = [zero, zero, h, h, cz, h]
    pattern = "a,b,ca,db,efcd,gf->eg"
    assert close(np.einsum(pattern, *(lf.array(x.astype(np.complex64), spark=spark) for x in ops)), np.einsum(pattern, *ops))
    site = RNG.standard_normal((3, 4, 4))
    ops, pattern = [site[:, 0], site, site[:, :, 0], site[:, 0], site, site[:, :, 0]], "pa,qab,rb,pc,qcd,rd->"
    assert np.isclose(float(np.einsum(pattern, *(lf.array(x, spark=spark) for x in ops))), np.einsum(pattern, *ops))
