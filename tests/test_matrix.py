"""Matrices against NumPy."""

import math
import os

import numpy as np
import pytest

import tessella as t
from tessella.operators.array import REDUCERS, UFUNC_BINARY, UFUNC_UNARY, plan_json
from tessella.workflow import normalize, normalize_frame

INF, NAN = math.inf, math.nan
#: Where a function of ieee.py changes its rule or its result's kind, with both signs, and NaN.
BOUNDS = [0.0, 2.0**-60, 2.0**-40, 0.25, 0.75, 1.0, 1.5, 3.0, 750.0, INF]
EDGES = np.array([[*(-b for b in BOUNDS), NAN], [*BOUNDS, 2.5]])
LEFT = np.array([[0.0, -0.0, 1, -1, INF, -INF, NAN], [2, -2, 0, 3, 1, -1, 0.25]])
RIGHT = np.array([[0.0, 1, -0.0, INF, -INF, 2, 3], [NAN, -1, -3, 0, NAN, INF, -0.0]])


def sparse(session, a):
    i, j = np.nonzero(a)
    return session.from_coo(i, j, a[i, j], shape=a.shape)


def both(session, a):
    return [(session.from_numpy(a), a), (sparse(session, a), np.where(a == 0, 0.0, a))]


def same(got, want, rtol=1e-12):
    got, want = np.asarray(got), np.asarray(want, float)
    np.testing.assert_allclose(got, want, rtol=rtol, atol=0)
    zero = want == 0
    assert np.array_equal(np.signbit(got[zero]), np.signbit(want[zero]))


@pytest.fixture(autouse=True)
def quiet():
    with np.errstate(all="ignore"):
        yield


def test_unary(session):
    for m, a in both(session, EDGES):
        stack = [(op, f(m).to_numpy(), f(a).astype(float)) for f, op in UFUNC_UNARY.items()]
        for op, got, want in stack:
            try:
                same(got, want)
            except AssertionError as e:
                raise AssertionError(op) from e


@pytest.mark.parametrize("op", UFUNC_BINARY, ids=UFUNC_BINARY.get)
def test_binary(session, op):
    for m, a in both(session, LEFT):
        for n, b in both(session, RIGHT):
            same(op(m, n).to_numpy(), op(a, b).astype(float))
    for s in (-1.0, 0.0, NAN):
        m, a = both(session, EDGES)[1]
        same(op(m, s).to_numpy(), op(a, s).astype(float))
        same(op(s, m).to_numpy(), op(s, a).astype(float))


def test_storage_follows_the_image_of_zero(session):
    m = sparse(session, np.eye(3))
    for f, kind in [(np.sqrt, t.SparseMatrix), (np.exp, t.DenseMatrix), (np.cos, t.DenseMatrix), (np.log, t.DenseMatrix), (np.sign, t.SparseMatrix)]:
        assert type(f(m)) is kind
    assert (m + 0).storage == "sparse" and (m + 1).storage == "dense" and (m == 0).storage == "dense" and (m > 0).storage == "sparse"
    assert (m + m).storage == "sparse" and (m / m).storage == "dense" and (m @ m).storage == "sparse"


def test_pointwise_trees_over_one_source_have_no_join(session):
    m = sparse(session, np.eye(4))
    assert "Join" not in (np.sqrt(m * 2) + np.sin(m) * m).compile()
    other = (m + sparse(session, np.eye(4))).compile()  # two sparse sources meet in one aggregate
    assert "Union" in other and "Aggregate" in other
    assert "Join" in (m + session.from_numpy(np.eye(4))).compile()


def test_shared_values_stay_linear(session):
    m, a = session.from_numpy(np.full((1, 2), 0.5)), np.full((1, 2), 0.5)
    for _ in range(30):
        m, a = np.log1p(m + m) / 3, np.log1p(a + a) / 3
    same(m.to_numpy(), a, 1e-10)


def test_broadcast(session):
    a, row, col = np.arange(6.0).reshape(2, 3), np.array([1.0, 2, 4]), np.array([[3.0], [5]])
    m = session.from_numpy(a)
    same((m + row).to_numpy(), a + row)
    same((col * m).to_numpy(), col * a)
    same((session.from_numpy(col) - session.from_numpy(row[None])).to_numpy(), col - row)
    same((m + session.from_numpy(np.ones((1, 1)))).to_numpy(), a + 1)
    with pytest.raises(ValueError):
        m + np.ones(4)


def test_huge_lazy_broadcast_and_guards(session):
    z = np.zeros(0, int)
    a = session.from_coo(z, z, z, shape=(100_000, 1)) + session.from_coo(z, z, z, shape=(1, 100_000))
    assert a.shape == (100_000, 100_000)
    with pytest.raises(t.DensifyError):
        np.exp(a)
    with pytest.raises(t.DensifyError):
        a.to_numpy()


def test_scaling_stays_sparse(session):
    a = np.zeros((300, 300))
    a[2, 3], a[299, 0] = 4.0, -2.0
    m = sparse(session, a)
    for f in (np.arange(1.0, 301)[None], np.arange(1.0, 301)[:, None], np.array([[3.0]])):
        out = m * session.from_numpy(f)
        assert out.storage == "sparse"
        assert "Cartesian" not in out.explain()
        i, j, x = out.to_coo()
        same(x[np.lexsort((j, i))], (a * f)[np.nonzero(a)])
    with pytest.raises(t.DensifyError):
        m * session.from_numpy(np.full((1, 300), INF))


VALUES = {
    "implicit": [[0, 1, 0], [2, 0, 0], [0, 0, 0]],
    "nonfinite": [[NAN, 1, INF], [0, NAN, -INF], [0, 0, INF]],
    "nan": [[NAN, NAN], [NAN, 0]],
    "zero": [[0, 0], [0, 0]],
    "negative": [[-1, -5], [0, -7]],
    "offset": [[1e12, 1e12 + 1], [1e12 + 2, 1e12 + 4]],
}


@pytest.mark.parametrize("case", VALUES)
def test_reductions(session, case):
    a = np.array(VALUES[case], float)
    for m, b in both(session, a):
        for axis in (None, 0) if m.storage == "sparse" else (-1,):
            for f in set(REDUCERS) - {np.amin, np.amax}:
                with np.testing.suppress_warnings() as s:
                    s.filter(RuntimeWarning)
                    want, got = f(b, axis=axis), f(m, axis=axis)
                np.testing.assert_allclose(np.asarray(got, float), np.asarray(want, float), rtol=1e-9, err_msg=f"{f.__name__} {axis} {m}")
        for ddof in (1, 0.5):
            for f in (np.var, np.nanstd):
                want, got = f(b, axis=0, ddof=ddof), f(m, axis=0, ddof=ddof)
                if np.isfinite(want).all():
                    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_variance_of_extremes(session):
    # two equal huge values, spreads whose squares over- and underflow, and an offset far above the spread
    for a, want in (([[3e250, 3e250]], 0), ([[7e158, -7e158]], 7e158), ([[5e-190, -5e-190]], 5e-190), ([[2.0**45 + 3, 2.0**45]], 1.5)):
        np.testing.assert_allclose(session.from_numpy(np.array(a)).std(), want, rtol=1e-15)
    big, n = 4e159, 10**8
    m = session.from_coo([0], [0], [big], shape=(n, n))
    np.testing.assert_allclose(m.std(), big / n, rtol=1e-12)


def test_values_of_absent_cells_are_kept_through_dense_steps(session):
    a, b = np.array([[0, 1.5, 0], [2, 0, -1]]), np.array([[0, 0, 3.0], [1, 0, 0]])
    m, n = sparse(session, a), sparse(session, b)
    for got, want in ((np.exp(m) - 1, np.exp(a) - 1), ((m + 1) - 1, a), ((np.exp(m).T - 1), np.exp(a).T - 1), (np.exp(m) - np.exp(n), np.exp(a) - np.exp(b)), (np.cos(m)[1:, ::-1] - 1, np.cos(a)[1:, ::-1] - 1)):
        assert got.storage == "sparse"
        same(got.to_numpy(), want)
    assert np.exp(m).storage == "dense" and (np.exp(m) * 2).compute().storage == "dense"
    same((np.exp(m) + n).to_numpy(), np.exp(a) + b)
    same((-1 - m * 0 + 1).compute().to_numpy(), np.zeros((2, 3)))


def test_loaded_files_and_their_names(spark, tmp_path):
    def file(name, v):
        (tmp_path / name).write_text(f"%%MatrixMarket matrix coordinate real general\n2 2 1\n1 2 {v}\n")
        return tmp_path / name

    with t.Session(spark) as s:
        kept = s.from_mtx(file("a.mtx", 4), name="kept_table")
        gone = s.from_mtx(file("b.mtx", 5), name="gone_view", temporary=True)
        s.from_mtx(file("c.mtx", 6), name="kept_table", overwrite=True)
        assert kept.sum() == 6 and gone.sum() == 5  # a matrix over a name reads what the name holds now
        with pytest.raises(ValueError):
            s.from_mtx(file("d.mtx", "x"), name="gone_view", temporary=True, overwrite=True)
        assert gone.sum() == 5
        spark.range(3).createOrReplaceTempView("not_ours")
        with pytest.raises(ValueError):
            s.from_mtx(file("e.mtx", 7), name="not_ours", overwrite=True)
        assert spark.table("not_ours").columns == ["id"]
        with pytest.raises(ValueError):
            s.from_mtx(file("f.mtx", 8), name="kept_table")
        folders = [f.removeprefix("file://") for f in s._folders]
    assert spark.table("kept_table").first().x == 6 and not spark.catalog.tableExists("gone_view")
    assert folders and not any(os.path.exists(f) for f in folders)
    spark.sql("DROP TABLE kept_table")
    spark.catalog.dropTempView("not_ours")


def test_workflow_on_the_cluster_equals_the_collected_one(session):
    a = np.random.default_rng(4).poisson(0.4, (60, 12)).astype(float)
    a[:, 3], a[7] = 0, 0
    want = normalize(sparse(session, a))[0].to_numpy()
    rows = normalize_frame(sparse(session, a)).collect()
    got = np.zeros(want.shape)
    for r in rows:
        got[r.i, r.j] = r.x
    np.testing.assert_allclose(got, want, rtol=1e-12)
    assert normalize_frame(sparse(session, np.zeros((3, 4)))).count() == 0


def test_reduction_options(session):
    m = session.from_numpy(np.arange(6.0).reshape(2, 3))
    assert np.sum(m, axis=0, keepdims=True).shape == (1, 3) and m.mean(keepdims=True).shape == (1, 1)
    assert m.var(correction=1) == np.var(np.arange(6.0), ddof=1)
    for bad in (dict(out=np.zeros(3)), dict(initial=1.0), dict(dtype=np.float32), dict(where=np.ones(3, bool))):
        with pytest.raises(t.UnsupportedError):
            m.sum(axis=0, **bad)
    with pytest.raises(t.UnsupportedError):
        m.sum(axis=(0, 1))
    with pytest.raises(ValueError):
        m.var(ddof=-1)
    with pytest.raises(ValueError):
        m.sum(axis=5)
    assert isinstance(np.any(m), np.bool_)


def test_zero_signs_of_extremes(session):
    m = session.from_numpy(np.array([[0.0, -0.0], [-0.0, -0.0]]))
    assert np.signbit(m.min(axis=0)).all() and list(np.signbit(m.max(axis=0))) == [False, True]


def test_empty_and_huge(session):
    e = session.from_numpy(np.zeros((0, 3)))
    assert e.sum() == 0 and list(e.sum(axis=0)) == [0, 0, 0] and e.all() and not e.any() and math.isnan(e.mean())
    with pytest.raises(ValueError):
        e.max()
    z = np.zeros(0, int)
    h = session.from_coo(z, z, z, shape=(10**10, 10**10))
    assert h.size == 10**20 and h.sum() == 0 and h.max() == 0 and not h.all() and h.std() == 0


def test_reduced_frame(session):
    a = np.array([[0, 3.0, 0], [0, 5.0, 0]])
    got = sorted(map(tuple, sparse(session, a).reduced_frame("mean", 0).collect()))
    assert got == [(0, 0.0), (1, 4.0), (2, 0.0)]


KEYS = [np.s_[1:, ::-1], np.s_[::2], np.s_[-1:0:-2, 1:1], np.s_[...], np.s_[2, :], np.s_[:, -1], np.s_[1, 2], np.s_[..., 1], np.s_[[2, 0, 2], :], np.s_[:, [True, False, True, False, True]], np.s_[[-1, 1], 1:4:2], np.s_[1], np.s_[()], np.s_[10:], np.s_[[], :], np.s_[2, [0, 4]]]


@pytest.mark.parametrize("key", KEYS, ids=str)
def test_indexing(session, key):
    a = np.arange(20.0).reshape(4, 5) * np.tile([0, 1.0], 10).reshape(4, 5)
    for m in (session.from_numpy(a), sparse(session, a)):
        got, want = m[key], a[key]
        assert got.shape == np.shape(want)
        same(got.to_numpy(), want)


def test_rejected_keys(session):
    m = session.from_numpy(np.eye(3))
    for key, kind in [(None, t.UnsupportedError), (True, t.UnsupportedError), (([0], [1]), t.UnsupportedError), (np.eye(3) > 0, t.UnsupportedError), ([0.5], IndexError), (3, IndexError), ([7], IndexError), ((0, 0, 0), IndexError), ([True], IndexError)]:
        with pytest.raises(kind):
            m[key]
    with pytest.raises(t.UnsupportedError):
        m.take([0])


def test_extreme_slices(session):
    top = 2**63 - 1
    m = session.from_coo([0, top - 1], [0, 0], [1.0, 2.0], shape=(top, 1))
    assert m[:: top - 1].to_numpy().tolist() == [[1.0], [2.0]]
    assert m[:: 10**100].to_numpy().tolist() == [[1.0]]
    assert m[::-(10**100)].to_numpy().tolist() == [[2.0]]


def test_take_transpose_and_protocol(session):
    a = np.arange(6.0).reshape(2, 3)
    m = session.from_numpy(a)
    same(np.take(m, [1, 0, 1], axis=1).to_numpy(), np.take(a, [1, 0, 1], axis=1))
    same(np.transpose(m).to_numpy(), a.T)
    assert m.T.T.expr is m.expr and len(m) == 2 and m.size == 6 and m.ndim == 2 and m.dtype == float
    with pytest.raises(ValueError):
        bool(m)
    with pytest.raises(TypeError):
        np.linalg.norm(m)
    with pytest.raises(TypeError):
        np.add.reduce(m)
    with pytest.raises(TypeError):
        np.sort(m)
    assert m.__hash__ is None and "DenseMatrix" in repr(m)
    with pytest.raises(t.UnsupportedError):
        m + 1j


def test_vectors_and_scalars(session):
    a = np.arange(6.0).reshape(2, 3)
    m = session.from_numpy(a)
    row, col, one = m[1, :], m[:, 0], m[1, 1]
    same((row * 2 + [1, 2, 3]).to_numpy(), a[1] * 2 + [1, 2, 3])
    same((m - row).to_numpy(), a - a[1])
    same((col + one).to_numpy(), a[:, 0] + a[1, 1])
    same((m[:, 0] * m[0, :2]).to_numpy(), a[:, 0] * a[0, :2])
    assert (one / 2).item() == 2 and float(one) == 4 and np.sqrt(one).item() == 2 and row.sum() == 12 and np.mean(col) == 1.5
    assert isinstance(row + m, t.Matrix) and isinstance(row + one, t.Vector) and isinstance(one + 1, t.Scalar) and row.plan()["result"]["rank"] == 1
    with pytest.raises(TypeError):
        np.max(row)


def test_matmul(session):
    rng = np.random.default_rng(3)
    a, b = rng.integers(-3, 4, (5, 4)) * (rng.random((5, 4)) < 0.5), rng.integers(-3, 4, (4, 6)) * (rng.random((4, 6)) < 0.5)
    a, b = a.astype(float), b.astype(float)
    for m, _ in both(session, a):
        for n, _ in both(session, b):
            np.testing.assert_array_equal((m @ n).to_numpy(), a @ b)
    np.testing.assert_array_equal((a @ session.from_numpy(b)).to_numpy(), a @ b)
    zero, inf = np.array([[0.0, 1.0]]), np.array([[INF], [1.0]])
    assert math.isnan((session.from_numpy(zero) @ session.from_numpy(inf)).to_numpy()[0, 0])
    assert (sparse(session, zero) @ session.from_numpy(inf)).to_numpy()[0, 0] == 1
    with pytest.raises(t.UnsupportedError):
        session.from_numpy(a) @ np.ones(4)


def test_random_programs(session):
    for seed in range(2):
        rng = np.random.default_rng(seed)
        a = np.where(rng.random((4, 5)) < 0.5, 0, rng.choice([1.0, -1, 2, 0.25, 1e-10, NAN, INF, -INF], (4, 5)))
        m = session.from_numpy(a) if seed % 2 else sparse(session, a)
        for _ in range(12):
            k = rng.integers(7)
            if k == 0:
                f = rng.choice([np.sqrt, np.absolute, np.sign, np.floor, np.tanh, np.isnan])
                m, a = f(m), f(a).astype(float)
            elif k == 1:
                s = float(rng.choice([0.5, -1.0, 2.0]))
                m, a = m * s, a * s
            elif k == 2:
                m, a = m + m * 2, a + a * 2
            elif k == 3:
                m, a = m.T, a.T
            elif k == 4 and a.shape[0] > 1:
                m, a = m[::-1], a[::-1]
            elif k == 5:
                p = rng.integers(0, a.shape[1], a.shape[1]).tolist()
                m, a = m[:, p], a[:, p]
            else:
                m, a = m - session.from_numpy(np.ones(a.shape)), a - 1
        np.testing.assert_allclose(m.to_numpy(), a, rtol=1e-11)


def test_compute_preview_and_plans(session, capsys):
    m = sparse(session, np.diag(np.arange(1.0, 13)))
    c = (m * 2).compute("kept")
    assert c.storage == "sparse" and not c.expr.finite and c.sum() == 156
    assert session.spark.table("kept").count() == 12
    m.show(edgeitems=2)
    out = capsys.readouterr().out
    assert out.count("\n") == 5 and "..." in out and out.startswith("[ 1.0")
    assert '"plan_version": 1' in plan_json(m * NAN) and "special_float" in plan_json(m * NAN)
    rows = session.from_relation(session.spark.range(3).selectExpr("id i", "id j", "id x"), shape=(3, 3))
    assert "Project" in (rows + 0).compile() and "Physical" in (rows + 0).explain()
    big = session.from_coo([0, 10**9 - 1], [0, 10**9 - 1], [1.0, 2.0], shape=(10**9, 10**9))
    assert "2.0" in big.preview()


def test_depth_is_bounded(session):
    m = session.from_numpy(np.zeros((1, 1)))
    with pytest.raises(RecursionError):
        for _ in range(800):
            m = m + 1
    assert (m[0:1] if m.expr.depth < 700 else m).shape == (1, 1)
    deep = session.from_numpy(np.zeros((1, 1)))
    for _ in range(150):
        deep = deep + 1
    assert deep.to_numpy()[0, 0] == 150


def test_sessions_do_not_mix_and_close(spark):
    a, b = t.Session(spark), t.Session(spark)
    with pytest.raises(t.SessionMismatchError):
        a.from_numpy(np.eye(2)) + b.from_numpy(np.eye(2))
    a.close()
    a.close()
    with pytest.raises(RuntimeError):
        a.from_numpy(np.eye(2))
    with pytest.raises(ValueError):
        t.Session(spark, max_host_values=-1)


def test_inputs(session, spark, tmp_path):
    for bad, kind in [(np.ones(3), ValueError), (np.ones((2, 2)) * 1j, t.UnsupportedError), ([["a"]], ValueError)]:
        with pytest.raises(kind):
            session.from_numpy(bad)
    with pytest.raises(ValueError):
        session.from_coo([0, 0], [1, 1], [1, 2], shape=(2, 2))
    with pytest.raises(IndexError):
        session.from_coo([2], [0], [1], shape=(2, 2))
    with pytest.raises(t.DensifyError):
        session.from_numpy(np.zeros((200, 200)))
    df = spark.createDataFrame([(0, 0, None), (0, 1, 0.0)], "i int, j short, x float")
    m = session.from_relation(df, shape=(1, 2), storage="dense")
    assert math.isnan(m.to_numpy()[0, 0]) and math.isnan(m.sum())
    with pytest.raises(TypeError):
        session.from_relation(spark.createDataFrame([("a", 1, 1.0)], "i string, j int, x double"), shape=(1, 1))
    with pytest.raises(ValueError):
        session.from_relation(spark.range(1), shape=(1, 1))
    values = [NAN, -0.0, 0.0, INF, None, 5e-324]
    spark.createDataFrame([(0, k, v) for k, v in enumerate(values)], "i int, j long, x double").repartition(2).write.parquet(str(tmp_path / "p"))
    got = session.from_parquet(tmp_path / "p", shape=(1, 6), storage="dense", name="scan").to_numpy()[0]
    assert math.isnan(got[0]) and np.signbit(got[1]) and got[3] == INF and math.isnan(got[4]) and got[5] == 5e-324
    for bad, kind in [([], ValueError), ([tmp_path / "p", tmp_path / "p"], ValueError), (tmp_path / "no", FileNotFoundError)]:
        with pytest.raises(kind):
            session.from_parquet(bad, shape=(1, 6))
    with pytest.raises(ValueError):
        session.from_numpy(np.eye(2), name="scan")
    with pytest.raises(t.DensifyError):
        t.Session(spark, max_selector_values=2).from_numpy(np.eye(3))[[0, 1, 2], :]


def test_matrix_market(session, tmp_path):
    import gzip

    p = tmp_path / "a.mtx"
    text = "%%MatrixMarket matrix coordinate real general\n% note\n\n3 4 6\n1 1  2.5\n 2 3 -1\n2 3 4\n3 4 1\n3 4 -1\n3 1 3 \n"
    p.write_text(text)
    want = np.zeros((3, 4))
    want[0, 0], want[1, 2], want[2, 0] = 2.5, 3, 3
    assert (session.from_mtx(p, name="mm").to_numpy() == want).all()
    with pytest.raises(ValueError):
        session.from_mtx(p, name="mm")
    assert session.from_mtx(p, name="mm", overwrite=True).sum() == 8.5
    with gzip.open(tmp_path / "b.mtx.gz", "wt") as f:
        f.write(text)
    assert session.from_mtx(tmp_path / "b.mtx.gz").sum() == 8.5
    assert t.read_matrix_market_header(p).entries == 6

    def load(head, *lines, **k):
        (tmp_path / "c.mtx").write_text("\n".join([f"%%MatrixMarket matrix coordinate {head}", *lines]) + "\n")
        return session.from_mtx(tmp_path / "c.mtx", **k)

    assert load("pattern symmetric", "3 3 2", "2 1", "3 3").to_numpy().tolist() == [[0, 1, 0], [1, 0, 0], [0, 0, 1]]
    assert load("real skew-symmetric", "2 2 1", "2 1 5").to_numpy().tolist() == [[0, -5], [5, 0]]
    for bad in ("1.4", "1e0", "x"):
        with pytest.raises(ValueError):
            load("integer general", "1 1 1", f"1 1 {bad}")
    for lines in (["1 1 2", "1 1 1"], ["1 1 1", "2 1 1"], ["1 1 1", "1 1 1 1"], ["1 1 1", "1 1 a"]):
        with pytest.raises(ValueError):
            load("real general", *lines)
    with pytest.raises(ValueError):
        load("real skew-symmetric", "2 2 1", "1 1 5")
    assert load("real general", "2 2 2", "1 1 1", "2 2 0", assume_canonical=True).to_frame().count() == 2
