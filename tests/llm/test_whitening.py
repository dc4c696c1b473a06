import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dayfold.llm import whitening as W


def scatter(x):
    y = x - x.mean(axis=0)
    return y.T @ y


def check_spectrum(s, x):
    want = scatter(x)
    size = max(1.0, np.abs(want).max())
    assert s.n == len(x) and s.sums.tolist() == [int(v) for v in x.sum(axis=0)]
    assert np.abs(s.q.T @ s.q - np.eye(x.shape[1])).max() < 1e-11
    assert np.abs(s.q @ np.diag(s.d) @ s.q.T - want).max() < 1e-10 * size
    assert (np.diff(s.d) >= 0).all()


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10 ** 9), st.integers(1, 9), st.sampled_from(["any", "zeros", "equal", "tiny", "integers"]))
def test_rank_one_update(seed, n, kind):
    rng = np.random.default_rng(seed)
    d = np.sort({"any": rng.random(n), "zeros": np.zeros(n), "equal": np.repeat(rng.random(), n), "tiny": rng.random(n) * 1e-14, "integers": rng.integers(0, 3, n).astype(float)}[kind])
    q = np.linalg.qr(rng.normal(size=(n, n)))[0]
    v = rng.normal(size=n) * (rng.random(n) < 0.7) * 10.0 ** rng.integers(-9, 4)
    got, vectors = W.rank_one(d, q, v, 0.7)
    want = q @ np.diag(d) @ q.T + 0.7 * np.outer(v, v)
    size = max(np.abs(want).max(), 1e-300)
    assert np.abs(vectors @ np.diag(got) @ vectors.T - want).max() < 1e-12 * size + 1e-15
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-12


def test_blocks_and_combination():
    rng = np.random.default_rng(1)
    x = rng.integers(-500, 500, (900, 12)) + 100_000
    x[:, 3] = x[:, 2]           # a direction without variance
    x[100:400] = x[0]           # copies
    s = W.nothing(12)
    for part in np.split(x, [1, 5, 300]):
        s = W.with_block(s, part)
    check_spectrum(s, x)
    a, b = W.with_block(W.nothing(12), x[:350]), W.with_block(W.nothing(12), x[350:])
    check_spectrum(W.combined(a, b), x)
    assert W.combined(W.nothing(12), a) is a and W.combined(a, W.nothing(12)) is a


SCHEMA = "vec_id long, embedding array<float>, label int, n long, whitened string, part int"


def frame_of(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in vectors], SCHEMA)


def slow(vectors):
    """(rows, x, eigenvalues, trace) of the usable vectors, from exact whole numbers."""
    used = [(i, v) for i, v in vectors if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in used], np.int64)
    exact = len(x) * x - x.sum(axis=0)
    v = (exact / len(x)).T @ (exact / len(x)) / len(x)
    return used, exact, v


def test_query_against_numpy(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(700, 10)) @ rng.normal(size=(10, 10)) / 8
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(300)]      # a hot vector
    vectors += [(3, vectors[3][1]), (None, vectors[4][1]), (-5, vectors[5][1])]
    bad = [(2000, None), (2001, [None] * 10), (2002, [float("nan")] * 10), (2003, [float("inf")] + [0.0] * 9), (2004, [])]
    docs = frame_of(spark, vectors + bad).repartition(11)
    got = W.whitened(docs).toPandas()
    used, exact, v = slow(vectors)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    assert len(got) == 8 * len(used) and (got.n == len(used)).all()
    deviation = {}
    for (i, _), row in zip(used, exact):
        deviation.setdefault(i, set()).add(sum(int(c) ** 2 for c in row))
    for r in got[got.vec_id.notna()].itertuples():
        assert r.deviation in deviation[int(r.vec_id)]
    assert np.allclose(got.groupby("component").explained.first(), e[:8] / np.trace(v), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    want = (exact / len(used)) @ (q[:, :8] / np.sqrt(e[:8]))
    first = got[(got.vec_id >= 0) & (got.vec_id < 700) & (got.vec_id != 3)].drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened")
    mine = want[[i for i, (k, _) in enumerate(used) if k is not None and 0 <= k < 700 and k != 3]]
    for c in range(8):
        sign = np.sign(first[c + 1].to_numpy() @ mine[:, c])
        assert np.abs(sign * first[c + 1].to_numpy() - mine[:, c]).max() < 1e-8


def test_edges(spark):
    assert W.whitened(frame_of(spark, [(1, None)]).limit(0)).count() == 0
    assert W.whitened(frame_of(spark, [(1, None), (2, [])])).count() == 0
    assert W.whitened(frame_of(spark, [(1, [1.0, 2.0])] * 5)).count() == 0            # no variance
    line = W.whitened(frame_of(spark, [(i, [float(i), -2.0 * i]) for i in range(6)])).toPandas()
    assert set(line.component) == {1} and line.explained[0] == pytest.approx(1)
    mixed = W.whitened(frame_of(spark, [(i, [float(i % 4), float(i % 3)]) for i in range(20)] + [(99, [1.0])])).toPandas()
    assert 99 not in set(mixed.vec_id) and (mixed.n == 20).all() and set(mixed.component) == {1, 2}


def test_deviations_beyond_64_bits():
    x = np.array([[10 ** 6, 0], [0, 10 ** 6]])
    n, sums = 10 ** 10, np.array([5 * 10 ** 15, 5 * 10 ** 15], object)
    assert W.deviations(x, n, sums) == [2 * (5 * 10 ** 15) ** 2] * 2
    assert W.deviations(x, 2, np.array([10 ** 6, 10 ** 6], object)) == [2 * 10 ** 12] * 2
