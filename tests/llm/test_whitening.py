"""Whitening next to a dense eigendecomposition of the whole matrix."""

import math

import numpy as np
import pytest

from chalkline.llm import whitening as W


def whole(vectors):
    return np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 10**6


def check(rows, vectors, k=32):
    """Rows of one whitening against eigh; vectors by key 0, 1, ..."""
    x = whole(vectors)
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(k, x.shape[1])
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == n * k
    for c in range(k):
        want = y @ basis[:, c] / math.sqrt(values[c])
        seen = np.array([got[i, c + 1].whitened for i in range(n)])
        assert np.abs(seen * np.sign(seen @ want) - want).max() < 1e-7
        assert math.isclose(got[0, c + 1].explained, values[c] / values.sum(), rel_tol=1e-9)
    for i in range(n):
        assert got[i, 1].deviation == int(((n * x[i] - s) ** 2).sum()) and got[i, 1].n == n
    assert max(r.identity_error for r in rows) < 1e-9


@pytest.mark.parametrize("parts, fan_in", [(1, 16), (7, 2), (20, 16)])
def test_whitening_equals_eigh(spark, parts, fan_in):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, key string")
    check(W.whiten(df.repartition(parts), fan_in=fan_in).collect(), vectors)
    assert {r.component for r in W.whiten(df, components=3).collect()} == {1, 2, 3}


def test_updates_keep_spectrum_and_orthogonality():
    rng = np.random.default_rng(1)
    for width, n in ((1, 5), (6, 4), (20, 200)):
        x = whole(rng.normal(size=(n, width)))
        x[:, width // 2] = x[:, 0]  # two equal components, and rows that repeat
        x[n // 2 :] = x[n // 2]
        parts = []
        for rows in (x[: n // 3], x[n // 3 :]):
            s = W.Spectrum(width)
            s.add(rows)
            parts.append(s)
        a, b = parts
        a.merge(b.n, b.sums, b.values, b.vectors)
        y = x - x.mean(axis=0)
        scatter = y.T @ y
        assert np.abs((a.vectors * a.values) @ a.vectors.T - scatter).max() <= 1e-8 * max(1.0, np.abs(scatter).max())
        assert np.abs(a.vectors.T @ a.vectors - np.eye(width)).max() < 1e-12
        assert a.n == n and a.sums == x.sum(axis=0).tolist()


def test_secular_roots():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(1, 12))
        d = np.sort(rng.uniform(0, 10, n)) + np.arange(n) * 1e-3
        z = rng.normal(size=n) * 10.0 ** rng.integers(-4, 2, n)
        origin, offset = W.secular_roots(d, z * z)
        want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
        assert np.abs(d[origin] + offset - want).max() <= 1e-9 * max(1.0, want.max())


def test_rows_that_take_no_part(spark):
    good = [[1.0, 2.0, 0.5], [0.0, 1.0, -1.0], [3.0, -1.0, 2.0], [0.0, 0.0, 0.0], [3.0, -1.0, 2.0]]
    bad = [None, [], [1.0, None, 2.0], [math.nan, 1.0, 1.0], [math.inf, 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, v) for i, v in enumerate(good)] + [(100 + i, v) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(W.whiten(df).collect(), good)


def test_no_variance_null_keys_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (5, [1.0, 3.0])], "vec_id long, embedding array<float>")
    rows = W.whiten(df).orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component, r.n) for r in rows] == [(None, 1, 3)] * 2 + [(None, 2, 3)] * 2 + [(5, 1, 3), (5, 2, 3)]
    assert all(r.whitened is None for r in rows if r.component == 2)
    assert sorted(abs(r.whitened) for r in rows if r.component == 1) == pytest.approx([math.sqrt(0.5)] * 2 + [math.sqrt(2)])
    assert [r.deviation for r in rows if r.component == 1] == [64**2] * 2 + [128**2]
    one = W.whiten(df.limit(1)).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in one] == [(None, None, None, 0)] * 2
    assert W.whiten(df.limit(0)).collect() == [] and W.whiten(df.limit(0)).columns == W.whiten(df).columns


def test_deviations_beyond_a_long():
    x = np.array([[10**6, 10**6], [10**6 + 3 * 10**9, 10**6]])
    sums = x.sum(axis=0).tolist()
    assert W.deviations(x, 2, sums).to_pylist() == [9 * 10**18, 9 * 10**18]
    assert W.deviations(x * 2, 2, [2 * s for s in sums]).to_pylist() == [None, None]
