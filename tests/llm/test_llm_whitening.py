import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.llm import whitening


def brute(rows, k=whitening.COMPONENTS):
    """Exact sums in Python integers, eigenvectors by numpy."""
    x = np.floor(1024.0 * np.array(rows, float)).astype(int) + 100_000
    n, sums = len(x), x.sum(axis=0)
    v = np.cov((x - 100_000).T.reshape(x.shape[1], -1), bias=True).reshape(x.shape[1], -1)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    return n, deviation, (x - sums / n) @ vectors / np.sqrt(values), values / np.trace(v)


def frame(spark, rows):
    return spark.createDataFrame(list(rows), "vec_id BIGINT, embedding ARRAY<DOUBLE>")


def check(spark, rows, k=whitening.COMPONENTS):
    found = whitening.whiten(frame(spark, enumerate(rows)).repartition(3), k).orderBy("vec_id", "component").collect()
    n, deviation, white, explained = brute(rows, k)
    width = white.shape[1]
    assert [(r["vec_id"], r["component"]) for r in found] == [(i, c + 1) for i in range(len(rows)) for c in range(width)]
    assert {r["n"] for r in found} == {n}
    assert [int(r["deviation"]) for r in found[::width]] == deviation
    got = np.array([r["whitened"] for r in found]).reshape(-1, width)
    got *= np.sign((got * white).sum(axis=0))
    np.testing.assert_allclose(got, white, atol=1e-7)
    np.testing.assert_allclose([r["explained"] for r in found[:width]], explained, rtol=1e-9)
    assert {r["identity_error"] for r in found} and max(r["identity_error"] for r in found) < 1e-9


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    check(spark, (rng.standard_normal((300, 24)) * np.geomspace(3, 0.05, 24) + 5).tolist())
    check(spark, rng.standard_normal((40, 3)).tolist())


def test_many_components_in_several_slices(spark):
    rng = np.random.default_rng(2)
    check(spark, (rng.standard_normal((200, 30)) @ rng.standard_normal((30, 30))).tolist(), 21)


def test_close_and_equal_eigenvalues(spark):
    spread = np.diag([4.0, 4.0, 4.0 + 1e-9, 2.0, 2.0, *[1.0] * 15])
    values, vectors = whitening.leading(spark, spread, 8)
    np.testing.assert_allclose(values, [4 + 1e-9, 4, 4, 2, 2, 1, 1, 1], rtol=1e-13)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(8), atol=1e-12)
    np.testing.assert_allclose(spread @ vectors, vectors * values, atol=1e-12)


def test_inertia_counts():
    rng = np.random.default_rng(3)
    for size in (1, 2, 9, 30):
        a = rng.standard_normal((size, size))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in (values[:-1] + values[1:]) / 2:
            assert whitening._above(a, shift) == (values > shift).sum()
    assert whitening._above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, None), (3, []), (None, [0.5, 0.25]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
        (1, [1.0, 0.0]), (9, [2.0, -3.0]), (10, [7.0]),
    ]
    df = frame(spark, rows).withColumns({c: F.lit("x") for c in ("label", "n", "w", "deviation", "component", "dims")})
    got = [tuple(r) for r in whitening.whiten(df).collect()]
    assert sorted((r[0] or 0, r[1], r[2]) for r in got) == [
        (0, 1, 4), (0, 2, 4), (1, 1, 4), (1, 1, 4), (1, 2, 4), (1, 2, 4), (9, 1, 4), (9, 2, 4), (10, 1, 1)]
    assert [r[3:] for r in got if r[0] == 10] == [(0, None, None, None)]  # one vector has no variance
    assert whitening.whiten(df.limit(0)).count() == 0


def test_no_variance_in_a_direction(spark):
    rows = [[float(i), 2.0 * i, 5.0] for i in range(10)]
    got = whitening.whiten(frame(spark, enumerate(rows))).collect()
    by = {c: [r for r in got if r["component"] == c] for c in (1, 2, 3)}
    assert all(r["explained"] == pytest.approx(1) and abs(r["whitened"]) < 2 for r in by[1])
    assert all(r["whitened"] is None and r["explained"] == 0 for r in by[2] + by[3])


def test_large_entries_stay_exact(spark):
    rows = [[1e9 + i, -3e5 * i] for i in range(5)] + [[0.1, 1e-3]]
    check(spark, rows)
    assert whitening.whiten(frame(spark, [(1, [1e300, 1.0]), (2, [-1e300, 0.0])])).count() == 4
