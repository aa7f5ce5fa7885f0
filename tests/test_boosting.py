import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.operators import boosting as B
from kerbside.operators.ordinals import with_running_sum


def table(n, seed):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 7, n), np.round(rng.standard_normal(n), 2), rng.integers(0, 2, n)]).astype(float)
    y = (x[:, 0] > 3).astype(int) + (x[:, 1] > 0.5) * (rng.random(n) < 0.9)
    return x, y.astype(int), rng.integers(1, 4, n).astype(float)


def frame(spark, x, y, w):
    rows = [(*map(float, r), int(k), float(v)) for r, k, v in zip(x, y, w)]
    return spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, c DOUBLE, label INT, weight DOUBLE")


class Node:
    """Plain recursive tree over raw values: every cut between two values is tried."""

    def __init__(self, x, g, h, depth, rate):
        self.value, self.cut = -rate * g.sum() / (h.sum() + B.PENALTY), None
        best = B.MIN_GAIN
        for j in range(x.shape[1]) if depth else ():
            for low in np.unique(x[:, j]):
                left = x[:, j] <= low
                if min(h[left].sum(), h[~left].sum()) < B.MIN_HESSIAN:
                    continue
                parts = [g[s].sum() ** 2 / (h[s].sum() + B.PENALTY) for s in (left, ~left)]
                gain = sum(parts) - g.sum() ** 2 / (h.sum() + B.PENALTY)
                if gain > best + 1e-9:
                    best, self.cut = gain, (j, low)
        if self.cut:
            left = x[:, self.cut[0]] <= self.cut[1]
            self.sides = [Node(x[s], g[s], h[s], depth - 1, rate) for s in (left, ~left)]

    def __call__(self, row):
        return self.value if not self.cut else self.sides[int(row[self.cut[0]] > self.cut[1])](row)


def brute(x, y, w, classes, depth, rounds, rate):
    margins = np.zeros((len(x), classes))
    for _ in range(rounds):
        p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        grown = [
            Node(x, w * (p[:, k] - (y == k)), w * np.maximum(2 * p[:, k] * (1 - p[:, k]), 1e-16), depth, rate)
            for k in range(classes)]
        margins += np.array([[t(r) for t in grown] for r in x])
    return np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)


@pytest.mark.parametrize("parts,local", [(1, 0), (5, 0), (5, B.LOCAL_ROWS)])
def test_equals_brute_force(spark, monkeypatch, parts, local):
    monkeypatch.setattr(B, "_REWRITE", 2)
    monkeypatch.setattr(B, "LOCAL_ROWS", local)
    x, y, w = table(160, 1)
    df = frame(spark, x, y, w).repartition(parts)
    model = B.fit(df, ["a", "b", "c"], 3, depth=3, rounds=5, rate=0.3)
    expected = brute(x, y, w, 3, 3, 5, 0.3)
    got = df.select("a", "b", "c", B.probabilities(model).alias("p")).collect()
    wanted = {tuple(r): p for r, p in zip(x, expected)}
    for r in got:
        np.testing.assert_allclose(r["p"], wanted[r["a"], r["b"], r["c"]], atol=1e-9)


def test_trees_depend_on_neither_partitions_nor_size_check(spark, monkeypatch):
    monkeypatch.setattr(B, "_REWRITE", 2)
    x, y, w = table(2000, 2)
    models = []
    for parts, local in ((2, 0), (7, 0), (3, B.LOCAL_ROWS)):
        monkeypatch.setattr(B, "LOCAL_ROWS", local)
        models.append([t for r in B.fit(frame(spark, x, y, w).repartition(parts), ["a", "b"], 3, 3, 4).trees for t in r])
    for first, *others in zip(*models):
        assert all((a == b).all() for other in others for a, b in zip(first, other))


def test_bins_are_weighted_quantiles(spark):
    rng = np.random.default_rng(3)
    values, weights = rng.permutation(1000).astype(float), rng.integers(1, 50, 1000).astype(float)
    df = spark.createDataFrame(
        [(v, -v, 1.0, w) for v, w in zip(values.tolist(), weights.tolist())], "a DOUBLE, b DOUBLE, c DOUBLE, weight DOUBLE")
    starts = B.bin_starts(df.repartition(6), ["a", "b", "c"], 16)
    assert starts[2] == [] and [len(s) for s in starts[:2]] == [15, 15]
    for sign, s in ((1, starts[0]), (-1, starts[1])):
        place = np.searchsorted(s, sign * values, side="right")
        share = np.bincount(place, weights) / weights.sum()
        assert abs(share - 1 / 16).max() < 50 / weights.sum() + 1e-9


def test_running_sum(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("w")).repartition(9)
    got = {r["id"]: r["upto"] for r in with_running_sum(df, ["id"], "w", "upto").collect()}
    assert got == {i: sum(k % 7 for k in range(i + 1)) for i in range(500)}


def test_awkward_values_and_storage(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    x = [[nan, 1.0, 0.0], [inf, 2.0, 0.0], [-inf, 3.0, 0.0], [5.0, 4.0, 0.0]] * 10
    df = frame(spark, x, [0, 1, 0, 1] * 10, [1.0] * 40)
    model = B.fit(df, ["a", "b", "c"], 2, 2, 20)
    scored = df.select("label", B.probabilities(model).alias("p"))
    assert scored.where("p[label] <= 0.5").count() == 0
    assert sum(B.importances(model)) == pytest.approx(1) and B.importances(model)[2] == 0
    B.save(model, spark, str(tmp_path))
    loaded = B.load(spark, str(tmp_path))
    assert scored.collect() == df.select("label", B.probabilities(loaded).alias("p")).collect()
    alone = B.fit(df.where("label = 0"), ["a"], 1, 2, 2)
    assert df.select(B.probabilities(alone).alias("p")).distinct().collect()[0]["p"] == [1.0]
    assert df.limit(0).select(B.probabilities(model).alias("p")).count() == 0
    with pytest.raises(ValueError):
        B.fit(df, ["a"], B.CLASSES + 1, 2)
