import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.operators import classify as C
from kerbside.operators import forest


@pytest.fixture(scope="module")
def counted(spark):
    """Label 1 where a > 2 in 9 of 10 rows, else label 0; b says nothing."""
    rows = [(float(a), float(b), float(k), 400.0 * (9 if (a > 2) == bool(k) else 1)) for a in range(6) for b in range(4) for k in (0, 1)]
    return spark.createDataFrame(rows, "a DOUBLE, b DOUBLE, label DOUBLE, weight DOUBLE")


@pytest.fixture(scope="module")
def fitted(counted):
    return forest.fit(counted, ["a", "b"], 2, trees=20, depth=3)


def test_many_rows_are_resampled_from_their_counts(spark, counted):
    rows = counted.select("a", "b", "label", F.explode(F.sequence(F.lit(1), (F.col("weight") / 400).cast("int"))))
    assert isinstance(C.fit_forest(rows, counted, ["a", "b"], 2, most=100), forest.Forest)
    assert not isinstance(C.fit_forest(rows, counted, ["a", "b"], 2), forest.Forest)  # 96 000 rows


def test_copies_are_drawn_like_single_rows(counted, fitted):
    total = counted.agg(F.sum("weight")).first()[0]
    copies = np.array([tree.counts[0].sum() for tree in fitted.trees])
    assert len(set(copies)) > 10 and np.abs(copies.mean() / total - 1) < 0.01
    assert 0.3 * total < copies.var(ddof=1) < 3 * total  # Poisson; equal rows drawn together would give about 2 000 times that


def test_trees_do_not_depend_on_partitions(counted, fitted):
    again = forest.fit(counted.repartition(5), ["a", "b"], 2, trees=20, depth=3)
    for one, other in zip(fitted.trees, again.trees):
        assert all(np.array_equal(x, y) for x, y in zip(one, other))


def test_finds_the_rule_and_gives_it_the_weight(counted, fitted):
    accuracy, _ = C.evaluate(fitted, counted)
    assert accuracy == pytest.approx(0.9)
    a, b = forest.importances(fitted)
    assert a > 0.99 and a + b == pytest.approx(1)
    shares = C.score(fitted, counted).select("a", "probabilities").distinct().collect()
    assert all(abs(r["probabilities"][int(r["a"] > 2)] - 0.9) < 0.05 for r in shares)


def test_best_split_by_brute_force():
    counts = np.random.default_rng(1).integers(0, 9, (5, 3, 6, 4)).astype(float)
    counts[:, 1:] = np.stack([counts[:, 0][:, ::-1], counts[:, 0][:, [2, 0, 1, 5, 4, 3]]], axis=1)  # the same copies
    gini = lambda part: part.sum() - (part ** 2).sum() / max(part.sum(), 1)
    gain, place, cut, left = forest.best_splits(counts)
    for node in range(5):
        found = {
            (p, c): gini(counts[node, p].sum(axis=0)) - gini(counts[node, p, :c + 1].sum(axis=0)) - gini(counts[node, p, c + 1:].sum(axis=0))
            for p in range(3) for c in range(5)}
        assert gain[node] == pytest.approx(max(found.values())) == found[place[node], cut[node]]
        assert np.array_equal(left[node], counts[node, place[node], :cut[node] + 1].sum(axis=0))


def test_stored_forest_comes_back(spark, counted, fitted):
    path = tempfile.mkdtemp(prefix="forest-")
    forest.save(fitted, spark, path)
    back = forest.load(spark, path)
    assert back.features == fitted.features and back.starts == fitted.starts
    assert C.score(back, counted).select("probabilities").collect() == C.score(fitted, counted).select("probabilities").collect()
    model = C.SeverityModel("Random Forest", fitted, fitted.features, ["x", "y"], *[counted.limit(1)] * 3, "v1")
    folder = tempfile.mkdtemp(prefix="forest-")
    C.save(model, folder)
    assert isinstance(C.load(spark, folder).model, forest.Forest)
