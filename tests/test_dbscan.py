import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.operators import components, dbscan as D


def brute(points, eps, min_samples):
    near = [np.flatnonzero(((points - p) ** 2)[:, 0] + ((points - p) ** 2)[:, 1] <= eps * eps) for p in points]
    core = [len(n) >= min_samples for n in near]
    label = -np.ones(len(points), int)
    cluster = 0
    for i in range(len(points)):
        if label[i] != -1 or not core[i]:
            continue
        stack = [i]
        label[i] = cluster
        while stack:
            at = stack.pop()
            if core[at]:
                for j in near[at]:
                    if label[j] == -1:
                        label[j] = cluster
                        stack.append(j)
        cluster += 1
    return label


def table(spark, points):
    rows = [(i, float(a), float(b), int(i % 4), "Fatal" if i % 7 == 0 else "Serious") for i, (a, b) in enumerate(points)]
    return spark.createDataFrame(
        rows, "row_id BIGINT, latitude DOUBLE, longitude DOUBLE, num_casualties INT, severity STRING")


def shapes():
    rng = np.random.default_rng(7)
    uniform = rng.uniform(0, 1, (600, 2))
    ring = np.column_stack([np.cos(t := rng.uniform(0, 6.283, 400)), np.sin(t)]) * 0.4 + rng.normal(0, 0.004, (400, 2))
    blob = rng.normal(0, 0.004, (300, 2))
    line = np.column_stack([np.linspace(-1, 1, 300), np.full(300, 0.9)])
    hot = np.repeat([[0.31, -0.77]], 500, axis=0)  # a third of the rows at one place
    return {"uniform": uniform, "mixed": rng.permutation(np.vstack([ring, blob, line, hot]))}


@pytest.mark.parametrize("shape", ["uniform", "mixed"])
@pytest.mark.parametrize("eps, min_samples", [(0.0213, 3), (0.0371, 6), (0.0107, 1)])
def test_equals_brute_force(spark, shape, eps, min_samples):
    points = shapes()[shape]
    df = table(spark, points)
    found = D.label_rows(df, D.dbscan(df, eps, min_samples, "row_id")).orderBy("row_id")
    assert [r["cluster"] for r in found.collect()] == brute(points, eps, min_samples).tolist()


def test_large_scale_paths(spark, monkeypatch):
    """Box splitting and key splitting, forced on small data."""
    monkeypatch.setattr(components.connected_components, "__defaults__", (1, False))
    monkeypatch.setattr(D._cell_links, "__defaults__", (0,))
    points = shapes()["mixed"]
    df = table(spark, points).repartition(5, "longitude")
    found = D.label_rows(df, D.dbscan(df, 0.0371, 4, "row_id", split_rows=1)).orderBy("row_id")
    assert [r["cluster"] for r in found.collect()] == brute(points, 0.0371, 4).tolist()


def test_pairs_inside_a_component_are_not_split(spark, monkeypatch):
    """Most pairs of a crowded area follow from cells side by side; the labels stay those of all links."""
    rng = np.random.default_rng(3)
    points = np.vstack([rng.uniform(0, 0.2, (900, 2)), rng.uniform(0.26, 0.4, (500, 2)), [[0.2325, 0.2325]] * 4, rng.uniform(-1, -0.8, (60, 2))])
    df = table(spark, points)
    split = []
    settle = D._split_links
    monkeypatch.setattr(D, "_split_links", lambda core, pairs, reach: split.append(pairs.count()) or settle(core, pairs, reach))
    monkeypatch.setattr(D._cell_links, "__defaults__", (0,))
    whole = D.label_rows(df, D.dbscan(df, 0.0371, 4, "row_id")).orderBy("row_id").collect()
    monkeypatch.setattr(D, "_CONTRACT_PAIRS", 0)
    found = D.label_rows(df, D.dbscan(df, 0.0371, 4, "row_id")).orderBy("row_id").collect()
    assert [r["cluster"] for r in found] == [r["cluster"] for r in whole] == brute(points, 0.0371, 4).tolist()
    assert len(split) == 3 and sum(split[1:]) < split[0] / 2


def test_hotspots_and_missing_positions(spark):
    points = np.array([[0, 0], [0, 0.001], [0, 0.002], [5, 5]])
    df = table(spark, points).unionByName(
        table(spark, points[:1]).withColumns({"row_id": F.lit(9).cast("long"), "latitude": F.lit(None).cast("double")}))
    clustering = D.dbscan(df, 0.0101, 3, "row_id")
    spot = D.hotspots(clustering).collect()
    assert [(s["cluster_id"], s["accident_count"], s["fatal_count"], s["risk_level"]) for s in spot] == [(0, 3, 1, "High")]
    assert D.cluster_counts(clustering).first().asDict() == {"n_clusters": 1, "noise_points": 1}
    assert dict(D.label_rows(df, clustering).select("row_id", "cluster").collect())[9] == -1


def test_empty_table(spark):
    df = table(spark, np.zeros((1, 2))).limit(0)
    assert D.cluster_counts(D.dbscan(df, 0.01, 3, "row_id")).first().asDict() == {"n_clusters": 0, "noise_points": 0}


def test_far_and_infinite_positions_are_noise(spark):
    points = np.array([[0, 0], [0, 0.001], [0, 0.002], [3e7, 1], [np.inf, 0], [np.nan, 0]])
    df = table(spark, points)
    found = D.label_rows(df, D.dbscan(df, 0.0101, 3, "row_id")).orderBy("row_id")
    assert [r["cluster"] for r in found.collect()] == [0, 0, 0, -1, -1, -1]


@pytest.mark.parametrize("stars", [False, True])
def test_components(spark, stars):
    pairs = [(i, i + 1) for i in range(60) if i % 13] + [(100, i) for i in range(101, 140)] + [(7, 100)]
    edges = spark.createDataFrame(pairs, "a BIGINT, b BIGINT")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in pairs:
        parent[find(a)] = find(b)
    got = {}
    for r in components.connected_components(edges, split_rows=1, stars=stars).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    want = {}
    for x in list(parent):
        want.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
