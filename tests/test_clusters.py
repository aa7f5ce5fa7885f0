import numpy as np
from test_dbscan import brute, shapes, table

from kerbside.operators import clusters as K
from kerbside.operators import dbscan as D


def labels(df, clustering):
    return [r["cluster"] for r in D.label_rows(df, clustering).orderBy("row_id").collect()]


def test_appends_equal_brute_force(spark):
    points, eps, min_samples = shapes()["mixed"], 0.0371, 6
    df = table(spark, points)
    state = K.start(df.where("row_id % 5 < 2"), eps, min_samples, "row_id")
    for kind in ("row_id % 5 = 2 AND latitude < 0", "row_id % 5 > 2 OR (row_id % 5 = 2 AND latitude >= 0)"):
        state = K.append(state, df.where(kind))
    assert labels(df, K.clusters(state)) == brute(points, eps, min_samples).tolist()
    seen = sorted(map(tuple, K.clusters(state).locations.collect()))
    assert seen == sorted(map(tuple, D.dbscan(df, eps, min_samples, "row_id").locations.collect()))


def test_each_append_equals_a_full_run(spark):
    """A bridge joins two clusters, a border point becomes core, noise becomes a cluster."""
    steps = [
        [(0, 0), (0, 1), (0, 2), (0, 6), (0, 7), (0, 8), (9, 9)],
        [(0, 3), (9, 10), (0, 4.5)], [(0, 4), (0, 5), (9, 9), (50, 50), (float("nan"), 1.0)], []]
    rows, state = [], None
    for step in steps:
        df = table(spark, rows + step)
        new = df.where(f"row_id >= {len(rows)}")
        state = K.append(state, new) if state else K.start(new, 1.2, 3, "row_id")
        rows += step
        finite = np.array([p for p in rows if p[0] == p[0]], float)
        assert [x for x, p in zip(labels(df, K.clusters(state)), rows) if p[0] == p[0]] == brute(finite, 1.2, 3).tolist()


def test_large_scale_paths_and_storage(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(K, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(D._cell_links, "__defaults__", (0,))
    points = shapes()["mixed"][:500]
    df = table(spark, points)
    K.save(K.start(df.where("row_id < 300"), 0.0371, 4, "row_id", split_rows=1), str(tmp_path))
    state = K.append(K.load(spark, str(tmp_path)), df.where("row_id >= 300"), split_rows=1)
    assert labels(df, K.clusters(state, split_rows=1)) == brute(points, 0.0371, 4).tolist()
