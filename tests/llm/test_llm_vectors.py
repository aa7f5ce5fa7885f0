import numpy as np
from pyspark.sql import functions as F

from kerbside.llm import vectors


def brute(table):
    ids = [i for i, _ in table]
    n = len(table)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in table]
    links = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(table[i][1]) == len(table[j][1]):
                a, b = np.array(table[i][1], float), np.array(table[j][1], float)
                links[i, j] = links[j, i] = a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9
    label = list(ids)
    for _ in range(n):
        label = [min([label[i], *[label[j] for j in np.flatnonzero(links[i])]]) for i in range(n)]
    return sorted((i, int(links[k].sum()), c, i == c) for k, (i, c) in enumerate(zip(ids, label)))


def case(dims):
    rng = np.random.default_rng(dims)
    centres = rng.standard_normal((6, dims))
    near = [c + rng.standard_normal(dims) * s for c in centres for s in (0.1, 0.2, 0.3, 0.35, 0.4, 0.45) for _ in range(4)]
    noise = list(rng.standard_normal((80, dims)))
    rows = [x.tolist() for x in near + noise]
    rows += rows[:5] + [[3 * x for x in rows[7]]]
    return [(int(i), v) for i, v in zip(rng.permutation(len(rows)), rows)]


def test_equals_brute_force(spark):
    for dims, home in ((64, vectors.HOME_ROWS), (13, 4), (1, vectors.HOME_ROWS)):
        table = case(dims)
        df = spark.createDataFrame(table, "vec_id BIGINT, embedding ARRAY<DOUBLE>").withColumn("label", F.lit(1))
        got = vectors.components(df.repartition(5), home_rows=home)
        assert sorted(map(tuple, got.collect())) == brute(table)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    table = [
        (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
        (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (11, [1e-200, 0.0]),
    ]
    df = spark.createDataFrame(table, "vec_id BIGINT, embedding ARRAY<DOUBLE>").withColumns(
        {name: F.lit("x") for name in ("n", "first", "block", "id", "component_id")})
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.components(df).collect()}
    assert all(got[k] == (0, k, True) for k in (2, 3, 4, 5, 6, 7, 9))
    assert got[1][1:] == (1, True) and got[8][1] == 1 and got[10] == got[10]
    again = vectors.components(df.where("vec_id IN (1, 10)").unionByName(df.where("vec_id = 1")))
    assert sorted(map(tuple, again.collect())) == [(1, 2, 1, True), (1, 2, 1, True), (10, 2, 1, False)]
    assert vectors.components(df.limit(0)).count() == 0


def test_crowded_tiles_and_single_precision(spark):
    rng = np.random.default_rng(3)
    for dims, spread in ((64, 0.34), (300, 0.3)):
        centre = rng.standard_normal(dims)
        vecs = (centre + spread * rng.standard_normal((150, dims))).astype(np.float32).astype(float).tolist()
        vecs += [[-x for x in vecs[0]], [x * 2.0**-140 for x in vecs[1]], vecs[2]]
        table = list(enumerate(vecs))
        single = spark.createDataFrame(table, "vec_id BIGINT, embedding ARRAY<FLOAT>").repartition(3)
        double = spark.createDataFrame(table, "vec_id BIGINT, embedding ARRAY<DOUBLE>").repartition(3)
        expected = brute([(i, np.float32(v).astype(float).tolist()) for i, v in table])
        assert sorted(map(tuple, vectors.components(single).collect())) == expected
        assert sorted(map(tuple, vectors.components(double, home_rows=16).collect())) == brute(table)


def test_leading_directions():
    for dims in (1, 2, 13, 64, 300):
        for cosine in (-0.5, 0.0, 0.5, 0.9, 1.0):
            assert 1 <= vectors._leading(dims, cosine) <= dims
    assert vectors._leading(1, 0.9) == 1 and 16 < vectors._leading(64, 0.9) < 32


def test_vectors_meet_without_a_shuffle(spark, monkeypatch):
    plans = {}

    def noted(df, label, materialise=vectors.materialise):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return materialise(df, label)

    monkeypatch.setattr(vectors, "materialise", noted)
    table = case(64)
    df = spark.createDataFrame(table, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, vectors.components(df, home_rows=16).collect())) == brute(table)
    # copies of the vectors in a shuffle filled the disk: they grew with the square of the table
    assert "Exchange" not in plans["vector-links"]
    assert "embedding" not in plans["vector-components"].split("Exchange", 1)[1].split("Scan parquet", 1)[0]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") in (before, "512")
