import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.operators import anomaly as A
from kerbside.operators import classify as C
from kerbside.operators import regression as R
from kerbside.operators.encoding import apply_codes, first_seen_codes
from kerbside.plans import features as V


def arrays(df):
    p = df.select("speed_limit", "num_vehicles", "num_casualties").toPandas()
    return np.column_stack([np.ones(len(p)), p.speed_limit, p.num_vehicles]), p.num_casualties.to_numpy(float)


def test_negative_binomial_solves_its_score_equations(accidents):
    fit = R.fit_negative_binomial(accidents)
    x, y = arrays(accidents)
    beta = np.array([r["coefficient"] for r in fit.coefficients.collect()])
    mu = np.exp(x @ beta)
    residual = (y - mu) / (1 + mu)  # relative to the size of the terms: the fit stops at 1e-8 of deviance
    assert (np.abs(x.T @ residual) <= 1e-6 * (np.abs(x).T @ np.abs(residual))).all()
    stats = fit.stats.first()
    llf = (y * np.log(mu) - (y + 1) * np.log(mu + 1)).sum()
    assert stats["aic"] == pytest.approx(-2 * llf + 6)
    assert stats["bic_llf"] == pytest.approx(-2 * llf + 3 * np.log(len(y)))
    assert 0 <= stats["pseudo_r2"] <= 1 and stats["n_rows"] == len(y)


def test_poisson_solves_its_score_equations(accidents):
    fit = R.fit_poisson(accidents)
    beta = {r["feature"]: r["coefficient"] for r in fit.coefficients.collect()}
    p = accidents.toPandas()
    eta = beta.pop("const") + sum(
        b * (p[f] if f in p else (p[f.rsplit("_", 1)[0]] == f.rsplit("_", 1)[1])) for f, b in beta.items())
    mu, y = np.exp(eta.to_numpy(float)), p.num_casualties.to_numpy(float)
    assert abs((y - mu).sum()) < 1e-4 and abs(((y - mu) * p.num_vehicles).sum()) < 1e-3
    stats = fit.stats.first()
    with np.errstate(divide="ignore", invalid="ignore"):
        deviance = 2 * (np.where(y > 0, y * np.log(y / mu), 0) - (y - mu)).sum()
    assert stats["deviance"] == pytest.approx(deviance, rel=1e-6)
    assert stats["bic_deviance"] == pytest.approx(deviance - (len(y) - len(beta) - 1) * np.log(len(y)), rel=1e-6)


def test_regressions_report_missing_input(accidents):
    assert not R.fit_poisson(accidents.drop("num_casualties")).stats.first()["fitted"]
    assert not R.fit_negative_binomial(accidents.drop("speed_limit", "num_vehicles")).stats.first()["fitted"]


def test_anomalies(spark):
    usual = spark.range(500).select(
        "id", F.lit(30).alias("speed_limit"), (1 + F.col("id") % 3).alias("num_vehicles"), (F.col("id") % 2).alias("num_casualties"))
    odd = spark.range(500, 505).select("id", F.lit(150).alias("speed_limit"), F.lit(40).alias("num_vehicles"), F.lit(50).alias("num_casualties"))
    gap = spark.range(505, 506).select("id", F.lit(None).cast("int").alias("speed_limit"), F.lit(1).alias("num_vehicles"), F.lit(1).alias("num_casualties"))
    df = usual.unionByName(odd).unionByName(gap)
    found = A.detect_anomalies(df, 0.01)
    flagged = {r["id"] for r in found.data.where("is_anomaly").collect()}
    assert flagged == set(range(500, 505))
    assert found.data.count() == 506 and found.stats.first()["n_anomalies"] == 5
    again = A.detect_anomalies(df.repartition(11), 0.01)
    assert {r["id"] for r in again.data.where("is_anomaly").collect()} == flagged


def test_anomaly_share_and_small_tables(accidents):
    stats = A.detect_anomalies(accidents, 0.2).stats.first()
    assert 0 < stats["percentage"] <= 20
    few = A.detect_anomalies(accidents.limit(9), 0.2)
    assert few.stats.first()["n_anomalies"] == 0 and few.data.where("is_anomaly").count() == 0
    assert A.detect_anomalies(accidents.select("row_id", "speed_limit"), 0.2).stats.first()["n_anomalies"] == 0


def test_split_is_stratified_and_stable(accidents):
    train, test = C.split(accidents, "row_id", by="severity")
    assert train.count() + test.count() == accidents.count()
    total = {r[0]: r[1] for r in accidents.groupBy("severity").count().collect()}
    kept = {r[0]: r[1] for r in train.groupBy("severity").count().collect()}
    assert all(abs(kept[s] / total[s] - 0.8) < 0.02 for s in total)
    other, _ = C.split(accidents.repartition(7), "row_id", by="severity")
    assert other.join(train, "row_id", "left_anti").count() == 0


@pytest.fixture(scope="module")
def learnable(accidents):
    """Severity decided by speed, so a model must find it."""
    return accidents.withColumn(
        "severity", F.when(F.col("speed_limit") >= 70, "Fatal").when(F.col("speed_limit") >= 50, "Serious").otherwise("Minor"))


def test_train_store_and_score(spark, learnable, tmp_path, monkeypatch):
    monkeypatch.setattr(C.fit_boosted, "__defaults__", (5,))
    trained = C.train_severity(V.derive(learnable), "row_id", version="v1")
    assert trained.metrics.first()["accuracy"] == 1
    assert trained.importances.agg(F.sum("importance")).first()[0] == pytest.approx(1)
    assert trained.importances.orderBy(F.desc("importance")).first()["feature"] in ("speed_limit", "road_type_encoded")
    C.save(trained, str(tmp_path))
    loaded = C.load(spark, str(tmp_path))
    assert loaded.version == "v1" and loaded.labels == ["Fatal", "Minor", "Serious"]
    got = C.predict(learnable.drop("road_surface").withColumn("junction_type", F.lit("never seen")), loaded)
    wrong = got.where("severity <> predicted_severity").count()
    assert wrong == 0 and got.where("abs(aggregate(probabilities, 0D, (a, p) -> a + p) - 1) > 1e-9").count() == 0


def test_train_and_select(spark, learnable, monkeypatch):
    monkeypatch.setattr(C.fit_boosted, "__defaults__", (3,))
    table = V.add_time_features(learnable)
    encodings = first_seen_codes(table, "row_id")
    trained = C.train_and_select(apply_codes(table, encodings), encodings, "row_id")
    metrics = trained.metrics.collect()
    assert [m["model_name"] for m in metrics] == ["Logistic Regression", "Random Forest", "Boosted Trees"]
    assert trained.name == max(metrics, key=lambda m: m["f1_score"])["model_name"]
    assert trained.features[:7] == C.BASE_FEATURES and len(trained.features) == 13
    scored = C.predict(table, trained)
    assert scored.where("severity = predicted_severity").count() / table.count() > 0.95


def test_weighted_f1(spark):
    class Fixed:
        stages = [None]
    cells = [(0, 0, 4.0), (0, 1, 1.0), (1, 1, 2.0), (1, 0, 2.0), (2, 0, 1.0)]
    df = spark.createDataFrame(cells, "label DOUBLE, prediction DOUBLE, weight DOUBLE".replace("label DOUBLE", "label INT").replace("prediction DOUBLE", "prediction INT"))
    original = C.score
    C.score = lambda model, rows: rows
    try:
        accuracy, f1 = C.evaluate(Fixed(), df)
    finally:
        C.score = original
    assert accuracy == pytest.approx(0.6)
    assert f1 == pytest.approx(0.5 * 8 / 12 + 0.4 * 4 / 7)


def test_confidence(spark):
    metrics = spark.createDataFrame([(0.95,), (0.8,), (0.5,)], "accuracy DOUBLE")
    assert [r["level"] for r in C.confidence_report(metrics, 100).collect()] == ["High", "Medium", "Low"]
    assert [r["level"] for r in C.confidence_report(metrics, 60).collect()] == ["Medium", "Medium", "Low"]


def test_poisson_by_blocks_equals_the_solver(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(float(rng.integers(20, 80)), str(rng.choice(list("abcd"))), rng.choice(["x", "y", None])) for _ in range(600)]
    counts = [int(rng.poisson(np.exp(0.3 + 0.01 * v + 0.4 * (w == "b") - 0.5 * (r == "y")))) for v, w, r in rows]
    df = spark.createDataFrame(
        [(*r, c) for r, c in zip(rows, counts)], "speed_limit DOUBLE, weather STRING, road_type STRING, num_casualties INT")
    fit = R.fit_poisson(df)
    whole, stats = {r["feature"]: (r["coefficient"], r["p_value"]) for r in fit.coefficients.collect()}, fit.stats.first()
    monkeypatch.setattr(R, "SOLVER_COLUMNS", 3)  # the smaller column still fits
    fit = R.fit_poisson(df)
    blocks, own = {r["feature"]: (r["coefficient"], r["p_value"]) for r in fit.coefficients.collect()}, fit.stats.first()
    assert blocks.keys() == whole.keys()
    for k in whole:
        assert blocks[k][0] == pytest.approx(whole[k][0], abs=1e-3)
        assert blocks[k][1] == pytest.approx(whole[k][1], rel=2e-2, abs=1e-4)
    assert sorted(own["significant_features"]) == sorted(stats["significant_features"])
    assert own["deviance"] == pytest.approx(stats["deviance"], rel=1e-6)
    assert own["aic"] == pytest.approx(stats["aic"], rel=1e-6) and own["null_deviance"] == pytest.approx(stats["null_deviance"])


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.range(40_000).select("id", (F.col("id") % 3).alias("label"))
    parts = [{r["id"] for r in C.split(df.repartition(n), "id", by="label")[0].collect()} for n in (3, 37)]
    assert parts[0] == parts[1] and len(parts[0]) == sum(-(-n * 4 // 5) for n in (13_334, 13_333, 13_333))


def test_quantiles_with_infinite_values(spark):
    from kerbside.operators.quantiles import exact_quantiles
    inf = float("inf")
    for values, want in (([1.0, 2.0, inf, None], 2.0), ([-inf, -inf, 3.0], -inf), ([-1.7e308, 1.7e308, 0.5], 0.5),
                         ([1e-300, 1e300, 2.0, 3.0], 2.5), ([inf, inf], inf)):
        df = spark.createDataFrame([(v,) for v in values], "x DOUBLE")
        assert exact_quantiles(df, ["x"])["x"] == want


def test_trees_draw_from_all_rows(spark):
    df = spark.range(10_000).select(*[(F.col("id") * k % 9973).cast("double").alias(c) for k, c in ((1, "a"), (7, "b"))])
    profiles = df.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    got = A._samples(profiles, ["a", "b"], 10_000, 256, 42)
    counts = got.groupBy("tree").count().collect()
    assert len(counts) == A.TREES and {r["count"] for r in counts} == {256}
    assert got.select("a", "b").distinct().count() > 8500  # of 25 600 draws from 10 000 rows


def test_poisson_by_blocks_says_what_it_lacks(spark, monkeypatch):
    rows = [(float(i % 7), "abc"[i % 3], "xy"[i % 2], i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "speed_limit DOUBLE, weather STRING, road_type STRING, num_casualties INT")
    monkeypatch.setattr(R, "SOLVER_COLUMNS", 1)
    stats = R.fit_poisson(df).stats.first()
    assert stats["significant_features"] is None and stats["error"] is None
    monkeypatch.setattr(R._poisson_by_blocks, "__defaults__", (1, 1e-15))
    assert R.fit_poisson(df).stats.first()["error"] == "not converged after 1 rounds"
