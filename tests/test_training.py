import pytest
from pyspark.sql import functions as F

from kerbside.operators import classify as C
from kerbside.operators import regression as R
from kerbside.plans import training
from kerbside.plans.retrain import retrain


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same_fit(a, b):
    one, other = ({r["feature"]: (r["coefficient"], r["p_value"]) for r in f.coefficients.collect()} for f in (a, b))
    assert one.keys() == other.keys()
    for feature, values in one.items():
        assert values == pytest.approx(other[feature], rel=1e-6, abs=1e-9)


@pytest.fixture(scope="module")
def parts(accidents):
    third = F.col("row_id") % 3
    late = accidents.where(third == 2).drop("junction_type").withColumn("weather", F.lit("Hail"))
    return [accidents.where(third == 0), accidents.where(third == 1), late]


def test_appends_equal_a_full_retrain(spark, parts, tmp_path, monkeypatch):
    monkeypatch.setattr(C.fit_boosted, "__defaults__", (6,))
    folder, models = str(tmp_path / "state"), str(tmp_path / "models")
    for i, part in enumerate(parts):
        assert training.append(spark, folder, part, f"day {i}", "row_id") == i + 1
    got = training.fit(spark, folder, model_folder=models)
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True)
    full = retrain(whole, None, "row_id", str(tmp_path / "other"))
    assert got.severity.model.starts == full.severity.model.starts
    trees = [[t for r in m.severity.model.trees for t in r] for m in (got, full)]
    assert all((a == b).all() for one, other in zip(*trees) for a, b in zip(one, other))
    assert rows(got.severity.metrics) == rows(full.severity.metrics)
    same_fit(got.poisson, full.poisson)
    same_fit(got.negative_binomial, full.negative_binomial)
    for path in (f"{models}/{got.severity.version}", f"{tmp_path}/other/{full.severity.version}"):
        same_fit(R.load_fit(spark, f"{path}/poisson"), full.poisson)
        same_fit(R.load_fit(spark, f"{path}/negative_binomial"), full.negative_binomial)
    assert C.load(spark, models).version == got.severity.version


def test_a_batch_counts_once_and_versions_stay(spark, parts, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(ValueError):
        training.state(spark, folder)
    assert [training.append(spark, folder, p, b, "row_id") for p, b in zip([*parts[:2], parts[0]], "aba")] == [1, 2, 1]
    n = [p.count() for p in parts[:2]]
    totals = [training.state(spark, folder, v).counts.agg(F.sum("n")).first()[0] for v in (1, 2, None)]
    assert totals == [n[0], sum(n), sum(n)]
    assert rows(training.state(spark, folder, 1).severity) == rows(C.severity_profiles(parts[0], "row_id"))
    half = spark.createDataFrame([(3, "c", "state-nowhere")], training._LOG_DDL)
    assert training.state(spark, folder).version == 2  # what is not in the log does not count
    half.write.mode("append").parquet(f"{folder}/log")
    assert [r["version"] for r in training._log(spark, folder)] == [1, 2, 3]


def test_nothing_is_lost_without_rows(spark, parts, tmp_path):
    training.append(spark, str(tmp_path), parts[0], "a", "row_id")
    training.append(spark, str(tmp_path), parts[1].limit(0), "empty", "row_id")
    assert rows(training.state(spark, str(tmp_path)).counts) == rows(R.count_profiles(parts[0]))
