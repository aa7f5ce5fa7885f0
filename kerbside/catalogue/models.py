"""Registered queries on statistical models, with checking SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside import schema as S
from kerbside.catalogue.adapters import accidents, with_accidents
from kerbside.catalogue.batch import derived, r6
from kerbside.functions import scalars as X
from kerbside.operators import aggregates as G
from kerbside.operators import anomaly as A
from kerbside.operators import classify as C
from kerbside.operators import regression as R
from kerbside.operators.encoding import apply_codes, first_seen_codes
from kerbside.plans import features as V
from kerbside.plans import training
from kerbside.plans.retrain import retrain as retrain_job
from kerbside.session import scratch_path
from kerbside.streaming.incidents import run_available

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_STORED: dict[tuple[str, str, str], str] = {}  # folders of stored models


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function
    return register


def _stored(spark, sf: str, kind: str, train) -> C.SeverityModel:
    """The stored model of that kind, read from its folder; trained on the tables of ``sf`` when first asked for."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _STORED:
        folder = scratch_path(spark, f"models-{kind}")
        C.save(train(), folder)
        _STORED[key] = folder
    return C.load(spark, _STORED[key])


def severity_model(spark, sf):
    return _stored(spark, sf, "severity", lambda: C.train_severity(derived(spark, sf), "row_id"))


def selected_model(spark, sf):
    def train():
        table = V.add_time_features(accidents(spark, sf))
        encodings = first_seen_codes(table, "row_id")
        return C.train_and_select(apply_codes(table, encodings), encodings, "row_id")
    return _stored(spark, sf, "selected", train)


@query("poisson")
def poisson(spark, sf):
    return R.fit_poisson(accidents(spark, sf)).stats


@query("poisson_coefficients")
def poisson_coefficients(spark, sf):
    return R.fit_poisson(accidents(spark, sf)).coefficients


@query("negative_binomial")
def negative_binomial(spark, sf):
    return R.fit_negative_binomial(accidents(spark, sf)).stats


@query("anomalies")
def anomalies(spark, sf):
    found = A.detect_anomalies(accidents(spark, sf), 0.1).data
    return G.anomalous_rows(found).select("accident_id", "severity", "weather", "road_type", "num_casualties")


@query("anomaly_stats")
def anomaly_stats(spark, sf):
    return A.detect_anomalies(accidents(spark, sf), 0.1).stats


# ---- cases with a closed form: the fits themselves are checked in SQL -------------------

def _r4(column: str):
    return F.floor(F.col(column) * 1e4 + 0.5) / 1e4


@query("poisson_groups", with_accidents("""
, means AS (SELECT weather, avg(cast(num_casualties AS double)) AS m FROM accidents GROUP BY weather),
first AS (SELECT m AS m0, weather AS w0 FROM means ORDER BY weather LIMIT 1)
SELECT CASE WHEN weather = w0 THEN 'const' ELSE 'weather_' || weather END AS feature,
 floor(CASE WHEN weather = w0 THEN ln(m0) ELSE ln(m / m0) END * 1e4 + 0.5) / 1e4 AS coefficient FROM means, first"""))
def poisson_groups(spark, sf):
    """One categorical input: the constant and the log ratios of the group means."""
    fit = R.fit_poisson(accidents(spark, sf).select("num_casualties", "weather"))
    return fit.coefficients.select("feature", _r4("coefficient").alias("coefficient"))


@query("negative_binomial_groups", with_accidents("""
, means AS (SELECT avg(CASE WHEN num_vehicles <= 2 THEN cast(num_casualties AS double) END) AS m0,
 avg(CASE WHEN num_vehicles > 2 THEN cast(num_casualties AS double) END) AS m1 FROM accidents)
SELECT 'const' AS feature, floor(ln(m0) * 1e4 + 0.5) / 1e4 AS coefficient FROM means
UNION ALL SELECT 'num_vehicles', floor(ln(m1 / m0) * 1e4 + 0.5) / 1e4 FROM means"""))
def negative_binomial_groups(spark, sf):
    """One 0/1 input: the same two numbers as for any count model with a log link."""
    many = (F.col("num_vehicles") > 2).cast("int").alias("num_vehicles")
    fit = R.fit_negative_binomial(accidents(spark, sf).select("num_casualties", many))
    return fit.coefficients.select("feature", _r4("coefficient").alias("coefficient"))


@query("anomalies_planted", with_accidents(" SELECT row_id FROM accidents WHERE row_id % 100 = 0"))
def anomalies_planted(spark, sf):
    """One row in a hundred lies far out in both columns; exactly those are flagged."""
    far = F.col("row_id") % 100 == 0
    planted = accidents(spark, sf).select(
        "row_id", F.when(far, 1000 + F.col("row_id") % 700).otherwise(F.col("speed_limit")).alias("speed_limit"),
        F.when(far, 500 + F.col("row_id") % 900).otherwise(F.col("num_vehicles")).alias("num_vehicles"))
    return A.detect_anomalies(planted, 0.01).data.where("is_anomaly").select("row_id")


_BY_SPEED = "CASE WHEN speed_limit >= 60 THEN 'Fatal' WHEN speed_limit >= 50 THEN 'Serious' ELSE 'Minor' END"


@query("severity_by_speed", with_accidents(
    f" SELECT speed_limit, {_BY_SPEED} AS predicted_severity, count(*) AS n, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS f1_score FROM accidents GROUP BY 1, 2"))
def severity_by_speed(spark, sf):
    """Severity fixed by the speed limit: every prediction is right, and so are the metrics."""
    table = accidents(spark, sf).select(
        "row_id", "speed_limit", F.lit(1).alias("num_vehicles"), F.expr(_BY_SPEED).alias("severity"))
    trained = C.train_severity(table, "row_id")
    predicted = C.predict(table, trained).groupBy("speed_limit", "predicted_severity").agg(F.count(F.lit(1)).alias("n"))
    return predicted.crossJoin(F.broadcast(trained.metrics.select("accuracy", "f1_score")))  # one row of metrics


_BY_ROAD = "CASE WHEN road_type = 'Urban' THEN 'Minor' WHEN road_type = 'Rural' THEN 'Serious' ELSE 'Fatal' END"
_ROADS = """(SELECT row_id, num_vehicles, CASE WHEN row_id % 7 <> 0 THEN road_type END AS road_type FROM accidents)"""
_ROAD_SQL = with_accidents(f""" SELECT road_type, {_BY_ROAD} AS predicted_severity, count(*) AS n FROM {_ROADS} GROUP BY ALL
 UNION ALL SELECT 'Tunnel', 'Fatal', count(*) FROM accidents""")


def _road_model(spark, sf):
    """Severity fixed by a coded column with gaps; trained, stored and loaded. A gap counts as code 0, Motorway."""
    gap = F.when(F.col("row_id") % 7 != 0, F.col("road_type")).alias("road_type")
    table = accidents(spark, sf).select("row_id", "num_vehicles", gap).withColumn("severity", F.expr(_BY_ROAD))
    folder = scratch_path(spark, "model-roads")
    C.save(C.train_severity(table, "row_id"), folder)
    unknown = table.withColumn("road_type", F.lit("Tunnel"))  # never seen: code 0 as well
    return table.unionByName(unknown).drop("severity"), C.load(spark, folder)


@query("severity_by_road", _ROAD_SQL)
def severity_by_road(spark, sf):
    table, model = _road_model(spark, sf)
    return C.predict(table, model).groupBy("road_type", "predicted_severity").agg(F.count(F.lit(1)).alias("n"))


@query("stream_severity_by_road", _ROAD_SQL)
def stream_severity_by_road(spark, sf):
    table, model = _road_model(spark, sf)
    path = scratch_path(spark, "landed-roads")
    table.write.parquet(path)
    scored = C.predict(spark.readStream.schema(table.schema).parquet(path), model)
    done = run_available(scored.select("row_id", "road_type", "predicted_severity"), "road-scores")
    return done.groupBy("road_type", "predicted_severity").agg(F.count(F.lit(1)).alias("n"))


@query("severity_evaluation", with_accidents(f"""
, test AS (SELECT {_BY_SPEED} AS predicted, CASE WHEN row_id % 10 = 0 THEN 'Serious' ELSE {_BY_SPEED} END AS actual
 FROM accidents WHERE substr(md5(cast(row_id AS string) || ':42'), 1, 7) > 'ccccccc'),
labels AS (SELECT DISTINCT actual AS label FROM test),
parts AS (SELECT label, count(*) FILTER (WHERE actual = label) AS a, count(*) FILTER (WHERE predicted = label) AS p,
 count(*) FILTER (WHERE actual = label AND predicted = label) AS hit FROM labels, test GROUP BY label)
SELECT floor((SELECT avg(cast(predicted = actual AS int)) FROM test) * 1e6 + 0.5) / 1e6 AS accuracy,
 floor(sum(a / (SELECT count(*) FROM test)::DOUBLE * 2 * hit / (a + p)) * 1e6 + 0.5) / 1e6 AS f1_score FROM parts"""))
def severity_evaluation(spark, sf):
    """One label in ten is off: the model learns the rule, and the metrics count what departs from it among the held-out rows."""
    label = F.when(F.col("row_id") % 10 == 0, "Serious").otherwise(F.expr(_BY_SPEED))
    table = accidents(spark, sf).select("row_id", "speed_limit", F.lit(1).alias("num_vehicles"), label.alias("severity"))
    return C.train_severity(table, "row_id").metrics.select(*[
        (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in ("accuracy", "f1_score")])


@query("candidates_by_speed", with_accidents("""
 SELECT * FROM (VALUES (2, 'Random Forest', 1.0::DOUBLE, 1.0::DOUBLE), (3, 'Boosted Trees', 1.0::DOUBLE, 1.0::DOUBLE))
 t(model_no, model_name, accuracy, f1_score) WHERE (SELECT count(*) FROM accidents) > 0"""))
def candidates_by_speed(spark, sf):
    """Both kinds of trees find a severity that the speed limit decides."""
    table = accidents(spark, sf).select("row_id", "speed_limit", "num_vehicles", "weather", F.expr(_BY_SPEED).alias("severity"))
    encodings = first_seen_codes(table, "row_id", ["weather"])
    trained = C.train_and_select(apply_codes(table, encodings), encodings, "row_id")
    return trained.metrics.where("model_no > 1")


@query("anomalies_gaps", with_accidents("""
 SELECT row_id % 100 = 1 AS gap, row_id % 100 = 0 AS is_anomaly, count(*) AS n FROM accidents GROUP BY ALL"""))
def anomalies_gaps(spark, sf):
    """Rows with a gap are neither judged nor lost."""
    place = F.col("row_id") % 100
    planted = accidents(spark, sf).select(
        "row_id", F.when(place == 0, 1000 + F.col("row_id") % 700).when(place != 1, F.col("speed_limit")).alias("speed_limit"),
        F.when(place == 0, 500 + F.col("row_id") % 900).otherwise(F.col("num_vehicles")).alias("num_vehicles"))
    found = A.detect_anomalies(planted, 1 / 99).data
    return found.groupBy(F.col("speed_limit").isNull().alias("gap"), "is_anomaly").agg(F.count(F.lit(1)).alias("n"))


# ---- reports on figures of models, with figures counted from the accidents ---------------------

def _text_rows(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in row) + ")" for row in rows)


_SIZES = "length(bin(row_id + 1)) AS size_class"  # groups of 1, 2, 4, ... rows
_RIGHT = "avg(CASE WHEN (row_id * 7) % 20 < 13 + length(bin(row_id + 1)) % 8 THEN cast(1 AS double) ELSE 0 END)"


@query("confidence_bands", with_accidents(f"""
, figures AS (SELECT {_SIZES}, count(*) AS n, {_RIGHT}::DOUBLE AS accuracy FROM accidents GROUP BY 1),
texts(level, color, description) AS (VALUES {_text_rows(S.CONFIDENCE)})
SELECT size_class, n, floor(accuracy * 1e6 + 0.5) / 1e6 AS accuracy, level, color, description
FROM figures JOIN texts ON level = CASE WHEN accuracy >= 0.9 AND n >= 100 THEN 'High'
 WHEN accuracy >= 0.75 AND n >= 50 THEN 'Medium' ELSE 'Low' END"""))
def confidence_bands(spark, sf):
    figures = accidents(spark, sf).groupBy(F.expr(_SIZES)).agg(
        F.count(F.lit(1)).alias("n"), F.expr(_RIGHT).cast("double").alias("accuracy"))
    accuracy, n = F.col("accuracy"), F.col("n")
    return figures.select(
        "size_class", "n", (F.floor(accuracy * 1e6 + 0.5) / 1e6).alias("accuracy"), X.confidence_level(accuracy, n).alias("level"),
        X.confidence_colour(accuracy, n).alias("color"), X.confidence_text(accuracy, n).alias("description"))


_PARTS = """CASE WHEN row_id % 20 < 7 THEN 'speed_limit' WHEN row_id % 20 < 12 THEN 'junction_type_encoded'
 WHEN row_id % 20 < 15 THEN 'hour' WHEN row_id % 20 < 17 THEN 'weather_encoded' WHEN row_id % 20 < 18 THEN 'num_vehicles'
 WHEN row_id % 20 < 19 THEN 'road_surface_encoded' ELSE 'num_casualties' END"""
_IMPORTANCES = f"""
, parts AS (SELECT {_PARTS} AS feature, count(*)::DOUBLE / (SELECT count(*) FROM accidents) AS importance FROM accidents GROUP BY 1)"""


def _importances(spark, sf):
    table = accidents(spark, sf)
    total = table.agg(F.count(F.lit(1))).scalar()
    return table.groupBy(F.expr(_PARTS).alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("n")).select(
        "feature", (F.col("n") / total).alias("importance"))


@query("importance_shares", with_accidents(_IMPORTANCES + """
 SELECT feature, importance, floor(importance / (SELECT sum(importance) FROM parts) * 1e8 + 0.5) / 1e6 AS percentage
 FROM parts ORDER BY importance DESC, feature LIMIT 6"""))
def importance_shares(spark, sf):
    return G.top_importances(G.importance_shares(_importances(spark, sf)), 6).withColumn("percentage", r6("percentage"))


@query("importance_texts", with_accidents(_IMPORTANCES + f"""
, texts(name, explanation) AS (VALUES {_text_rows(S.FEATURE_TEXT.items())}),
titles(name, title) AS (VALUES {_text_rows((f, f.replace("_encoded", "").replace("_", " ").title()) for f in [*S.FEATURE_TEXT, "hour"])})
SELECT title AS feature, round_even(importance * 1000, 0) / 10 AS importance, CASE WHEN importance > 0.3 THEN 'Very High'
 WHEN importance > 0.2 THEN 'High' WHEN importance > 0.1 THEN 'Moderate' ELSE 'Low' END AS impact,
 coalesce(explanation, parts.feature || ' affects accident outcomes') AS explanation
FROM (SELECT * FROM parts ORDER BY importance DESC, feature LIMIT 5) parts JOIN titles ON titles.name = feature
LEFT JOIN texts ON texts.name = feature"""))
def importance_texts(spark, sf):
    return G.explain_features(_importances(spark, sf))


_FIGURES = """SELECT num_vehicles AS model_no, concat('model ', cast(num_vehicles AS string)) AS model_name,
 avg(CASE WHEN severity = 'Minor' THEN 1.0 ELSE 0.0 END) AS accuracy,
 max(CASE WHEN num_vehicles IN (2, 4) THEN 0.75 ELSE 0.5 END) AS f1_score FROM {accidents} GROUP BY num_vehicles"""


@query("best_of_equals", with_accidents(
    " SELECT model_no, model_name, f1_score::DOUBLE AS f1_score FROM ("
    + _FIGURES.format(accidents="accidents") + ") ORDER BY f1_score DESC, model_no LIMIT 1"))
def best_of_equals(spark, sf):
    """The earlier one of two equally good models."""
    figures = spark.sql(_FIGURES, accidents=accidents(spark, sf))
    return C.best_model(figures).select("model_no", "model_name", F.col("f1_score").cast("double").alias("f1_score"))


# ---- training from stored counts -------------------------------------------------------------------

def _two_batches(spark, sf):
    table = accidents(spark, sf)
    late = table.drop("junction_type").withColumns({
        "row_id": -F.col("row_id") - 1, "num_casualties": F.col("num_casualties") + F.col("num_vehicles") % 2})
    return table, late


_BOTH = """, both_batches AS (
 SELECT row_id, weather, road_type, light_conditions, road_surface, junction_type, speed_limit, num_vehicles, num_casualties, severity FROM accidents
 UNION ALL SELECT -row_id - 1, weather, road_type, light_conditions, road_surface, NULL, speed_limit, num_vehicles,
  num_casualties + num_vehicles % 2, severity FROM accidents)"""


@query("training_profiles", with_accidents(_BOTH + """
 SELECT cast(speed_limit AS double) AS speed_limit, cast(num_vehicles AS double) AS num_vehicles, cast(num_casualties AS double) AS num_casualties,
 weather, road_type, light_conditions, road_surface, junction_type, severity,
 substr(md5(cast(row_id AS string) || ':42'), 1, 7) <= 'ccccccc' AS train, count(*) AS n FROM both_batches GROUP BY ALL"""))
def training_profiles(spark, sf):
    """Counts after an append, the first batch sent twice."""
    folder, (table, late) = scratch_path(spark, "state"), _two_batches(spark, sf)
    for batch, rows in (("first", table), ("first", table), ("second", late)):
        training.append(spark, folder, rows, batch, "row_id")
    return training.state(spark, folder).severity


@query("retrain_appended", with_accidents(_BOTH + """
, means AS (SELECT weather, avg(cast(num_casualties AS double)) AS m FROM both_batches GROUP BY weather),
first AS (SELECT m AS m0, weather AS w0 FROM means ORDER BY weather LIMIT 1)
SELECT CASE WHEN weather = w0 THEN 'const' ELSE 'weather_' || weather END AS figure,
 floor(CASE WHEN weather = w0 THEN ln(m0) ELSE ln(m / m0) END * 1e4 + 0.5) / 1e4 AS value FROM means, first
UNION ALL SELECT 'accuracy', 1.0 UNION ALL SELECT 'version', 2.0"""))
def retrain_appended(spark, sf):
    """All models refitted from the counts of two batches, without their rows."""
    folder = scratch_path(spark, "state-groups")
    by_weather = F.expr("CASE weather WHEN 'Snow' THEN 'Fatal' WHEN 'Rain' THEN 'Serious' ELSE 'Minor' END")
    for batch, rows in zip(("first", "second"), _two_batches(spark, sf)):
        rows = rows.select("row_id", "weather", "num_casualties", by_weather.alias("severity"))
        training.append(spark, folder, rows, batch, "row_id")
    state = training.state(spark, folder)
    models = training.fit(spark, folder, model_folder=scratch_path(spark, "models-groups"))
    return models.poisson.coefficients.select(F.col("feature").alias("figure"), _r4("coefficient").alias("value")).unionByName(
        models.severity.metrics.select(F.lit("accuracy").alias("figure"), F.col("accuracy").alias("value"))).unionByName(
        spark.createDataFrame([("version", float(state.version))], "figure string, value double"))


@query("stratified_split", with_accidents("""
SELECT severity, count(*) AS n, CASE WHEN place <= ceil(rows * 0.8) THEN 'train' ELSE 'test' END AS part FROM (
 SELECT severity, count(*) OVER (PARTITION BY severity) AS rows,
  count(*) OVER (PARTITION BY severity ORDER BY draw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY severity, draw) + 1 AS place
 FROM (SELECT severity, substr(md5(row_id || ':42'), 1, 7) AS draw FROM accidents)) GROUP BY ALL"""))
def stratified_split(spark, sf):
    train, test = C.split(accidents(spark, sf), "row_id", by="severity")
    sizes = lambda df, part: df.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(part))
    return sizes(train, "train").unionByName(sizes(test, "test"))


@query("severity_model")
def severity_metrics(spark, sf):
    trained = severity_model(spark, sf)
    return C.confidence_report(trained.metrics, accidents(spark, sf).count())


@query("feature_importance")
def feature_importance(spark, sf):
    return G.top_importances(G.importance_shares(severity_model(spark, sf).importances), 8)


@query("explanations")
def explanations(spark, sf):
    return G.explain_features(severity_model(spark, sf).importances)


@query("batch_scores")
def batch_scores(spark, sf):
    return C.predict(derived(spark, sf), severity_model(spark, sf)).select(
        "accident_id", "predicted_severity", "severity_code", "probabilities")


@query("model_comparison")
def model_comparison(spark, sf):
    return selected_model(spark, sf).metrics


@query("best_model")
def best_model(spark, sf):
    trained = selected_model(spark, sf)
    return C.best_model(trained.metrics).withColumn("version", F.lit(trained.version))


@query("best_model_importance")
def best_model_importance(spark, sf):
    return G.importance_shares(selected_model(spark, sf).importances).withColumn(
        "percentage", r6("percentage"))


@query("best_model_scores")
def best_model_scores(spark, sf):
    return C.predict(V.add_time_features(accidents(spark, sf)), selected_model(spark, sf)).select(
        "accident_id", "predicted_severity", "severity_code", "probabilities")


@query("stream_scores")
def stream_scores(spark, sf):
    model = severity_model(spark, sf)
    path = scratch_path(spark, "landed")
    table = accidents(spark, sf)
    table.write.parquet(path)
    stream = spark.readStream.schema(table.schema).parquet(path)
    scored = C.predict(stream, model).select("accident_id", "predicted_severity", "severity_code")
    return run_available(scored, "scores")


@query("retrain")
def retrain(spark, sf):
    table = accidents(spark, sf)
    new = table.drop("junction_type").withColumns({
        "accident_id": F.concat(F.lit("NEW-"), "accident_id"), "row_id": -F.col("row_id") - 1,
    })
    done = retrain_job(table, new, "row_id")
    fits = done.poisson.stats.unionByName(done.negative_binomial.stats).select(
        "model", F.lit("pseudo_r2").alias("measure"), F.col("pseudo_r2").alias("value"))
    return fits.unionByName(done.severity.metrics.select(
        F.col("model_name").alias("model"), F.lit("accuracy").alias("measure"),
        F.col("accuracy").alias("value")))
