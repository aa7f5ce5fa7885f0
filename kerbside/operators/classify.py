"""Severity classifiers: training, selection, scoring and model storage.

Boosted trees and the logistic model treat equal rows alike, so training data
is counted per distinct (features, label) first and fitted with weights. The
random forest resamples single rows: up to ``FOREST_ROWS`` of them it is Spark
ML's, beyond that the same bootstrap is drawn per count (``operators.forest``).
"""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside import schema as S
from kerbside.functions import scalars as X
from kerbside.operators import boosting, forest
from kerbside.operators.encoding import alphabetical_codes, apply_codes
from kerbside.operators.joins import BROADCAST_ROWS
from kerbside.session import materialise, working_tables

NUMERIC = ["speed_limit", "num_vehicles", "num_casualties"]
FOREST_ROWS = 500_000
BASE_FEATURES = [*NUMERIC, "is_weekend", "hour", "day_of_week", "month"]
_METRICS_DDL = "model_no INT, model_name STRING, accuracy DOUBLE, f1_score DOUBLE"


class SeverityModel(NamedTuple):
    name: str
    model: PipelineModel | boosting.BoostedTrees | forest.Forest
    features: list[str]
    labels: list[str]        # label text per code
    encodings: DataFrame     # (column, value, code)
    metrics: DataFrame       # one row per candidate
    importances: DataFrame   # (feature, importance)
    version: str


# -- data ----------------------------------------------------------------------

def feature_names(columns: list[str]) -> list[str]:
    """Base features that are present, then every encoded column."""
    return [c for c in BASE_FEATURES if c in columns] + [c for c in columns if c.endswith("_encoded")]


def standard_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as population z-scores; a constant column becomes 0."""
    moments = df.agg(F.struct(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")).alias(c) for c in columns
    ]).alias("m")).scalar()
    scored = {
        c: F.coalesce(
            F.try_divide(F.col(c) - F.col(f"_moments.{c}.mean"), F.col(f"_moments.{c}.sd")), F.lit(0.0)
        )
        for c in columns
    }
    return df.withColumn("_moments", moments).withColumns(scored).drop("_moments")


_DRAW_BITS = 28  # seven hexadecimal digits
TRAIN_SHARE = 0.8


def draw_number(key: str, seed: int) -> Column:
    """Whole number below 2^28 fixed by row key and seed."""
    mixed = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(mixed, 1, _DRAW_BITS // 4), 16, 10).cast("long")


def split(df: DataFrame, key: str, seed: int = 42, share: float = TRAIN_SHARE, by: str | None = None):
    """(train, test) by hash of the row key; ``by`` keeps the share within each class.

    The threshold of a class is the exact draw below which ``share`` of its
    rows lie, so the parts do not depend on partitioning. It is found in two
    rounds of counts per class over the high and the low half of the draw.
    """
    drawn = df.withColumn("_draw", draw_number(key, seed))
    if by is None:
        inside = F.col("_draw") < share * (1 << _DRAW_BITS)
        return drawn.where(inside).drop("_draw"), drawn.where(~inside).drop("_draw")
    half = _DRAW_BITS // 2
    places = drawn.select(F.col(by).alias("_class"), F.shiftright("_draw", half).alias("_high"), "_draw")
    ranked = Window.partitionBy("_class").orderBy("_high").rowsBetween(Window.unboundedPreceding, 0)
    high = places.groupBy("_class", "_high").agg(F.count(F.lit(1)).alias("n"))  # 2^14 rows per class at most
    total = F.sum("n").over(Window.partitionBy("_class"))
    high = high.select("_class", "_high", "n", F.sum("n").over(ranked).alias("upto"), F.ceil(total * share).alias("rank"))
    crossed = high.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select(
        F.col("_class").alias("_c"), F.col("_high").alias("_h"), (F.col("rank") - F.col("upto") + F.col("n")).alias("rest"))
    low = places.join(crossed, F.col("_class").eqNullSafe(F.col("_c")) & (F.col("_high") == F.col("_h")))
    low = low.groupBy("_class", "rest", "_draw").agg(F.count(F.lit(1)).alias("n"))
    ranked = Window.partitionBy("_class").orderBy("_draw").rowsBetween(Window.unboundedPreceding, 0)
    low = low.withColumn("upto", F.sum("n").over(ranked)).where(F.col("upto") >= F.col("rest"))
    cuts = materialise(low.groupBy(F.col("_class").alias("_c")).agg(F.min("_draw").alias("_cut")), "cuts")
    if cuts.count() <= BROADCAST_ROWS:
        cuts = F.broadcast(cuts)
    judged = drawn.join(cuts, F.col(by).eqNullSafe(F.col("_c")))
    inside = F.col("_draw") <= F.col("_cut")
    return tuple(judged.where(part).drop("_draw", "_cut", "_c") for part in (inside, ~inside))


def _counted(df: DataFrame, features: list[str], rows: str | None = None) -> DataFrame:
    """Rows per (features, label); column ``rows`` says for how many rows of the data one stands."""
    n = F.sum(rows) if rows else F.count(F.lit(1))
    return materialise(df.groupBy(*features, "label").agg(n.cast("double").alias("weight")), "counted")


def _numbers(df: DataFrame, features: list[str], label: Column, *others: str) -> DataFrame:
    """Features as doubles with gaps as 0, and the label."""
    doubles = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features]
    return df.select(*others, *doubles, label.cast("double").alias("label"))


# -- candidates ------------------------------------------------------------------

def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features")


def fit_boosted(
    counted: DataFrame, features: list[str], classes: int, depth: int, rounds: int = 100
) -> boosting.BoostedTrees:
    """Second-order boosted trees, one per class and round."""
    return boosting.fit(counted, features, classes, depth, rounds)


def fit_forest(
    rows: DataFrame, counted: DataFrame, features: list[str], classes: int, most: int = FOREST_ROWS
) -> PipelineModel | forest.Forest:
    """100 trees of depth 10; Spark ML's forest visits every row for every tree and level, so more than ``most`` are counted."""
    if (counted.agg(F.sum("weight")).first()[0] or 0) > most:
        return forest.fit(counted, features, classes)
    assembler = _assembler(features)
    trees = RandomForestClassifier(numTrees=100, maxDepth=10, seed=42, labelCol="label")
    return PipelineModel([assembler, trees.fit(assembler.transform(rows))])


def fit_logistic(rows: DataFrame, counted: DataFrame, features: list[str]) -> PipelineModel:
    """Multinomial logistic model on standardised features, L2 penalty of unit strength."""
    assembler = _assembler(features)
    scaler = StandardScaler(
        inputCol="features", outputCol="scaled", withMean=True, withStd=True
    ).fit(assembler.transform(rows))
    total = counted.agg(F.sum("weight")).first()[0]
    model = LogisticRegression(
        family="multinomial", maxIter=1000, regParam=1.0 / total, elasticNetParam=0.0,
        standardization=False, featuresCol="scaled", labelCol="label", weightCol="weight",
    ).fit(scaler.transform(assembler.transform(counted)))
    return PipelineModel([assembler, scaler, model])


def score(model: PipelineModel | boosting.BoostedTrees | forest.Forest, df: DataFrame) -> DataFrame:
    """Add ``prediction`` and ``probabilities``; works on streams."""
    if isinstance(model, PipelineModel):
        return model.transform(df).withColumn("probabilities", vector_to_array("probability"))
    best = F.array_position("probabilities", F.array_max("probabilities")) - 1
    shares = boosting if isinstance(model, boosting.BoostedTrees) else forest
    return df.withColumn("probabilities", shares.probabilities(model)).withColumn("prediction", best.cast("double"))


def evaluate(model: PipelineModel | boosting.BoostedTrees | forest.Forest, counted: DataFrame) -> tuple[float, float]:
    """(accuracy, weighted F1) from the confusion counts, one pass."""
    cells = {
        (r["label"], r["prediction"]): r["n"]
        for r in score(model, counted).groupBy("label", "prediction")
        .agg(F.sum("weight").alias("n")).collect()
    }
    total = sum(cells.values())
    if not total:
        return 0.0, 0.0
    right = sum(n for (a, b), n in cells.items() if a == b)
    f1 = 0.0
    for label in {a for a, _ in cells}:
        hit = cells.get((label, label), 0.0)
        actual = sum(n for (a, _), n in cells.items() if a == label)
        predicted = sum(n for (_, b), n in cells.items() if b == label)
        f1 += actual / total * (2 * hit / (actual + predicted))
    return right / total, f1


def importance_table(
    spark: SparkSession, model: PipelineModel | boosting.BoostedTrees | forest.Forest, features: list[str]
) -> DataFrame:
    """Tree importances, or mean absolute coefficients of a logistic model."""
    if isinstance(model, boosting.BoostedTrees):
        values = boosting.importances(model)
    elif isinstance(model, forest.Forest):
        values = forest.importances(model)
    elif hasattr(model.stages[-1], "featureImportances"):
        values = model.stages[-1].featureImportances.toArray()
    else:
        values = abs(model.stages[-1].coefficientMatrix.toArray()).mean(axis=0)
    return spark.createDataFrame(
        [(f, float(v)) for f, v in zip(features, values, strict=True)], "feature STRING, importance DOUBLE"
    )


def best_model(metrics: DataFrame) -> DataFrame:
    """Highest F1, the earlier model on ties."""
    return metrics.orderBy(F.desc("f1_score"), "model_no").limit(1)


def new_version(now: datetime | None = None) -> str:
    return (now or datetime.now()).strftime("%Y%m%d_%H%M%S_%f")


# -- training jobs ------------------------------------------------------------------

def severity_profiles(df: DataFrame, key: str = "accident_id", seed: int = 42) -> DataFrame:
    """Rows ``n`` per distinct (inputs, severity) and side of the split (``train``); rows without severity are left out.

    A row's side depends on its key alone, so profiles of two tables add up to
    those of both.
    """
    numeric = [c for c in NUMERIC if c in df.columns]
    columns = [*numeric, *[c for c in S.LABEL_COLUMNS if c in df.columns], "severity"]
    train = draw_number(key, seed) < TRAIN_SHARE * (1 << _DRAW_BITS)
    doubles = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric}
    return (
        df.where("severity IS NOT NULL").select(*[doubles.get(c, F.col(c)).alias(c) for c in columns], train.alias("train"))
        .groupBy(*columns, "train").agg(F.count(F.lit(1)).alias("n"))
    )


def train_severity(
    df: DataFrame, key: str = "accident_id", seed: int = 42, version: str | None = None
) -> SeverityModel:
    """Boosted trees of depth 5 on three counts and five alphabetically coded categories."""
    with working_tables() as keep:
        profiles = materialise(severity_profiles(df, key, seed), "profiles")
        return _train_from_profiles(profiles, version, keep)


def train_from_profiles(profiles: DataFrame, version: str | None = None) -> SeverityModel:
    """The model of ``train_severity`` from the (added up) ``severity_profiles`` of its rows."""
    with working_tables() as keep:
        return _train_from_profiles(profiles, version, keep)


def _train_from_profiles(profiles: DataFrame, version: str | None, keep: list[DataFrame]) -> SeverityModel:
    spark = profiles.sparkSession
    coded = [c for c in S.LABEL_COLUMNS if c in profiles.columns]
    features = [c for c in NUMERIC if c in profiles.columns] + [f"{c}_encoded" for c in coded]
    if len(features) < 2:
        raise ValueError("Insufficient features")
    encodings = materialise(alphabetical_codes(profiles, [*coded, "severity"]), "encodings")
    keep.append(encodings)
    labels = [
        r["value"] for r in encodings.where("column = 'severity'").orderBy("code").limit(boosting.CLASSES + 1).collect()
    ]
    table = _numbers(apply_codes(profiles, encodings), features, F.col("severity_encoded"), "train", "n")
    model = fit_boosted(_counted(table.where("train"), features, "n"), features, len(labels), depth=5)
    accuracy, f1 = evaluate(model, _counted(table.where("NOT train"), features, "n"))
    name = "Boosted Trees"
    return SeverityModel(
        name, model, features, labels, encodings.where("column <> 'severity'"),
        spark.createDataFrame([(1, name, accuracy, f1)], _METRICS_DDL),
        importance_table(spark, model, features), version or new_version(),
    )


def train_and_select(
    df: DataFrame, encodings: DataFrame, key: str = "accident_id", seed: int = 42,
    version: str | None = None, boosted: bool = True,
) -> SeverityModel:
    """Logistic model, random forest and boosted trees on a processed table; best F1 wins.

    ``df`` carries the derived and encoded columns (see ``plans.features.process``).
    A missing label takes the most frequent one.
    """
    with working_tables() as keep:
        kept = materialise(encodings.select("column", "value", "code"), "encodings")
        keep.append(kept)
        return _train_and_select(df, kept, key, seed, version, boosted)


def _train_and_select(
    df: DataFrame, encodings: DataFrame, key: str, seed: int, version: str | None, boosted: bool
) -> SeverityModel:
    spark = df.sparkSession
    features = feature_names(df.columns)
    code = X.severity_code(F.col("severity"))
    counts = df.groupBy(code.alias("label")).count().where("label IS NOT NULL")
    usual = counts.orderBy(F.desc("count"), "label").first()
    label = F.coalesce(code, F.lit(usual["label"] if usual else 0))
    table = materialise(_numbers(df, features, label, key), "training")
    train, test = split(table, key, seed, by="label")
    counted, held_out = _counted(train, features), _counted(test, features)
    candidates = [
        ("Logistic Regression", fit_logistic(train, counted, features)),
        ("Random Forest", fit_forest(train, counted, features, len(S.SEVERITIES))),
    ]
    if boosted:
        candidates.append(("Boosted Trees", fit_boosted(counted, features, len(S.SEVERITIES), depth=6)))
    rows = [(i, name, *evaluate(m, held_out)) for i, (name, m) in enumerate(candidates, start=1)]
    metrics = spark.createDataFrame(rows, _METRICS_DDL)
    name = best_model(metrics).first()["model_name"]
    model = dict(candidates)[name]
    return SeverityModel(
        name, model, features, S.SEVERITIES, encodings.select("column", "value", "code"), metrics,
        importance_table(spark, model, features), version or new_version(),
    )


def confidence_report(metrics: DataFrame, sample_size: int) -> DataFrame:
    n, accuracy = F.lit(sample_size), F.col("accuracy")
    return metrics.withColumns({
        "sample_size": n, "level": X.confidence_level(accuracy, n),
        "color": X.confidence_colour(accuracy, n), "description": X.confidence_text(accuracy, n),
    })


# -- scoring ------------------------------------------------------------------------

def predict(df: DataFrame, trained: SeverityModel) -> DataFrame:
    """Add predicted severity, its code and class probabilities; batch or stream.

    Unknown category values count as code 0, absent features as 0.
    """
    own = df.columns
    table = apply_codes(df, trained.encodings, unknown=0)
    inputs = {
        c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in table.columns else F.lit(0.0)
        for c in trained.features
    }
    held = F.struct(*[F.col(c) for c in own]).alias("_own")
    scored = score(trained.model, table.select(held, *[e.alias(c) for c, e in inputs.items()]))
    code = F.col("prediction").cast("int")
    names = F.array(*[F.lit(x) for x in trained.labels])
    return scored.select(
        "_own.*", F.coalesce(F.get(names, code), F.lit("Unknown")).alias("predicted_severity"),
        code.alias("severity_code"), "probabilities",
    )


# -- storage -------------------------------------------------------------------------

def save(trained: SeverityModel, folder: str) -> str:
    """Write a versioned copy and point ``latest`` at it."""
    spark = trained.encodings.sparkSession
    path = f"{folder}/{trained.version}"
    grown, counted = isinstance(trained.model, boosting.BoostedTrees), isinstance(trained.model, forest.Forest)
    if grown or counted:
        (boosting if grown else forest).save(trained.model, spark, f"{path}/model")
    else:
        trained.model.write().overwrite().save(f"{path}/model")
    trained.encodings.write.mode("overwrite").parquet(f"{path}/encodings")
    trained.metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    trained.importances.write.mode("overwrite").parquet(f"{path}/importances")
    about = spark.createDataFrame(
        [(trained.name, trained.features, trained.labels, trained.version, grown, counted)],
        "name STRING, features ARRAY<STRING>, labels ARRAY<STRING>, version STRING, boosted BOOLEAN, forest BOOLEAN",
    )
    about.write.mode("overwrite").parquet(f"{path}/about")
    about.select("version").write.mode("overwrite").parquet(f"{folder}/latest")
    return path


def load(spark: SparkSession, folder: str, version: str | None = None) -> SeverityModel:
    version = version or spark.read.parquet(f"{folder}/latest").first()["version"]
    path = f"{folder}/{version}"
    about = spark.read.parquet(f"{path}/about").first()
    if about["boosted"]:
        model = boosting.load(spark, f"{path}/model")
    elif "forest" in about and about["forest"]:  # models stored earlier lack the column
        model = forest.load(spark, f"{path}/model")
    else:
        model = PipelineModel.load(f"{path}/model")
    return SeverityModel(
        about["name"], model, list(about["features"]), list(about["labels"]),
        spark.read.parquet(f"{path}/encodings"), spark.read.parquet(f"{path}/metrics"),
        spark.read.parquet(f"{path}/importances"), about["version"],
    )
