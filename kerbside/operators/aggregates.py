"""Counts, monthly tables, filters and group comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside import schema as S
from kerbside.functions import scalars as X
from kerbside.operators.quantiles import exact_quantiles
from kerbside.session import materialise


def severity_distribution(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in S.SEVERITIES])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def most_common(df: DataFrame, column: str) -> Column:
    """Most frequent non-null value (smallest on ties) as a scalar subquery."""
    counted = value_counts(df.where(F.col(column).isNotNull()), column)
    best = counted.agg(F.min(F.struct((-F.col("n")).alias("n"), column)).alias("best"))
    return best.select(f"best.{column}").scalar()


def by_month(df: DataFrame, **measures: Column) -> DataFrame:
    """One row per calendar month 1-12; months without rows show 0."""
    months = df.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    sums = df.groupBy("month").agg(*[c.alias(k) for k, c in measures.items()])
    return months.join(sums, "month", "left").select(
        "month", *[F.coalesce(k, F.lit(0)).alias(k) for k in measures]
    )


def monthly_severity(df: DataFrame) -> DataFrame:
    return by_month(df, **{s.lower(): F.count_if(F.col("severity") == s) for s in S.SEVERITIES})


def monthly_totals(df: DataFrame) -> DataFrame:
    return by_month(
        df,
        accidents=F.count("severity"),
        casualties=F.sum("num_casualties"),
        deaths=F.count_if(F.col("severity") == "Fatal"),
    )


def filter_options(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct values per column, long form (column, value)."""
    names = columns or ["severity", "weather", "road_type"]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in names])
    return df.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def map_filter(
    df: DataFrame,
    severity: list[str] | None = None,
    weather: list[str] | None = None,
    road_type: list[str] | None = None,
) -> DataFrame:
    """Rows whose values are among the chosen ones; ``None`` leaves a column unfiltered."""
    chosen = {"severity": severity, "weather": weather, "road_type": road_type}
    for column, values in chosen.items():
        if values is not None:
            df = df.where(F.col(column).isin(values))
    return df


def map_markers(df: DataFrame) -> DataFrame:
    return df.select(
        "accident_id", "latitude", "longitude", "severity", "weather", "road_type",
        "num_casualties", X.marker_colour(F.col("severity")).alias("colour"),
        F.concat_ws(" - ", "severity", "weather").alias("tooltip"),
    )


def anomalous_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("is_anomaly"))


def groups_above_median(df: DataFrame, group: str, measure: str) -> DataFrame:
    """Groups whose mean lies strictly above the median of all group means."""
    means = materialise(
        df.where(F.col(group).isNotNull()).groupBy(group)
        .agg(F.avg(measure).alias("mean_score")), "group-means",
    )
    middle = exact_quantiles(means, ["mean_score"])["mean_score"]
    return means.where(F.col("mean_score") > F.lit(middle))


def importance_shares(importances: DataFrame) -> DataFrame:
    """Add each feature's percentage of the total importance."""
    total = importances.agg(F.sum("importance")).scalar()
    return importances.withColumn("percentage", F.try_divide("importance", total) * 100)


def top_importances(importances: DataFrame, k: int = 8) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(k)


def explain_features(importances: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` strongest features in plain words."""
    top = top_importances(importances, k)
    default = F.concat(X.base_feature(F.col("feature")), F.lit(" affects accident outcomes"))
    return top.select(
        X.feature_title(F.col("feature")).alias("feature"),
        X.round1(F.col("importance") * 100).alias("importance"),
        X.impact_band(F.col("importance")).alias("impact"),
        X.pick(F.col("feature"), S.FEATURE_TEXT, default).alias("explanation"),
    )
