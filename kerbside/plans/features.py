"""Derived columns of the accident table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.functions import scalars as X
from kerbside.operators.cleaning import Optimised, clean, optimise
from kerbside.operators.encoding import apply_codes, first_seen_codes


def add_time_features(df: DataFrame) -> DataFrame:
    if "date" in df.columns:
        df = df.withColumn("date", X.date_of(F.col("date")))
        weekday = X.day_of_week(F.col("date"))
        df = df.withColumns({
            "day_of_week": weekday,
            "month": F.month("date"),
            "is_weekend": F.coalesce(weekday.isin(5, 6), F.lit(False)).cast("int"),
        })
    if "time" in df.columns:
        hour = X.hour_of(F.col("time"))
        df = df.withColumns({"hour": hour, "time_of_day": X.time_of_day(hour)})
    return df


def add_severity_score(df: DataFrame) -> DataFrame:
    return df.withColumn("severity_score", X.severity_score(df.columns))


def add_risk_index(df: DataFrame) -> DataFrame:
    """Severity score times three exposure factors, scaled so the largest is 100.

    The raw product is kept as an exact integer (factors in tenths); the
    maximum is a scalar subquery: one partial aggregate, no window, no join.
    """
    scored = add_severity_score(df)
    raw = F.col("severity_score") * X.road_tenths() * X.light_tenths() * X.surface_tenths()
    largest = scored.agg(F.when(F.max(raw) > 0, F.max(raw)).alias("largest")).scalar()
    return scored.withColumns({
        "road_risk_factor": X.road_tenths() / 10,
        "light_risk_factor": X.light_tenths() / 10,
        "surface_risk_factor": X.surface_tenths() / 10,
        "risk_index": F.coalesce(raw / largest * 100, raw / 10000),
    })


def add_risk_level(df: DataFrame) -> DataFrame:
    return df.withColumn("risk_level", X.risk_level(F.col("risk_index")))


def derive(df: DataFrame) -> DataFrame:
    """Time features, scores and risk index on a standardised table."""
    return add_risk_index(add_time_features(df))


def process(df: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Clean, derive and encode; returns (table, encodings)."""
    table = add_time_features(clean(df))
    encodings = first_seen_codes(table, order)
    return add_risk_index(apply_codes(table, encodings)), encodings


def process_upload(
    df: DataFrame, order: list[str] | None = None, encode: bool = False
) -> tuple[DataFrame, Optimised]:
    """Standardise an uploaded table, then derive: returns (derived table, what was changed).

    With ``encode`` the category columns also get their codes, by first appearance in the order of the identifiers.
    """
    optimised = optimise(df, order)
    table = derive(optimised.data)
    if encode:
        table = apply_codes(table, first_seen_codes(table, "accident_id"))
    return table, optimised
