"""City-level risk score, 24-hour outlook and dashboard figures (one-row tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions import scalars as X


def _count() -> Column:
    return F.count(F.lit(1))


def score_parts(columns: list[str], severity: Column, casualties: Column | None) -> dict[str, Column]:
    """The sums a city score needs, as partial aggregates of one pass."""
    parts = {
        "total": _count(),
        "weight_sum": F.sum(X.severity_weight(severity)),
        "fatal": F.count_if(severity == "Fatal"),
        "serious": F.count_if(severity == "Serious"),
    }
    if casualties is not None:
        parts["casualty_sum"] = F.sum(casualties.cast("double"))
        parts["casualty_rows"] = F.count(casualties)
    if "date" in columns:
        day = X.date_of(F.col("date"))
        parts["days"] = F.datediff(F.max(day), F.min(day))
        parts["unread_dates"] = F.count_if(F.col("date").isNotNull() & day.isNull())
    return parts


def score_factors(part) -> dict[str, Column]:
    """The four factors from the sums; ``part(name)`` gives a column or None."""
    total = part("total")
    severity = part("weight_sum") / total / 5 * 30
    if part("casualty_sum") is None:
        casualty = F.lit(10.0)
    else:
        casualty = X.at_most(F.try_divide(part("casualty_sum"), part("casualty_rows")) * 5, 25.0)
    if part("days") is None:
        frequency = F.least(total / 10, F.lit(25.0))
    else:
        days = part("days")
        frequency = (
            F.when(part("unread_dates") > 0, F.least(total / 10, F.lit(25.0)))  # as if there were no dates
            .when(days > 0, F.least(total / days * 10, F.lit(25.0)))
            .otherwise(F.least(total * 2.0, F.lit(25.0)))
        )
    fatal = F.least(part("fatal") / total * 100 * 2, F.lit(20.0))
    return {
        "severity_factor": severity, "casualty_factor": casualty,
        "frequency_factor": frequency, "fatal_factor": fatal,
    }


def total_score(factors: dict[str, Column]) -> Column:
    total = sum(factors.values(), F.lit(0.0))
    return F.greatest(F.least(total, F.lit(100.0)), F.lit(0.0))


def city_risk(df: DataFrame) -> DataFrame:
    """score, level, colour and the four factors; an empty table scores 0."""
    casualties = F.col("num_casualties") if "num_casualties" in df.columns else None
    parts = score_parts(df.columns, F.col("severity"), casualties)
    sums = df.agg(*[c.alias(k) for k, c in parts.items()])
    factors = score_factors(lambda name: F.col(name) if name in parts else None)
    some = F.col("total") > 0
    guarded = {k: F.when(some, c) for k, c in factors.items()}
    scored = sums.select(F.when(some, total_score(factors)).alias("raw"), *[
        c.alias(k) for k, c in guarded.items()
    ])
    return scored.select(
        F.coalesce(X.round1(F.col("raw")), F.lit(0.0)).alias("score"),
        F.when(F.col("raw").isNull(), F.lit("low")).otherwise(X.city_level(F.col("raw"))).alias("level"),
        F.when(F.col("raw").isNull(), F.lit("green")).otherwise(X.city_colour(F.col("raw"))).alias("color"),
        *[X.round1(F.col(k)).alias(k) for k in factors],
    )


def risk_change_24h(df: DataFrame, trend: float = 0.0) -> DataFrame:
    """Expected change of the city score from weather, night and weekend shares.

    ``trend`` stands for the free drift term (between -3 and 3). Below ten
    rows the answer is "stable" with low confidence.
    """
    casualties = F.col("num_casualties") if "num_casualties" in df.columns else None
    parts = score_parts(df.columns, F.col("severity"), casualties)
    shares = []
    if "weather" in df.columns:
        shares += [(F.col("weather") == "Rain", 5.0), (F.col("weather") == "Fog", 8.0)]
    if "hour" in df.columns:
        shares += [((F.col("hour") >= 22) | (F.col("hour") <= 5), 4.0)]
    if "day_of_week" in df.columns:
        shares += [(F.col("day_of_week") >= 5, 3.0)]
    hits = {f"share{i}": (F.count_if(test), points) for i, (test, points) in enumerate(shares)}
    sums = df.agg(
        *[c.alias(k) for k, c in parts.items()], *[c.alias(k) for k, (c, _) in hits.items()]
    )
    drift = F.lit(float(trend))
    for name, (_, points) in hits.items():
        drift = drift + F.try_divide(F.col(name), F.col("total")) * points
    enough = F.col("total") >= 10
    score = X.round1(total_score(score_factors(lambda n: F.col(n) if n in parts else None)))
    change = X.round1(F.greatest(F.least(drift, F.lit(15.0)), F.lit(-10.0)))
    row = sums.select(
        enough.alias("enough"),
        F.when(enough, change).otherwise(0.0).alias("change"),
        F.when(enough, score).alias("score"),
    )
    flat = F.abs("change") < 2
    return row.select(
        "change",
        F.when(~F.col("enough") | flat, F.lit("stable"))
        .when(F.col("change") > 0, F.lit("increasing")).otherwise(F.lit("decreasing"))
        .alias("direction"),
        F.when(~F.col("enough"), F.lit("Low")).when(flat, F.lit("High"))
        .when(F.abs("change") < 5, F.lit("Medium")).otherwise(F.lit("High")).alias("confidence"),
        X.round1(F.col("score") + F.col("change")).alias("predicted_score"),
    )


def gauge_percentages(feed: DataFrame, outlook: DataFrame) -> DataFrame:
    """Dashboard gauges, one row per city of the feed summary.

    ``outlook`` is the one-row result of ``risk_change_24h``. Without flow
    data the speeds fall back to 45 and 65 km/h.
    """
    change = outlook.select("change").scalar()
    current = F.coalesce("current_speed", F.lit(45.0))
    return feed.select(
        "city",
        F.least(F.lit(100), F.col("congestion_percent").cast("int")).alias("congestion_gauge"),
        F.least(F.lit(100), F.col("total_incidents") * 5).cast("int").alias("incident_gauge"),
        F.least(F.lit(100), F.col("accidents") * 15).cast("int").alias("accident_gauge"),
        F.least(F.lit(100), current.cast("int")).alias("speed_gauge"),
        F.coalesce("free_flow_speed", F.lit(65.0)).alias("free_flow_speed"),
        F.greatest(F.lit(0), F.least(F.lit(100), F.lit(50) + (change * 2).cast("int")))
        .alias("forecast_gauge"),
        (F.col("critical_incidents") + F.col("major_incidents")).alias("high_risk_zones"),
    )
