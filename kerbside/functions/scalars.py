"""Column expressions. Everything here stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbside import schema as S


def round1(value: Column) -> Column:
    """One decimal, ties to even."""
    return F.rint(value * 10) / 10


def at_most(value: Column, cap: float) -> Column:
    """Upper clamp that keeps null (``least`` would turn it into the cap)."""
    return F.when(value > cap, F.lit(cap)).otherwise(value)


def pick(value: Column, table: Mapping[Any, Any], otherwise: Any) -> Column:
    """Look ``value`` up in a small fixed table."""
    items = iter(table.items())
    key, result = next(items)
    chain = F.when(value == F.lit(key), F.lit(result))
    for key, result in items:
        chain = chain.when(value == F.lit(key), F.lit(result))
    return chain.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def recode(value: Column, words: Mapping[str, Iterable[str]], otherwise: Column) -> Column:
    """Replace every listed spelling by the name it is listed under."""
    chain = None
    for name, spellings in words.items():
        hit = value.isin(list(spellings))
        chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    return chain.otherwise(otherwise)


def band(value: Column, steps: Iterable[tuple[float, str]], last: str) -> Column:
    """First label whose bound lies strictly above ``value``."""
    chain = None
    for bound, label in steps:
        hit = value < F.lit(bound)
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return chain.otherwise(F.lit(last))


def floor_band(value: Column, steps: Iterable[tuple[float, str]], last: str) -> Column:
    """First label whose bound ``value`` reaches."""
    chain = None
    for bound, label in steps:
        hit = value >= F.lit(bound)
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return chain.otherwise(F.lit(last))


def title_case(text: Column) -> Column:
    """Capital after every non-letter, small letters elsewhere ("t-junction" -> "T-Junction").

    ``initcap`` capitalises after blanks only, so other non-letters get a
    marked blank for its sake.
    """
    spaced = F.regexp_replace(F.lower(text), r"([^\p{L} ])", "$1\u0001 ")
    return F.replace(F.initcap(spaced), F.lit("\u0001 "), F.lit(""))


def strip_lower(text: Column) -> Column:
    return F.lower(F.btrim(text.cast("string"), F.lit(" \t\n\r\x0b\x0c")))


# -- time --------------------------------------------------------------------

def day_of_week(date: Column) -> Column:
    """Monday is 0."""
    return F.weekday(date)


# Tried in this order; month first where both readings are possible.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy")


def date_of(value: Column) -> Column:
    """The day of a date, timestamp or text in one of ``DATE_FORMATS``; null where none fits."""
    text = value.cast("string")
    return F.coalesce(
        text.try_cast("date"), *[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_FORMATS[1:]])


def hour_of(time: Column) -> Column:
    return F.hour(F.try_to_timestamp(time, F.lit("H:m")))


def time_of_day(hour: Column) -> Column:
    return (
        F.when((hour >= 6) & (hour < 10), F.lit("Morning Rush"))
        .when((hour >= 10) & (hour < 16), F.lit("Midday"))
        .when((hour >= 16) & (hour < 20), F.lit("Evening Rush"))
        .otherwise(F.lit("Night"))
    )


# -- severity and risk --------------------------------------------------------

def severity_score(columns: Iterable[str]) -> Column:
    """0-100 score from whichever of its four inputs are present."""
    present = set(columns)
    terms = []
    if "severity" in present:
        terms.append(pick(F.col("severity"), S.SEVERITY_POINTS, S.SEVERITY_POINTS_OTHER))
    if "num_casualties" in present:
        terms.append(at_most(F.col("num_casualties") * 10, 30))
    if "num_vehicles" in present:
        terms.append(at_most((F.col("num_vehicles") - 1) * 5, 15))
    if "weather" in present:
        terms.append(pick(F.col("weather"), S.WEATHER_POINTS, S.WEATHER_POINTS_OTHER))
    total = F.lit(0)
    for term in terms:
        total = total + term
    return at_most(total, 100).cast("double")


def road_tenths() -> Column:
    return pick(F.col("road_type"), *S.ROAD_TENTHS)


def light_tenths() -> Column:
    return pick(F.col("light_conditions"), *S.LIGHT_TENTHS)


def surface_tenths() -> Column:
    return pick(F.col("road_surface"), *S.SURFACE_TENTHS)


def severity_weight(severity: Column) -> Column:
    return pick(severity, S.SEVERITY_WEIGHTS, 1)


def severity_code(severity: Column) -> Column:
    return pick(severity, S.SEVERITY_CODES, F.lit(None).cast("int"))


def risk_level(index: Column) -> Column:
    return band(index, *S.RISK_BANDS)


def city_level(score: Column) -> Column:
    return band(score, *S.CITY_BANDS)


def city_colour(score: Column) -> Column:
    return band(score, *S.CITY_COLOURS)


def marker_colour(severity: Column) -> Column:
    return pick(severity, S.MARKER_COLOURS, S.MARKER_COLOUR_OTHER)


# -- traffic feed ---------------------------------------------------------------

def congestion_percent(current: Column, free: Column) -> Column:
    loss = (F.lit(1.0) - F.try_divide(current, free)) * 100
    return round1(F.when(free > 0, F.greatest(F.lit(0.0), loss)).otherwise(F.lit(0.0)))


def incident_type(category: Column) -> Column:
    return pick(category, S.INCIDENT_TYPES, "Unknown")


def delay_severity(magnitude: Column) -> Column:
    return floor_band(magnitude, *S.DELAY_BANDS)


def congestion_level(percent: Column) -> Column:
    return floor_band(percent, *S.CONGESTION_BANDS)


def congestion_colour(percent: Column) -> Column:
    return floor_band(percent, *S.CONGESTION_COLOURS)


# -- model reports ---------------------------------------------------------------

def _reliable(accuracy: Column, rows: Column, field: int) -> Column:
    good, fair, poor = (row[field] for row in S.CONFIDENCE)
    return (
        F.when((accuracy >= 0.9) & (rows >= 100), F.lit(good))
        .when((accuracy >= 0.75) & (rows >= 50), F.lit(fair))
        .otherwise(F.lit(poor))
    )


def confidence_level(accuracy: Column, rows: Column) -> Column:
    return _reliable(accuracy, rows, 0)


def confidence_colour(accuracy: Column, rows: Column) -> Column:
    return _reliable(accuracy, rows, 1)


def confidence_text(accuracy: Column, rows: Column) -> Column:
    return _reliable(accuracy, rows, 2)


def impact_band(importance: Column) -> Column:
    return (
        F.when(importance > 0.3, F.lit("Very High"))
        .when(importance > 0.2, F.lit("High"))
        .when(importance > 0.1, F.lit("Moderate"))
        .otherwise(F.lit("Low"))
    )


def base_feature(feature: Column) -> Column:
    return F.replace(feature, F.lit("_encoded"), F.lit(""))


def feature_title(feature: Column) -> Column:
    return title_case(F.replace(base_feature(feature), F.lit("_"), F.lit(" ")))
