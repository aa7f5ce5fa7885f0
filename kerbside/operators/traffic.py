"""City summaries of the traffic feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside import schema as S
from kerbside.functions import scalars as X
from kerbside.operators.joins import BROADCAST_ROWS, skew_join
from kerbside.operators.spatial import bounding_box


def within_city(incidents: DataFrame, cities: DataFrame, radius_km: float = 10) -> DataFrame:
    """Pair incidents with the cities whose box holds them.

    A range join as an equi-join: boxes are entered in every grid cell they
    touch (cells are as wide as a box, so at most nine), incidents in theirs.
    Works on a stream of incidents as long as the city table can be broadcast.
    """
    width = 2 * radius_km / 111
    # never null: no filter that parses the feed a second time is inferred from the join
    cell = lambda value: F.coalesce(F.floor(value / width), F.lit(0).cast("long"))
    low = lambda c: cell(F.col(c) - width / 2)
    high = lambda c: cell(F.col(c) + width / 2)
    boxes = cities.withColumn("_x", F.explode(F.sequence(low("city_lat"), high("city_lat")))).withColumn(
        "_y", F.explode(F.sequence(low("city_lon"), high("city_lon")))
    )
    placed = incidents.withColumns({
        "_x": cell(F.coalesce("latitude", F.lit(0.0))),
        "_y": cell(F.coalesce("longitude", F.lit(0.0))),
    })
    if cities.count() * 9 <= BROADCAST_ROWS:
        pairs = placed.join(F.broadcast(boxes), ["_x", "_y"])
    else:
        crowd = boxes.groupBy("_x", "_y").count().agg(F.max("count")).first()[0]
        pairs = skew_join(placed, boxes, ["_x", "_y"], right_rows_per_key=crowd)
    inside = bounding_box(
        F.col("latitude"), F.col("longitude"), (F.col("city_lat"), F.col("city_lon")), radius_km
    )
    return pairs.where(inside).drop("_x", "_y")


def incident_counts() -> dict[str, Column]:
    kind, severity = F.col("type"), F.col("severity")
    return {
        "total_incidents": F.count(F.lit(1)),
        "accidents": F.count_if(kind == "Accident"),
        "jams": F.count_if(kind == "Jam"),
        "road_works": F.count_if(kind == "Road Works"),
        "closures": F.count_if(kind.isin("Road Closed", "Lane Closed")),
        "critical_incidents": F.count_if(severity == "Critical"),
        "major_incidents": F.count_if(severity == "Major"),
    }


def fallback_congestion() -> Column:
    """Congestion guessed from incident counts when there is no flow reading."""
    points = (
        F.col("critical_incidents") * 20 + F.col("major_incidents") * 10
        + F.col("total_incidents") * 2
    )
    return F.least(F.lit(100.0), points.cast("double"))


def latest_flow(flow: DataFrame, time: str) -> DataFrame:
    """The last reading per city (largest reading on equal times)."""
    reading = F.struct(time, "current_speed", "free_flow_speed", "congestion_percent")
    return flow.groupBy("city").agg(F.max(reading).alias("r")).select(
        "city", "r.current_speed", "r.free_flow_speed", "r.congestion_percent"
    )


def city_summary(
    incidents: DataFrame, cities: DataFrame, flow: DataFrame | None = None, radius_km: float = 10
) -> DataFrame:
    """One row per city: counts, congestion and its level.

    ``flow`` holds at most one row per city (see ``latest_flow``).
    """
    counts = incident_counts()
    near = within_city(incidents, cities, radius_km).groupBy("city").agg(
        *[c.alias(k) for k, c in counts.items()]
    )
    table = cities.select("city").join(near, "city", "left").select(
        "city", *[F.coalesce(k, F.lit(0)).alias(k) for k in counts]
    )
    if flow is None:
        nothing = F.lit(None).cast("double")
        table = table.withColumns({
            "current_speed": nothing, "free_flow_speed": nothing, "flow_congestion": nothing,
        })
    else:
        table = table.join(
            flow.withColumnRenamed("congestion_percent", "flow_congestion"), "city", "left"
        )
    percent = F.coalesce("flow_congestion", fallback_congestion())
    return table.select(
        "city", percent.alias("congestion_percent"),
        X.congestion_level(percent).alias("risk_level"),
        X.congestion_colour(percent).alias("risk_color"),
        *counts, "current_speed", "free_flow_speed",
    )


def first_incidents(
    incidents: DataFrame, cities: DataFrame, order: list[str], k: int = 20, radius_km: float = 10
) -> DataFrame:
    """The first ``k`` incidents per city in feed order.

    The rank filter is pushed below the shuffle, so each task sends at most
    ``k`` rows per city however busy the city is.
    """
    by_city = Window.partitionBy("city").orderBy(*order)
    return (
        within_city(incidents, cities, radius_km)
        .withColumn("rank", F.row_number().over(by_city)).where(F.col("rank") <= k)
    )


def incident_cards(incidents: DataFrame) -> DataFrame:
    """Display texts: upper-case type, first 60 characters, whole minutes of delay."""
    return incidents.withColumns({
        "title": F.upper("type"),
        "text": F.substring("description", 1, 60),
        "delay_minutes": F.floor(F.col("delay_seconds") / 60).cast("int"),
    })


def incidents_to_accidents(incidents: DataFrame, now: Column) -> DataFrame:
    """Feed incidents as rows of the accident table, dated ``now``."""
    severity = X.pick(F.col("severity"), S.FEED_SEVERITIES, "Minor")
    daylight = F.hour(now).between(6, 18)
    return incidents.withColumn("severity", severity).withColumns({
        "date": F.to_date(now),
        "time": F.date_format(now, "HH:mm"),
        "num_casualties": X.pick(F.col("severity"), S.FEED_CASUALTIES, 0),
        "num_vehicles": F.lit(1),
        "speed_limit": F.lit(50),
        "weather": F.lit("Clear"),
        "road_type": F.lit("Urban"),
        "light_conditions": F.when(daylight, F.lit("Daylight")).otherwise(F.lit("Dark - lights lit")),
        "road_surface": F.lit("Dry"),
        "junction_type": F.lit("Not at junction"),
    })
