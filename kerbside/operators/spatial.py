"""Grid aggregation and place lookups."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside import schema as S


def grid_step(coordinate: Column, size: float) -> Column:
    """Index of the nearest grid line, ties to even."""
    return F.rint(coordinate / size).cast("long")


def _grid(df: DataFrame, size: float, *measures: Column) -> DataFrame:
    located = df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return (
        located.groupBy(
            grid_step(F.col("latitude"), size).alias("lat_step"),
            grid_step(F.col("longitude"), size).alias("lon_step"),
        )
        .agg(*measures)
        .withColumns({"latitude": F.col("lat_step") * size, "longitude": F.col("lon_step") * size})
        .drop("lat_step", "lon_step")
    )


def grid_hotspots(df: DataFrame, size: float = 0.01) -> DataFrame:
    """Accidents, mean severity and casualties per grid cell, busiest first.

    Cells are grouped by their integer index: equal cells never differ by a
    rounding error, and the group key is two integers.
    """
    return _grid(
        df, size,
        F.count("accident_id").alias("accident_count"),
        F.avg("severity_score").alias("avg_severity"),
        F.sum("num_casualties").alias("total_casualties"),
    ).select(
        "latitude", "longitude", "accident_count", "avg_severity", "total_casualties"
    ).orderBy(F.desc("accident_count"), "latitude", "longitude")


def density_grid(df: DataFrame, size: float = 0.01) -> DataFrame:
    return _grid(df, size, F.count(F.lit(1)).alias("n"))


def density_surface(df: DataFrame, size: float = 0.01, levels: int = 3, radius: int = 3) -> DataFrame:
    """Smoothed accident density per zoom level: level, lat_step, lon_step, n, density.

    Level 0 has cells of ``size``; each further level joins two by two cells.
    The kernel is binomial over ``2 * radius + 1`` cells per axis, near a normal
    curve, and separable: counts are spread along one axis, added up, and then
    spread along the other, 2k instead of k^2 rows per cell. Weights are whole
    numbers until the end, so densities are exact. Cells that the kernel
    reaches without accidents of their own have n = 0.
    """
    located = df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    cells = located.groupBy(
        grid_step(F.col("latitude"), size).alias("y"), grid_step(F.col("longitude"), size).alias("x")
    ).agg(F.count(F.lit(1)).alias("n"))
    zoomed = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).groupBy(
        "level", F.expr("shiftright(y, level)").alias("y"), F.expr("shiftright(x, level)").alias("x")
    ).agg(F.sum("n").alias("n"), F.sum("n").alias("mass"))
    kernel = F.array(*[
        F.struct(F.lit(d).alias("d"), F.lit(comb(2 * radius, radius + d)).cast("long").alias("w"), F.lit(d == 0).alias("own"))
        for d in range(-radius, radius + 1)
    ])

    def spread(rows: DataFrame, axis: str) -> DataFrame:
        at = rows.withColumn("k", F.explode(kernel)).withColumn(axis, F.col(axis) + F.col("k.d"))
        return at.groupBy("level", "y", "x").agg(
            F.sum(F.when(F.col("k.own"), F.col("n")).otherwise(F.lit(0))).alias("n"),
            F.sum(F.col("mass") * F.col("k.w")).alias("mass"))

    return spread(spread(zoomed, "y"), "x").select(
        "level", F.col("y").alias("lat_step"), F.col("x").alias("lon_step"), "n",
        (F.col("mass") / float(16 ** radius)).alias("density"))


def bounding_box(lat: Column, lon: Column, centre: tuple[Column, Column], radius_km: float = 10) -> Column:
    """Within ``radius_km`` along each axis, at 111 km per degree."""
    delta = radius_km / 111
    return lat.between(centre[0] - delta, centre[0] + delta) & lon.between(
        centre[1] - delta, centre[1] + delta
    )


def place_name(lat: Column, lon: Column) -> Column:
    """First known place whose box holds the point (four fixed places)."""
    chain = None
    for name, plat, plon, half in S.KNOWN_LOCATIONS:
        hit = (F.abs(lat - plat) < half) & (F.abs(lon - plon) < half)
        chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    return chain.otherwise(F.lit("Unknown Location"))


def map_centre(df: DataFrame) -> DataFrame:
    """Mean position, its place name and the number of rows."""
    centre = df.agg(
        F.avg("latitude").alias("center_lat"), F.avg("longitude").alias("center_lon"),
        F.count(F.lit(1)).alias("accidents"),
    )
    return centre.withColumn("location", place_name(F.col("center_lat"), F.col("center_lon")))


def cities(spark) -> DataFrame:
    return spark.createDataFrame(S.CITIES, "city STRING, city_lat DOUBLE, city_lon DOUBLE")
