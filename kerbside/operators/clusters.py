"""Density clusters that grow with appended rows.

Appending rows only adds neighbours: core points stay core, clusters grow and
merge, and nothing changes further than two cells from a new point. So a state
keeps positions with their core flag, the component of every core cell, and
for positions that are no core the core cells within reach. An append

* adds the new rows to their positions and finds core points again in the
  cells around them only;
* links the cells with new core points, and merges the stored components that
  these links join, as a graph of components;
* finds the reachable core cells again for positions around new points.

Labels are numbered when they are asked for, and equal those of ``dbscan`` over
all rows.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators.components import connected_components
from kerbside.operators.dbscan import (
    _NEAR, _SLACK, Clustering, _cell_links, _neighbours, _square, locate,
)
from kerbside.operators.joins import BROADCAST_ROWS, SPLIT_ROWS, skew_join
from kerbside.operators.ordinals import with_ordinal
from kerbside.session import materialise, working_tables

_SUMS = ["w", "casualty_sum", "casualty_rows", "fatal", "serious"]
_PLACE = ["latitude", "longitude"]


class State(NamedTuple):
    """Clusters of the rows so far; the tables are written."""

    eps: float
    min_samples: int
    order: str
    locations: DataFrame  # latitude, longitude, sums, first_row, u, v, cell, core
    cells: DataFrame      # cell, root: component of each cell with a core point
    border: DataFrame     # latitude, longitude, home, cell: core cells within reach of what is no core


def _in_cells(df: DataFrame, cells: DataFrame, how: str = "left_semi", column: str = "cell") -> DataFrame:
    """Rows in (or not in) the given cells, which are few unless very much was appended."""
    cells = cells.withColumnRenamed("cell", column)
    return df.join(F.broadcast(cells) if cells.count() <= BROADCAST_ROWS else cells, column, how)


def _around(cells: DataFrame) -> DataFrame:
    return cells.select(_neighbours("cell", _NEAR).alias("cell")).distinct()


def _within(points: DataFrame, asked: DataFrame, state_eps: float, per_cell: int, split_rows: int) -> DataFrame:
    """``points`` within reach of the positions ``asked``, which come as plat, plon."""
    around = asked.select(
        F.col("latitude").alias("plat"), F.col("longitude").alias("plon"), F.col("cell").alias("home"),
        _neighbours("cell", _NEAR).alias("cell"))
    distance = _square(F.col("latitude") - F.col("plat")) + _square(F.col("longitude") - F.col("plon"))
    return skew_join(
        points, around, ["cell"], right_rows_per_key=len(_NEAR) * max(per_cell, 1), split_rows=split_rows,
    ).where(distance <= state_eps * state_eps)


def start(
    df: DataFrame, eps: float = 0.01, min_samples: int = 3, order: str = "accident_id", split_rows: int = SPLIT_ROWS
) -> State:
    """The state of a first table, columns as for ``dbscan``."""
    side = eps / math.sqrt(2) * _SLACK
    spark = df.sparkSession
    located = locate(df.limit(0), side, order).withColumn("core", F.lit(False))
    empty = State(
        eps, min_samples, order, spark.createDataFrame([], located.schema),
        spark.createDataFrame([], "cell bigint, root bigint"),
        spark.createDataFrame([], "latitude double, longitude double, home bigint, cell bigint"))
    return append(empty, df, split_rows)


def append(state: State, df: DataFrame, split_rows: int = SPLIT_ROWS) -> State:
    """The state after adding the rows of ``df``; the given one stays as it is."""
    with working_tables() as keep:
        grown = _append(state, df, split_rows)
        keep.extend([grown.locations, grown.cells, grown.border])
    return grown


def _append(state: State, df: DataFrame, split_rows: int) -> State:
    eps, min_samples = state.eps, state.min_samples
    added = materialise(
        locate(df, eps / math.sqrt(2) * _SLACK, state.order).withColumn("core", F.lit(False)), "added")
    touched = materialise(_around(added.select("cell").distinct()), "touched")
    merged = materialise(
        state.locations.unionByName(added).groupBy(*_PLACE).agg(
            *[F.sum(c).alias(c) for c in _SUMS], F.min("first_row").alias("first_row"),
            *[F.first(c).alias(c) for c in ("u", "v", "cell")], F.max("core").alias("core")),
        "merged")

    # core points: only near new points can there be more of them
    near = materialise(_in_cells(merged, _around(touched)), "near")
    weights = near.groupBy("cell").agg(F.sum("w").alias("cell_weight"), F.count(F.lit(1)).alias("rows"))
    crowded = materialise(weights.where(F.col("cell_weight") >= min_samples).select("cell"), "crowded")
    open_points = _in_cells(near.where("NOT core"), touched)
    thin = _in_cells(open_points, crowded, "left_anti")
    counted = (
        _within(near.select("cell", *_PLACE, "w"), thin, eps, min_samples - 1, split_rows)
        .groupBy("plat", "plon").agg(F.sum("w").alias("n")).where(F.col("n") >= min_samples)
        .select(F.col("plat").alias("latitude"), F.col("plon").alias("longitude"))
    )
    fresh = materialise(
        _in_cells(open_points, crowded).select(*_PLACE, "cell")
        .unionByName(thin.join(counted, _PLACE, "left_semi").select(*_PLACE, "cell")), "fresh")
    locations = materialise(
        merged.join(fresh.select(*_PLACE, F.lit(True).alias("fresh")), _PLACE, "left")
        .withColumn("core", F.col("core") | F.coalesce("fresh", F.lit(False))).drop("fresh"),
        "locations")

    # links of the cells with new core points join stored components
    changed = materialise(fresh.select("cell").distinct(), "changed")
    core_near = _in_cells(locations.where("core"), _around(changed))
    sizes = core_near.groupBy("cell").agg(F.count(F.lit(1)).alias("cell_locations"))
    core_near = materialise(
        skew_join(core_near, sizes, ["cell"], split_rows=split_rows), "core-near")
    links = _cell_links(core_near, eps * eps)
    cells = state.cells.unionByName(
        _in_cells(changed, state.cells.select("cell"), "left_anti").select("cell", F.col("cell").alias("root")))
    cells = materialise(cells, "cells")
    root = {end: cells.select(F.col("cell").alias(end), F.col("root").alias(f"{end}_root")) for end in ("a", "b")}
    joined = links.join(root["a"], "a").join(root["b"], "b").select(
        F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).where("a <> b").distinct()
    merges = connected_components(materialise(joined, "merges"), split_rows).select(
        F.col("node").alias("root"), F.col("root").alias("into"))
    rooted = materialise(
        skew_join(cells, merges, ["root"], "left", split_rows=split_rows)
        .select("cell", F.coalesce("into", "root").alias("root")), "rooted")

    # what is no core near new points may reach other core cells now
    loose = _in_cells(locations.where("NOT core"), touched)
    reached = (
        _within(_in_cells(locations.where("core"), _around(touched)).select("cell", *_PLACE), loose, eps, min_samples - 1, split_rows)
        .select(F.col("plat").alias("latitude"), F.col("plon").alias("longitude"), "home", "cell").distinct()
    )
    border = materialise(
        _in_cells(state.border, touched, "left_anti", "home").select(*_PLACE, "home", "cell").unionByName(reached), "border")
    return state._replace(locations=locations, cells=rooted, border=border)


def clusters(state: State, split_rows: int = SPLIT_ROWS) -> Clustering:
    """Labels of all positions, as ``dbscan`` over all rows gives them."""
    with working_tables() as keep:
        core, loose = state.locations.where("core"), state.locations.where("NOT core")
        firsts = core.groupBy("cell").agg(F.min("first_row").alias("first_row"), F.count(F.lit(1)).alias("rows"))
        rooted = materialise(firsts.join(state.cells, "cell"), "rooted")
        numbers = with_ordinal(
            rooted.groupBy("root").agg(F.min("first_row").alias("first_row")), ["first_row"], "cluster").select("root", "cluster")
        numbered = materialise(
            skew_join(rooted.select("cell", "root", "rows"), numbers, ["root"], split_rows=split_rows)
            .select("cell", "cluster", "rows"), "numbered")
        labels = numbered.select("cell", "cluster")
        border = state.border.join(labels, "cell").groupBy(*_PLACE).agg(F.min("cluster").alias("cluster"))
        labelled = skew_join(
            core, labels, ["cell"], split_rows=split_rows, counts=numbered.select("cell", "rows"),
        ).unionByName(
            loose.join(border, _PLACE, "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1).cast("long"))))
        table = materialise(labelled.select(*_PLACE, *_SUMS, "cluster", "core"), "clustered")
        keep.append(table)
    return Clustering(table, _PLACE, split_rows)


def save(state: State, folder: str) -> None:
    """Write the state; ``about`` comes last and makes it whole."""
    for name in ("locations", "cells", "border"):
        getattr(state, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = state.locations.sparkSession
    spark.createDataFrame(
        [(state.eps, state.min_samples, state.order)], "eps DOUBLE, min_samples INT, `order` STRING",
    ).write.mode("overwrite").parquet(f"{folder}/about")


def load(spark: SparkSession, folder: str) -> State:
    about = spark.read.parquet(f"{folder}/about").first()
    return State(*about, *[spark.read.parquet(f"{folder}/{name}") for name in ("locations", "cells", "border")])
