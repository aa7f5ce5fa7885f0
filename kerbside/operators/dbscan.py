"""Exact density clustering (DBSCAN) of coordinates as DataFrame joins on grid cells.

Cells have a side a little under eps/sqrt(2), so points of one cell are always
neighbours. Hence

* a cell holding at least ``min_samples`` points consists of core points;
* all core points of a cell belong to one cluster, so clusters are the
  connected components of *cells*;
* only points of thin cells (fewer than ``min_samples``, a bounded number per
  cell) need their neighbours counted.

Two core cells are linked when some pair of their core points lies within
eps. That is decided on nested boxes: a pair of boxes whose extreme corners
are within eps links the cells, one whose gap exceeds eps is discarded, and
the rest is split into sub-boxes until boxes are single points. Point pairs
inside or between crowded cells are never enumerated.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.operators.components import connected_components
from kerbside.operators.joins import BROADCAST_ROWS, SPLIT_ROWS, skew_join
from kerbside.operators.ordinals import with_ordinal
from kerbside.session import materialise, working_tables

_SLACK = 1 - 1e-9          # keeps same-cell distances below eps after rounding
_ROW = 1 << 32             # cell id = row index * 2^32 + column index (shifted to be positive)
_MIDDLE = 1 << 31
_SPLIT = 4                 # sub-boxes per axis and level
_LISTED_POINTS = 32         # cells up to this size carry their points into the link test
_CONTRACT_PAIRS = 50_000    # above this many undecided pairs of cells, components are found before the rest is split
_REACH = range(-2, 3)
_NEAR = [dx * _ROW + dy for dx in _REACH for dy in _REACH]
_FORWARD = [offset for offset in _NEAR if offset > 0]


class Clustering(NamedTuple):
    """Clusters per distinct location: latitude, longitude, w, sums, cluster, core."""

    locations: DataFrame
    coordinates: list[str]
    split_rows: int


def _neighbours(cell: str, offsets: list[int]) -> Column:
    return F.explode(F.array(*[F.col(cell) + F.lit(o).cast("long") for o in offsets]))


def _gap(low: str, high: str) -> Column:
    """Distance between the intervals [a_low, a_high] and [b_low, b_high]."""
    return F.greatest(
        F.lit(0.0),
        F.col(f"b_{low}") - F.col(f"a_{high}"),
        F.col(f"a_{low}") - F.col(f"b_{high}"),
    )


def _span(low: str, high: str) -> Column:
    return F.greatest(F.col(f"b_{high}") - F.col(f"a_{low}"), F.col(f"a_{high}") - F.col(f"b_{low}"))


def _square(value: Column) -> Column:
    return value * value


def _boxes(points: DataFrame, level: int, with_points: bool = False) -> DataFrame:
    """Tight boxes of the points per sub-cell; scaling by powers of two nests exactly."""
    scale = float(_SPLIT**level)
    listed = F.collect_list(F.struct("latitude", "longitude"))
    empty = F.lit(None).cast("array<struct<latitude:double,longitude:double>>")
    return points.groupBy(
        "cell",
        F.floor(F.col("u") * scale).alias("gu"),
        F.floor(F.col("v") * scale).alias("gv"),
    ).agg(
        F.min("latitude").alias("lat0"), F.max("latitude").alias("lat1"),
        F.min("longitude").alias("lon0"), F.max("longitude").alias("lon1"),
        (listed if with_points else F.first(empty)).alias("points"),
    )


def _measure(pairs: DataFrame, reach: float) -> DataFrame:
    """Keep box pairs that may hold neighbours; ``linked`` marks those that surely do.

    Boxes that carry their (few) points are decided here and now; ``open``
    marks the pairs that need splitting.
    """
    gap = _square(_gap("lat0", "lat1")) + _square(_gap("lon0", "lon1"))
    span = _square(_span("lat0", "lat1")) + _square(_span("lon0", "lon1"))
    touch = F.exists("a_points", lambda p: F.exists("b_points", lambda q: (
        _square(p["latitude"] - q["latitude"]) + _square(p["longitude"] - q["longitude"]) <= reach
    )))
    listed = F.col("a_points").isNotNull() & F.col("b_points").isNotNull()
    return (
        pairs.where(gap <= reach)
        .withColumn("linked", F.when(span <= reach, F.lit(True)).when(listed, touch).otherwise(F.lit(False)))
        .withColumn("open", ~F.col("linked") & ~listed)
        .where("linked OR open")
        .select("a", "b", "a_gu", "a_gv", "b_gu", "b_gv", "linked", "open")
    )


def _renamed(boxes: DataFrame, side: str) -> DataFrame:
    return boxes.select(
        F.col("cell").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in boxes.columns if c != "cell"]
    )


def _cell_links(core: DataFrame, reach: float, listed_points: int = _LISTED_POINTS) -> DataFrame:
    """(a, b) for neighbouring cells joined by at least one pair of core points, as far as components need them.

    Two cells that other links connect need no link of their own. If very many
    pairs are undecided, cells side by side are settled first, and only pairs
    still in different components are split any further.
    """
    few = F.col("cell_locations") <= listed_points
    top = materialise(
        _boxes(core.where(few), 0, with_points=True).unionByName(_boxes(core.where(~few), 0)), "boxes"
    )
    first = (
        _renamed(top, "a").withColumn("b", _neighbours("a", _FORWARD)).join(_renamed(top, "b"), "b")
    )
    measured = materialise(_measure(first, reach), "box-pairs")
    links = [measured.where("linked").select("a", "b").distinct()]
    undecided = measured.where("open")
    if undecided.count() > _CONTRACT_PAIRS:
        links += _split_links(core, undecided.where((F.col("b") - F.col("a")).isin(1, _ROW)), reach)
        so_far = materialise(reduce(DataFrame.unionAll, links), "links")
        roots = materialise(connected_components(so_far), "roots")
        for end in ("a", "b"):
            named = roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
            undecided = undecided.join(named, end, "left")
        apart = F.coalesce("a_root", "a") != F.coalesce("b_root", "b")
        undecided = materialise(undecided.where(apart).drop("a_root", "b_root"), "box-pairs")
        links = [so_far]
    links += _split_links(core, undecided, reach)
    if len(links) == 1:
        return materialise(links[0], "links")
    return materialise(reduce(DataFrame.unionAll, links), "links")


def _split_links(core: DataFrame, undecided: DataFrame, reach: float) -> list[DataFrame]:
    """Links among the open pairs of cells, one table per level of boxes."""
    measured, links, level = undecided, [], 0
    while not measured.where("open").isEmpty():
        unsettled = measured.where("open")
        if links:
            unsettled = unsettled.join(links[-1], ["a", "b"], "left_anti")
        unsettled = materialise(
            unsettled.select("a", "b", *[F.col(c).alias(f"p{c}") for c in ("a_gu", "a_gv", "b_gu", "b_gv")]),
            "open-pairs",
        )
        n_open = unsettled.count()
        level += 1
        busy = core
        if n_open <= BROADCAST_ROWS // 2:
            cells = unsettled.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
            busy = core.join(F.broadcast(cells), "cell", "left_semi")
        boxes = materialise(
            _boxes(busy, level)
            .withColumns({"pu": F.floor(F.col("gu") / _SPLIT), "pv": F.floor(F.col("gv") / _SPLIT)}),
            "boxes",
        )
        a = _renamed(boxes, "a").withColumnsRenamed({"a_pu": "pa_gu", "a_pv": "pa_gv"})
        b = _renamed(boxes, "b").withColumnsRenamed({"b_pu": "pb_gu", "b_pv": "pb_gv"})
        pairs = unsettled.join(a, ["a", "pa_gu", "pa_gv"]).join(b, ["b", "pb_gu", "pb_gv"])
        measured = materialise(_measure(pairs, reach), "box-pairs")
        links.append(measured.where("linked").select("a", "b").distinct())
    return links


def dbscan(
    df: DataFrame,
    eps: float = 0.01,
    min_samples: int = 3,
    order: str = "accident_id",
    split_rows: int = SPLIT_ROWS,
) -> Clustering:
    """Cluster the rows of ``df`` by ``latitude`` and ``longitude``.

    Clusters are numbered from 0 by their first core row in ``order``; a
    border point takes the smallest cluster number among its core neighbours,
    as in a sequential scan. Rows at the same position are merged into one
    weighted location before anything else, with the sums reports need. Rows
    without a finite position within 2^31 cells of the origin are not placed:
    ``label_rows`` reports them as noise.
    """
    with working_tables() as keep:
        clustering = _cluster(df, eps, min_samples, order, split_rows)
        keep.append(clustering.locations)
    return clustering


def locate(df: DataFrame, side: float, order: str) -> DataFrame:
    """One row per position: number of rows, first row, sums for reports, and the grid cell of that side."""
    have = set(df.columns)
    casualties = F.col("num_casualties") if "num_casualties" in have else F.lit(None).cast("int")
    severity = F.col("severity") if "severity" in have else F.lit(None).cast("string")
    u, v = F.col("latitude") / side, F.col("longitude") / side
    return (
        df.where(
            # NaN compares as larger than any limit, null as unknown
            (F.abs(u) < _MIDDLE - 4) & (F.abs(v) < _MIDDLE - 4)
        )
        .groupBy("latitude", "longitude")
        .agg(
            F.count(F.lit(1)).alias("w"), F.min(order).alias("first_row"),
            F.sum(casualties).alias("casualty_sum"), F.count(casualties).alias("casualty_rows"),
            F.count_if(severity == "Fatal").alias("fatal"),
            F.count_if(severity == "Serious").alias("serious"),
        )
        .withColumns({"u": u, "v": v})
        .withColumn("cell", F.floor("u") * _ROW + F.floor("v") + _MIDDLE)
    )


def _cluster(df: DataFrame, eps: float, min_samples: int, order: str, split_rows: int) -> Clustering:
    side = eps / math.sqrt(2) * _SLACK
    reach = eps * eps
    locations = materialise(locate(df, side, order), "locations")
    n_locations = locations.count()

    weights = locations.groupBy("cell").agg(
        F.sum("w").alias("cell_weight"), F.count(F.lit(1)).alias("cell_locations")
    )
    if n_locations > split_rows:
        weights = materialise(weights, "weights")
    sizes = weights.select("cell", F.col("cell_locations").alias("rows"))
    placed = materialise(
        skew_join(
            locations, weights, ["cell"], split_rows=split_rows, left_rows=n_locations, counts=sizes
        )
        .withColumn("dense", F.col("cell_weight") >= min_samples).drop("cell_weight"),
        "placed",
    )
    dense, thin = placed.where("dense"), placed.where("NOT dense")

    # neighbours of the points of thin cells, summed per neighbouring cell
    around = thin.select(
        F.col("latitude").alias("plat"), F.col("longitude").alias("plon"),
        _neighbours("cell", _NEAR).alias("cell"),
    )
    per_cell = len(_NEAR) * max(min_samples - 1, 1)
    distance = _square(F.col("latitude") - F.col("plat")) + _square(F.col("longitude") - F.col("plon"))
    within = materialise(
        skew_join(
            placed.select("cell", "latitude", "longitude", "w", "dense"), around, ["cell"],
            right_rows_per_key=per_cell, split_rows=split_rows, left_rows=n_locations, counts=sizes,
        )
        .where(distance <= reach)
        .groupBy("plat", "plon", "cell", "dense").agg(F.sum("w").alias("n")),
        "within",
    )
    core_keys = within.groupBy("plat", "plon").agg(F.sum("n").alias("n")).where(
        F.col("n") >= min_samples
    ).select(F.col("plat").alias("latitude"), F.col("plon").alias("longitude"))
    flagged = materialise(
        thin.join(core_keys.withColumn("core", F.lit(True)), ["latitude", "longitude"], "left")
        .withColumn("core", F.coalesce("core", F.lit(False))),
        "thin",
    )
    thin_core, loose = flagged.where("core"), flagged.where("NOT core")
    core = dense.withColumn("core", F.lit(True)).unionByName(thin_core)

    links = _cell_links(core, reach)
    joined = connected_components(links, split_rows).withColumnRenamed("node", "cell")

    core_cells = core.groupBy("cell").agg(F.min("first_row").alias("first_row"))
    rooted = materialise(
        core_cells.join(joined, "cell", "left").withColumn("root", F.coalesce("root", "cell")),
        "rooted",
    )
    clusters = with_ordinal(
        rooted.groupBy("root").agg(F.min("first_row").alias("first_row")), ["first_row"], "cluster"
    ).select("root", "cluster")
    numbered = materialise(
        skew_join(
            rooted.select("cell", "root"), clusters, ["root"],
            split_rows=split_rows, left_rows=n_locations,
        )
        .select("cell", "cluster"),
        "numbered",
    )

    # border points: a core location of some cell lies within eps
    by_dense = within.where("dense").select("plat", "plon", "cell")
    by_thin = (
        loose.select(
            F.col("latitude").alias("plat"), F.col("longitude").alias("plon"),
            _neighbours("cell", _NEAR).alias("cell"),
        )
        .join(thin_core.select("cell", "latitude", "longitude"), "cell")
        .where(distance <= reach).select("plat", "plon", "cell")
    )
    border = (
        by_dense.unionByName(by_thin).join(numbered, "cell")
        .groupBy("plat", "plon").agg(F.min("cluster").alias("cluster"))
        .withColumnsRenamed({"plat": "latitude", "plon": "longitude"})
    )
    labelled = skew_join(
        core, numbered, ["cell"], split_rows=split_rows, left_rows=n_locations, counts=sizes
    ).unionByName(
        loose.join(border, ["latitude", "longitude"], "left")
        .withColumn("cluster", F.coalesce("cluster", F.lit(-1).cast("long")))
    )
    keep = [
        "latitude", "longitude", "w", "casualty_sum", "casualty_rows", "fatal", "serious",
        "cluster", "core",
    ]
    return Clustering(
        materialise(labelled.select(*keep), "clustered"), ["latitude", "longitude"], split_rows
    )


def label_rows(df: DataFrame, clustering: Clustering) -> DataFrame:
    """Add ``cluster`` to each row; noise and rows without position get -1."""
    labels = clustering.locations.select("latitude", "longitude", "cluster")
    on = clustering.coordinates
    found = F.lit(True)
    for c in on:
        found = found & F.col(c).isNotNull() & ~F.coalesce(F.isnan(c), F.lit(False))
    rows = clustering.locations.select(*on, F.col("w").alias("rows"))
    located = skew_join(
        df.where(found), labels, on, "left", split_rows=clustering.split_rows, counts=rows
    )
    unplaced = df.where(~found).withColumn("cluster", F.lit(-1).cast("long"))
    return located.withColumn("cluster", F.coalesce("cluster", F.lit(-1).cast("long"))).unionByName(unplaced)


def hotspots(clustering: Clustering) -> DataFrame:
    """One row per cluster, busiest first: centre, counts, casualties and risk level."""
    n, w = F.col("accident_count"), F.col("w")
    return (
        clustering.locations.where("cluster >= 0").groupBy(F.col("cluster").alias("cluster_id"))
        .agg(
            (F.sum(F.col("latitude") * w) / F.sum(w)).alias("center_lat"),
            (F.sum(F.col("longitude") * w) / F.sum(w)).alias("center_lon"),
            F.sum(w).alias("accident_count"),
            F.try_divide(F.sum("casualty_sum"), F.sum("casualty_rows")).alias("avg_casualties"),
            F.sum("fatal").alias("fatal_count"), F.sum("serious").alias("serious_count"),
        )
        .withColumn(
            "risk_level",
            F.when(F.col("fatal_count") > 0, F.lit("High"))
            .when(F.col("serious_count") > n * 0.3, F.lit("Medium"))
            .otherwise(F.lit("Low")),
        )
        .orderBy(F.desc("accident_count"), "cluster_id")
    )


def hotspot_levels(spots: DataFrame) -> DataFrame:
    levels = ("High", "Medium", "Low")
    return spots.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("risk_level") == x).alias(x.lower()) for x in levels],
    )


def cluster_counts(clustering: Clustering) -> DataFrame:
    """Number of clusters and of noise rows."""
    per_cluster = clustering.locations.groupBy("cluster").agg(F.sum("w").alias("n"))
    return per_cluster.agg(
        F.count_if(F.col("cluster") >= 0).alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col("cluster") < 0, F.col("n"))), F.lit(0)).alias("noise_points"),
    )
