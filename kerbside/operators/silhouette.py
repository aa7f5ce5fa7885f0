"""Mean silhouette of a clustering on squared distances; noise counts as one more cluster.

Squared distances need only each cluster's size, centre and spread, so the
cost grows linearly with the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.operators.dbscan import Clustering, cluster_counts
from kerbside.operators.joins import skew_join
from kerbside.operators.ordinals import with_ordinal
from kerbside.session import materialise, working_tables



def _sized(clustering: Clustering) -> tuple[DataFrame, DataFrame, int]:
    """(locations, one row per cluster, number of clusters without noise)."""
    points = clustering.locations.select("latitude", "longitude", "w", "cluster")
    middle = points.agg(F.avg("latitude").alias("y"), F.avg("longitude").alias("x")).first()
    y, x = F.col("latitude") - F.lit(middle["y"]), F.col("longitude") - F.lit(middle["x"])
    points = points.withColumns({"y": y, "x": x})
    w = F.col("w")
    sums = points.groupBy("cluster").agg(
        F.sum(w).alias("n"), F.count(F.lit(1)).alias("rows"),
        (F.sum(F.col("y") * w) / F.sum(w)).alias("cy"), (F.sum(F.col("x") * w) / F.sum(w)).alias("cx"),
        (F.sum((F.col("y") * F.col("y") + F.col("x") * F.col("x")) * w) / F.sum(w)).alias("square"),
    )
    spread = F.greatest(F.lit(0.0), F.col("square") - F.col("cy") * F.col("cy") - F.col("cx") * F.col("cx"))
    clusters = materialise(sums.withColumn("spread", spread).drop("square"), "cluster-sums")
    return points, clusters, clusters.where("cluster >= 0").count()


def _mean(rows: DataFrame) -> float:
    """Weighted mean of (b - a) / max(a, b); members of one-row clusters count 0."""
    s = F.when(F.col("n") > 1, F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))).otherwise(F.lit(0.0))
    return rows.agg(F.sum(F.coalesce(s, F.lit(0.0)) * F.col("w")) / F.sum("w")).first()[0]


def _one_row(clustering: Clustering, value: float) -> DataFrame:
    return clustering.locations.sparkSession.createDataFrame([(value,)], "silhouette DOUBLE")


def silhouette_squared(clustering: Clustering, reach: float) -> DataFrame:
    """Silhouette on squared distances; ``reach`` is the first search radius (some eps).

    The nearest other cluster minimises (distance to centre)^2 + spread. It is
    sought among centres in neighbouring cells of a grid as wide as the
    radius; whatever is found within the radius is final, the few locations
    left over go on with a wider grid.
    """
    with working_tables():
        return _one_row(clustering, _squared(clustering, reach))


def _squared(clustering: Clustering, reach: float) -> float:
    points, clusters, n_clusters = _sized(clustering)
    if n_clusters <= 1:
        return 0.0
    split_rows = clustering.split_rows
    own = skew_join(
        points, clusters.select("cluster", "n", "cy", "cx", "spread"), ["cluster"],
        split_rows=split_rows, counts=clusters.select("cluster", "rows"),
    )

    def apart():
        dy, dx = F.col("y") - F.col("cy"), F.col("x") - F.col("cx")
        return dy * dy + dx * dx + F.col("spread")

    inner = F.when(F.col("n") > 1, apart() * F.col("n") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    waiting = materialise(
        own.select("latitude", "longitude", "y", "x", "w", "n", "cluster", inner.alias("a")), "silhouette"
    )
    ends = points.agg(*[f(c) for c in ("y", "x") for f in (F.max, F.min)]).first()
    width = max(ends[0] - ends[1], ends[2] - ends[3]) * 1.5
    others = clusters.select(F.col("cluster").alias("other"), "cy", "cx", "spread")
    finished = []
    while True:
        last = reach >= width
        steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
        near = (
            others.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps))
            .withColumns({"gy": F.floor(F.col("cy") / reach) + F.col("i"), "gx": F.floor(F.col("cx") / reach) + F.col("j")})
            .drop("i", "j")
        )
        crowd = near.groupBy("gy", "gx").count().agg(F.max("count")).first()[0]
        placed = waiting.withColumns({"gy": F.floor(F.col("y") / reach), "gx": F.floor(F.col("x") / reach)})
        seen = (
            skew_join(placed, near, ["gy", "gx"], right_rows_per_key=crowd, split_rows=split_rows)
            .where("other <> cluster").groupBy("latitude", "longitude").agg(F.min(apart()).alias("b"))
        )
        if not last:
            seen = seen.where(F.col("b") <= reach * reach)
        done = materialise(
            waiting.join(seen, ["latitude", "longitude"], "left"), "silhouette"
        )
        finished.append(done.where("b IS NOT NULL").select("w", "n", "a", "b"))
        waiting = done.where("b IS NULL").drop("b")
        if last or waiting.isEmpty():
            break
        reach *= 4
    rows = finished[0]
    for more in finished[1:]:
        rows = rows.unionAll(more)
    return _mean(rows)


def cluster_stats(clustering: Clustering, reach: float) -> DataFrame:
    """One row: number of clusters and of noise rows, and the mean silhouette."""
    return cluster_counts(clustering).crossJoin(F.broadcast(silhouette_squared(clustering, reach)))  # 1 x 1 row
