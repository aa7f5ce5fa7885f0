"""Exact quantiles of many columns at once, by narrowing histograms.

The built-in exact percentile keeps every distinct value of a column in one
task. Here each round counts values into buckets with partial aggregation,
and the driver sees at most ``buckets`` rows per open interval.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    q: float = 0.5,
    weight: str | None = None,
    buckets: int = BUCKETS,
) -> dict[str, float | None]:
    """Linear-interpolation quantile ``q`` per column, nulls and NaN ignored.

    ``weight`` names a column of whole-number multiplicities. Infinite values
    take the ends of the order; each round separates the smallest finite value
    of an interval from the largest, so the search ends on any values.
    """
    if not columns:
        return {}
    times = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    pairs = F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value"))
        for c in columns
    ])
    values = (
        df.select(times.alias("times"), F.explode(pairs).alias("p"))
        .select("times", "p.name", "p.value")
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
    )
    times_of = lambda test: F.coalesce(F.sum(F.when(test, F.col("times"))), F.lit(0))
    finite = F.abs("value") < math.inf
    spans = {
        r["name"]: r
        for r in values.groupBy("name").agg(
            F.sum("times").alias("n"), times_of(F.col("value") == -math.inf).alias("below"),
            times_of(F.col("value") == math.inf).alias("above"),
            F.min(F.when(finite, F.col("value"))).alias("lo"), F.max(F.when(finite, F.col("value"))).alias("hi"),
        ).collect()
    }
    values = values.where(finite)
    # target (column, rank) -> interval (lo, hi) and the number of values before it
    found: dict[tuple[str, int], float] = {}
    still_open: dict[tuple[str, int], tuple[float, float, int]] = {}
    ranks: dict[str, tuple[float, int, int]] = {}
    for name, r in spans.items():
        place = (r["n"] - 1) * q
        ranks[name] = (place, math.floor(place), math.ceil(place))
        for rank in set(ranks[name][1:]):
            if rank < r["below"]:
                found[name, rank] = -math.inf
            elif rank >= r["n"] - r["above"]:
                found[name, rank] = math.inf
            elif r["lo"] == r["hi"]:
                found[name, rank] = r["lo"]
            else:
                still_open[name, rank] = (r["lo"], r["hi"], r["below"])

    while still_open:
        intervals = sorted({(name, *span) for (name, _), span in still_open.items()})
        inside = [
            (F.col("name") == name) & F.col("value").between(lo, hi)
            for name, lo, hi, _ in intervals
        ]
        which = reduce(
            lambda chain, i: chain.when(inside[i], F.lit(i)),
            range(1, len(intervals)), F.when(inside[0], F.lit(0)),
        )
        bucket = reduce(
            lambda chain, i: chain.when(inside[i], _bucket(*intervals[i][1:3], buckets)),
            range(1, len(intervals)),
            F.when(inside[0], _bucket(*intervals[0][1:3], buckets)),
        )
        counted = (
            values.select("times", "value", which.alias("which"), bucket.alias("bucket"))
            .where(F.col("which").isNotNull())
            .groupBy("which", "bucket")
            .agg(F.sum("times").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
            .collect()
        )
        histograms = defaultdict(list)
        for r in counted:
            histograms[intervals[r["which"]]].append((r["lo"], r["hi"], r["n"]))
        for (name, rank), span in list(still_open.items()):
            below = span[2]
            for lo, hi, n in sorted(histograms[(name, *span)]):
                if rank < below + n:
                    del still_open[name, rank]
                    if lo == hi:
                        found[name, rank] = lo
                    else:
                        still_open[name, rank] = (lo, hi, below)
                    break
                below += n

    result: dict[str, float | None] = dict.fromkeys(columns)
    for name, (place, low, high) in ranks.items():
        a, b = found[name, low], found[name, high]
        result[name] = a if a == b or place == low else a + (b - a) * (place - low)
    return result


def _bucket(lo: float, hi: float, buckets: int):
    share = (F.col("value") / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)  # halves cannot overflow
    return F.least(F.floor(share * buckets), F.lit(buckets - 1))
