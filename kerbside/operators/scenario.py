"""Before/after comparison of safety interventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside import schema as S
from kerbside.functions import scalars as X
from kerbside.operators.risk import score_factors, score_parts, total_score

_SHARED = ("total", "days", "unread_dates")  # sums that no intervention changes


def draw(key: str, intervention: str, purpose: str, seed: int) -> Column:
    """Uniform [0, 1) fixed by row, intervention and seed: the same on any partitioning."""
    mixed = F.md5(F.concat_ws("/", F.col(key).cast("string"), F.lit(f"{intervention}/{purpose}/{seed}")))
    return F.conv(F.substring(mixed, 1, 7), 16, 10).cast("long") / F.lit(float(1 << 28))


def _known(names: list[str] | None) -> list[tuple]:
    table = {i[0]: i for i in S.INTERVENTIONS}
    fallback = table["speed_reduction"]
    return [(name, *table.get(name, fallback)[1:]) for name in names or table]


def simulate(
    df: DataFrame, key: str = "accident_id", interventions: list[str] | None = None, seed: int = 42
) -> DataFrame:
    """One row per intervention; unknown names take the effects of ``speed_reduction``.

    All interventions are evaluated in a single pass: each adds conditional
    sums to one aggregate, so rows are neither copied nor shuffled. Fatal and
    serious rows are drawn from the *original* severity, so no row drops two
    levels.
    """
    chosen = _known(interventions)
    counted = "num_casualties" in df.columns
    casualties = F.col("num_casualties") if counted else None
    severity = F.col("severity")
    parts = {f"before_{k}": c for k, c in score_parts(df.columns, severity, casualties).items()}
    for i, (name, _, lighter, fewer, saved) in enumerate(chosen):
        eased = (
            F.when((severity == "Fatal") & (draw(key, name, "fatal", seed) < saved), F.lit("Serious"))
            .when((severity == "Serious") & (draw(key, name, "serious", seed) < lighter), F.lit("Minor"))
            .otherwise(severity)
        )
        # one rounding per row, ties to even; the factor is formed once, as 1 - reduction
        spared = F.rint(F.col("num_casualties") * F.lit(1 - fewer)) if counted else None
        after = score_parts(df.columns, eased, spared)
        parts.update({f"after{i}_{k}": c for k, c in after.items() if k not in _SHARED})
    sums = df.agg(*[c.alias(k) for k, c in parts.items()])

    def part(prefix: str):
        def get(name: str) -> Column | None:
            prefixed = f"before_{name}" if name in _SHARED else f"{prefix}_{name}"
            return F.col(prefixed) if prefixed in parts else None
        return get

    before = total_score(score_factors(part("before")))
    rows = []
    for i, (name, description, *_) in enumerate(chosen):
        get = part(f"after{i}")
        rows.append(F.struct(
            F.lit(name).alias("intervention"), F.lit(description).alias("description"),
            before.alias("raw_before"), total_score(score_factors(get)).alias("raw_after"),
            F.col("before_fatal").alias("fatal_before"), get("fatal").alias("fatal_after"),
            F.col("before_serious").alias("serious_before"), get("serious").alias("serious_after"),
            (F.coalesce("before_casualty_sum", F.lit(0.0)) if counted else F.lit(0.0)).alias("casualties_before"),
            (F.coalesce(get("casualty_sum"), F.lit(0.0)) if counted else F.lit(0.0)).alias("casualties_after"),
        ))
    score_before, score_after = X.round1(F.col("raw_before")), X.round1(F.col("raw_after"))
    fatal_drop = F.col("fatal_before") - F.col("fatal_after")
    casualty_drop = F.col("casualties_before") - F.col("casualties_after")
    lives = (fatal_drop * F.lit(1.2) + casualty_drop * F.lit(0.1)).cast("long")
    return sums.select(F.inline(F.array(*rows))).select(
        "intervention", "description",
        score_before.alias("risk_score_before"), X.city_level(F.col("raw_before")).alias("risk_level_before"),
        score_after.alias("risk_score_after"), X.city_level(F.col("raw_after")).alias("risk_level_after"),
        "fatal_before", "fatal_after", "serious_before", "serious_after",
        "casualties_before", "casualties_after",
        X.round1(score_before - score_after).alias("risk_score_reduction"),
        X.round1((score_before - score_after) / F.greatest(score_before, F.lit(1.0)) * 100)
        .alias("risk_percentage_reduction"),
        fatal_drop.alias("fatal_reduction"), casualty_drop.alias("casualty_reduction"),
        F.greatest(F.lit(1).cast("long"), lives).alias("lives_saved_estimate"),
    )


def expected_outcomes(df: DataFrame, interventions: list[str] | None = None) -> DataFrame:
    """Expected counts after each intervention, without drawing."""
    chosen = _known(interventions)
    severity = F.col("severity")
    sums = {"total": F.count(F.lit(1))}
    sums |= {s.lower(): F.count_if(severity == s) for s in S.SEVERITIES}
    for i, (_, _, _, fewer, _) in enumerate(chosen):
        sums[f"casualties{i}"] = F.sum(F.rint(F.col("num_casualties") * F.lit(1 - fewer)))
    rows = [
        F.struct(
            F.lit(name).alias("intervention"), F.col("total").alias("accidents"),
            (F.col("fatal") * (1 - saved)).alias("expected_fatal"),
            (F.col("serious") * (1 - lighter) + F.col("fatal") * saved).alias("expected_serious"),
            (F.col("minor") + F.col("serious") * lighter).alias("expected_minor"),
            F.col(f"casualties{i}").alias("casualties_after"),
        )
        for i, (name, _, lighter, _, saved) in enumerate(chosen)
    ]
    return df.agg(*[c.alias(k) for k, c in sums.items()]).select(F.inline(F.array(*rows)))
