"""Recommendation rules and the executive summary, from one aggregate pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside import schema as S
from kerbside.functions.scalars import city_level, round1
from kerbside.operators.aggregates import groups_above_median, most_common
from kerbside.operators.risk import score_factors, score_parts, total_score


def _matches(column: str, pattern: str) -> Column:
    return F.coalesce(F.col(column).rlike(pattern), F.lit(False))


def _fired(facts: DataFrame, rules: list[tuple[Column, dict[str, Column]]]) -> DataFrame:
    """One row per rule whose condition holds."""
    rows = [
        F.struct(F.lit(i).alias("rule_no"), test.alias("fired"), *[c.alias(k) for k, c in out.items()])
        for i, (test, out) in enumerate(rules, start=1)
    ]
    return facts.select(F.inline(F.array(*rows))).where("fired").drop("fired")


def _one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", round1(value))


def condition_shares(df: DataFrame) -> DataFrame:
    """How often each risk condition occurs, in one pass over a derived table."""
    score, hour = F.col("severity_score"), F.col("hour")
    return df.agg(
        F.count_if(F.col("road_surface").isin("Wet", "Ice")).alias("wet"),
        F.count_if(_matches("light_conditions", "Dark")).alias("dark"),
        F.count_if(hour.isin(S.RUSH_HOURS)).alias("rush"),
        F.count_if((hour >= 22) | (hour <= 5)).alias("night"),
        F.count_if(F.col("day_of_week") >= 5).alias("weekend"),
        F.count_if(_matches("weather", "Fog")).alias("fog"),
        F.count_if(F.col("speed_limit") > 60).alias("fast"),
        F.count_if(F.col("junction_type") != "Not at junction").alias("at_junction"),
        F.avg(F.when(F.col("speed_limit") >= 60, score)).alias("fast_score"),
        F.avg(F.when(F.col("speed_limit") < 60, score)).alias("slow_score"),
    )


def design_recommendations(df: DataFrame) -> DataFrame:
    """Road-design rules on a derived table: category, priority, issue, recommendation, impact.

    Without ``severity_score`` the rules on junctions, surface and speed are
    left out, and the fog rule reports an average of 0.
    """
    have = set(df.columns)
    total = F.col("total")
    facts = {"total": F.count(F.lit(1))}
    scored = "severity_score" in have
    score = F.col("severity_score") if scored else F.lit(0.0)
    if "road_surface" in have and scored:
        facts["wet"] = F.count_if(F.col("road_surface").isin("Wet", "Ice"))
    if "light_conditions" in have:
        facts["dark"] = F.count_if(F.col("light_conditions") == "Dark")
    if "speed_limit" in have and scored:
        facts["fast_score"] = F.avg(F.when(F.col("speed_limit") >= 60, score))
        facts["slow_score"] = F.avg(F.when(F.col("speed_limit") < 60, score))
    if "weather" in have:
        facts["fog"] = F.count_if(F.col("weather") == "Fog")
        facts["fog_score"] = F.avg(F.when(F.col("weather") == "Fog", score))
    if "hour" in have:
        facts["rush"] = F.count_if(F.col("hour").isin(S.RUSH_HOURS))
    row = df.agg(*[c.alias(k) for k, c in facts.items()])

    def share(name: str) -> Column:
        return _one_decimal(F.try_divide(F.col(name), total) * 100)

    rules: list[tuple[Column, dict[str, Column]]] = []

    def rule(category: str, test: Column, *issue: Column) -> None:
        priority, recommendation, impact = S.DESIGN_TEXTS[category]
        rules.append((test, {
            "category": F.lit(category), "priority": F.lit(priority), "issue": F.concat(*issue),
            "recommendation": F.lit(recommendation), "expected_impact": F.lit(impact),
        }))

    def counted(name: str, ending: str) -> list[Column]:
        return [F.col(name).cast("string"), F.lit(" accidents ("), share(name), F.lit(f"%) {ending}")]

    if "junction_type" in have and scored:
        worst = groups_above_median(df, "junction_type", "severity_score")
        listing = worst.agg(F.array_join(F.sort_array(F.collect_list("junction_type")), ", "))
        row = row.withColumn("junctions", listing.scalar())
        rule("Junction Design", F.col("junctions") != "",
             F.lit("High-risk junction types: "), F.col("junctions"))
    if "wet" in facts:
        rule("Road Surface", F.col("wet") > total * 0.3, *counted("wet", "occurred on wet/icy surfaces"))
    if "dark" in facts:
        rule("Lighting Infrastructure", F.col("dark") > total * 0.35,
             *counted("dark", "occurred in dark conditions"))
    if "fast_score" in facts:
        fast, slow = F.coalesce("fast_score", F.lit(0.0)), F.coalesce("slow_score", F.lit(0.0))
        rule("Speed Management", fast > slow * 1.3,
             F.lit("High-speed roads show "), _one_decimal((F.try_divide(fast, slow) - 1) * 100),
             F.lit("% higher severity scores"))
    if "fog" in facts:
        rule("Weather Warning Systems", F.col("fog") > 5,
             F.col("fog").cast("string"), F.lit(" fog-related accidents with avg severity of "),
             _one_decimal(F.col("fog_score")))
    if "rush" in facts:
        rule("Traffic Flow Management", F.col("rush") > total * 0.4, *counted("rush", "during rush hours"))
    return _fired(row, rules)


def priority_recommendations(df: DataFrame, n_hotspots: Column | int = 0) -> DataFrame:
    """Seven rules ranked by impact. ``n_hotspots`` is a number or a scalar subquery."""
    have = set(df.columns)
    total = F.col("total")
    facts = {"total": F.count(F.lit(1))}
    if "speed_limit" in have:
        fast = F.col("speed_limit") > 60
        facts["fast"] = F.count_if(fast)
        facts["fast_fatal"] = F.count_if(fast & (F.col("severity") == "Fatal"))
    if "junction_type" in have:
        facts["at_junction"] = F.count_if(
            F.coalesce(F.col("junction_type") != "Not at junction", F.lit(True))
        )
    if "light_conditions" in have:
        facts["dark"] = F.count_if(_matches("light_conditions", "Dark"))
    if "road_surface" in have:
        facts["wet"] = F.count_if(_matches("road_surface", "Wet|Ice"))
    if "weather" in have:
        facts["fog"] = F.count_if(_matches("weather", "Fog"))
    spots = n_hotspots if isinstance(n_hotspots, Column) else F.lit(n_hotspots)
    row = df.agg(*[c.alias(k) for k, c in facts.items()]).withColumn("spots", spots)

    rules: list[tuple[Column, dict[str, Column]]] = []

    def rule(category: str, test: Column, impact: Column | None = None, priority: Column | None = None) -> None:
        points, urgency, recommendation, action, reduction, cost = S.PRIORITY_TEXTS[category]
        text = F.replace(F.lit(recommendation), F.lit("{n}"), F.col("spots").cast("string"))
        rules.append((test, {
            "category": F.lit(category), "recommendation": text, "specific_action": F.lit(action),
            "impact_score": (F.lit(points) if impact is None else impact).cast("int"),
            "priority": F.lit(urgency) if priority is None else priority,
            "estimated_reduction": F.lit(reduction), "cost_level": F.lit(cost),
        }))

    if "fast" in facts:
        deadly = F.col("fast_fatal")
        rule("Speed Control", F.col("fast") > total * 0.2,
             F.least(F.lit(90), F.lit(50) + deadly * 10),
             F.when(deadly > 0, F.lit("Critical")).otherwise(F.lit("High")))
    if "at_junction" in facts:
        rule("Junction Redesign", F.col("at_junction") > total * 0.3)
    if "dark" in facts:
        rule("Lighting Improvement", F.col("dark") > total * 0.25)
    if "wet" in facts:
        rule("Road Surface", F.col("wet") > total * 0.2)
    if "fog" in facts:
        rule("Visibility Enhancement", F.col("fog") > 5)
    rule("Traffic Calming", F.col("spots") > 3)
    rule("Signage Improvement", F.lit(True))

    by_impact = Window.orderBy(F.desc("impact_score"), "rule_no")  # at most seven rows
    return (
        _fired(row, rules)
        .withColumn("rank", F.row_number().over(by_impact))
        .drop("rule_no")
        .orderBy("rank")
    )


def executive_summary(df: DataFrame, n_hotspots: Column | int = 0, n_high: Column | int = 0) -> DataFrame:
    """One row: the summary sentence built from counts, city level and hotspots."""
    have = set(df.columns)
    spots = n_hotspots if isinstance(n_hotspots, Column) else F.lit(n_hotspots)
    high = n_high if isinstance(n_high, Column) else F.lit(n_high)
    casualties = F.col("num_casualties") if "num_casualties" in have else None
    facts = score_parts(df.columns, F.col("severity"), casualties)
    if "weather" in have:
        facts["rain"] = F.count_if(F.col("weather") == "Rain")
    raw = total_score(score_factors(lambda name: F.col(name) if name in facts else None))
    row = df.agg(*[c.alias(k) for k, c in facts.items()]).withColumns({
        "spots": spots, "high": high, "score": round1(raw), "level": city_level(raw),
    })
    if "road_type" in have:
        row = row.withColumn("road", most_common(df, "road_type"))
    points = F.concat(F.col("score").cast("string"), F.lit("/100)."))
    deadly, clustered = F.col("fatal") > 0, F.col("spots") > 0
    sentences = [
        F.when(F.col("level") == "High", F.concat(F.lit("ALERT: City risk level is HIGH ("), points))
        .when(F.col("level") == "Medium", F.concat(F.lit("CAUTION: City risk level is MODERATE ("), points))
        .otherwise(F.concat(F.lit("City risk level is LOW ("), points)),
        F.concat(F.lit("Analysis covers "), "total", F.lit(" recorded accidents.")),
        F.when(deadly, F.concat(F.lit("CRITICAL: "), "fatal", F.lit(" fatal accidents recorded - immediate action required."))),
        F.when(clustered, F.concat(F.lit("Identified "), "spots", F.lit(" accident clusters, "), "high", F.lit(" are high-risk zones."))),
    ]
    actions = [
        F.when(deadly, F.lit("Review speed limits in fatal accident zones")),
        F.when(clustered, F.lit("Deploy traffic calming at identified hotspots")),
    ]
    if "weather" in have:
        sentences.append(F.when(F.col("rain") > F.col("total") * 0.3, F.lit(
            "Weather factor: Rain contributes to 30%+ of accidents - consider drainage improvements.")))
        actions.append(F.when(F.col("rain") > 0, F.lit("Improve road drainage and visibility during rain")))
    if "road_type" in have:
        sentences.append(F.concat(F.lit("Most accidents occur on "), "road", F.lit(" roads.")))
    listed = F.concat_ws("; ", *actions)
    sentences.append(F.when(listed != "", F.concat(F.lit("RECOMMENDED ACTIONS: "), listed, F.lit("."))))
    return row.select(
        "level", "score", F.col("total").alias("total_accidents"), F.col("fatal").alias("fatal_count"),
        F.concat_ws(" ", *sentences).alias("summary"),
    )
