"""Count regressions of casualties.

Rows are first counted per distinct combination of inputs and outcome. The
fits then iterate over that small table with its counts as weights: one pass
over the accidents, whatever the number of iterations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators.joins import skew_join
from kerbside.session import materialise, working_tables

NUMERIC = ["speed_limit", "num_vehicles"]
SOLVER_COLUMNS = 4000  # as many columns go into one system of equations
CATEGORIES = ["weather", "road_type", "light_conditions"]
_STATS_DDL = (
    "model STRING, fitted BOOLEAN, aic DOUBLE, bic_deviance DOUBLE, bic_llf DOUBLE, pseudo_r2 DOUBLE, "
    "deviance DOUBLE, null_deviance DOUBLE, n_rows BIGINT, significant_features ARRAY<STRING>, error STRING"
)


class CountFit(NamedTuple):
    stats: DataFrame          # one row
    coefficients: DataFrame   # (feature, coefficient, p_value)


def _unfitted(df: DataFrame, model: str, error: str) -> CountFit:
    spark = df.sparkSession
    row = (model, False, None, None, None, None, None, None, 0, [], error)
    return CountFit(
        spark.createDataFrame([row], _STATS_DDL),
        spark.createDataFrame([], "feature STRING, coefficient DOUBLE, p_value DOUBLE"),
    )


def _result(df, model, names, coefficients, p_values, aic, deviance, null_deviance, n) -> CountFit:
    spark = df.sparkSession
    k = len(names)
    significant = [f for f, p in zip(names, p_values, strict=True) if p is not None and p < 0.05]
    row = (
        model, True, aic, deviance - (n - k) * math.log(n), aic - 2 * k + k * math.log(n),
        1 - deviance / null_deviance if null_deviance else None, deviance, null_deviance, n, significant, None,
    )
    return CountFit(
        spark.createDataFrame([row], _STATS_DDL),
        spark.createDataFrame(
            [(f, float(c), p) for f, c, p in zip(names, coefficients, p_values, strict=True)],
            "feature STRING, coefficient DOUBLE, p_value DOUBLE",
        ),
    )


def count_profiles(df: DataFrame) -> DataFrame:
    """Rows ``n`` per distinct (casualties ``y``, inputs); the fits need no more of the data.

    Profiles of two tables add up to those of both. Rows without casualties are left out.
    """
    inputs = [
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in NUMERIC else F.col(c)
        for c in [*NUMERIC, *CATEGORIES] if c in df.columns
    ]
    rows = df.where(F.col("num_casualties").isNotNull()).select(
        F.col("num_casualties").cast("int").cast("double").alias("y"), *inputs)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


def _profiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct (y, inputs) with the number of rows ``n``, written; ``df`` is a table of rows or of such profiles."""
    counted = count_profiles(df) if "num_casualties" in df.columns else df
    return materialise(counted.groupBy("y", *columns).agg(F.sum("n").alias("n")), "profiles")


def dummy_columns(df: DataFrame, column: str) -> list[tuple[str, Column]]:
    """0/1 indicators per category in alphabetical order, the first category left out.

    One column per category by definition; a table of (row, category) pairs is
    the form for very many.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).collect()
    return [
        (f"{column}_{r[0]}", F.coalesce((F.col(column) == r[0]).cast("double"), F.lit(0.0)))
        for r in values[1:]
    ]


def fit_poisson(df: DataFrame) -> CountFit:
    """Poisson regression (log link) on speed, vehicles, weather, road type and light.

    ``df`` holds rows, or their ``count_profiles``.
    """
    with working_tables() as keep:
        return _poisson(df, keep)


def _poisson(df: DataFrame, keep: list[DataFrame]) -> CountFit:
    if not {"num_casualties", "y"} & set(df.columns):
        return _unfitted(df, "poisson", "num_casualties column not found")
    numeric = [c for c in NUMERIC if c in df.columns]
    categories = [c for c in CATEGORIES if c in df.columns]
    if not numeric + categories:
        return _unfitted(df, "poisson", "Insufficient features")
    table = _profiles(df, numeric + categories)
    levels = [F.count_distinct(c) for c in categories]
    if categories and sum(table.agg(*levels).first()) > SOLVER_COLUMNS:
        return _poisson_by_blocks(df, table, numeric, categories, keep)
    dummies = [d for c in categories for d in dummy_columns(table, c)]
    names = numeric + [name for name, _ in dummies]
    n = table.agg(F.sum("n")).first()[0] or 0
    if n == 0:
        return _unfitted(df, "poisson", "no rows")
    wide = table.select("y", F.col("n").cast("double").alias("n"), *numeric,
                        *[c.alias(f"dummy{i}") for i, (_, c) in enumerate(dummies)])
    inputs = numeric + [f"dummy{i}" for i in range(len(dummies))]
    matrix = VectorAssembler(inputCols=inputs, outputCol="x").transform(wide)
    model = GeneralizedLinearRegression(
        family="poisson", link="log", labelCol="y", featuresCol="x", weightCol="n",
        maxIter=100, tol=1e-8,
    ).fit(matrix)
    summary = model.summary
    try:
        p_values = list(summary.pValues)  # features, then the intercept
    except Exception:  # singular design: fitted without standard errors
        p_values = [None] * (len(names) + 1)
    return _result(
        df, "poisson", ["const", *names], [model.intercept, *model.coefficients],
        [p_values[-1], *p_values[:-1]], summary.aic, summary.deviance, summary.nullDeviance, n,
    )


def _poisson_by_blocks(
    df: DataFrame, table: DataFrame, numeric: list[str], categories: list[str], keep: list[DataFrame],
    max_rounds: int = 200, tol: float = 1e-9,
) -> CountFit:
    """The same fit with any number of categories, one block of coefficients at a time.

    The indicators of a column exclude each other, so its coefficients have a
    closed form given the rest: the log ratio of observed to expected sums per
    category, a group-by and a join. Constant and numeric coefficients take a
    Newton step on a small system. Every category has a coefficient while the
    rounds go on, until the deviance stands still; the first category's is then
    moved into the constant. Standard errors come from ``_block_errors``.
    """
    y, n = F.col("y"), F.col("n")
    x = [F.lit(1.0), *[F.col(c) for c in numeric]]
    k = len(x)
    total, ys, n_profiles = table.agg(F.sum("n"), F.sum(y * n), F.count(F.lit(1))).first()
    if not total or not ys:
        return _unfitted(df, "poisson", "no casualties to fit")
    firsts = table.agg(*[F.min(c).alias(c) for c in categories]).first().asDict()
    beta = np.array([math.log(ys / total), *[0.0] * len(numeric)])
    firsts = {c: "" if v is None else v for c, v in firsts.items()}
    table = table.withColumns({c: F.coalesce(F.col(c), F.lit(firsts[c])) for c in categories})  # a gap has no indicator
    effects = {c: materialise(table.select(c).distinct().withColumn("effect", F.lit(0.0)), "effects") for c in categories}

    def fitted(beta: np.ndarray) -> DataFrame:
        rows = table
        for c in categories:
            rows = skew_join(rows, effects[c].withColumnRenamed("effect", f"_{c}"), [c], left_rows=n_profiles)
        eta = sum((F.lit(float(b)) * v for b, v in zip(beta, x)), sum((F.col(f"_{c}") for c in categories), F.lit(0.0)))
        return rows.withColumn("mu", F.exp(eta))

    def deviance_of(mean: Column) -> Column:
        return F.sum(n * 2 * (F.when(y > 0, y * F.ln(y / mean)).otherwise(0.0) - (y - mean)))

    deviance = math.inf
    mu = F.col("mu")
    for _ in range(max_rounds):
        for c in categories:
            ratio = fitted(beta).groupBy(c).agg(F.ln(F.greatest(F.sum(n * y), F.lit(1e-9)) / F.sum(n * mu)).alias("step"))
            effects[c] = materialise(
                effects[c].join(ratio, c).select(c, (F.col("effect") + F.col("step")).alias("effect")), "effects")
        cells = {f"g{i}_{j}": F.sum(n * mu * x[i] * x[j]) for i in range(k) for j in range(i, k)}
        cells |= {f"h{i}": F.sum(n * (y - mu) * x[i]) for i in range(k)}
        sums = fitted(beta).agg(*[c.alias(name) for name, c in cells.items()]).first()
        gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        beta = beta + np.linalg.pinv(gram) @ np.array([sums[f"h{i}"] for i in range(k)])
        last, deviance = deviance, fitted(beta).agg(deviance_of(mu)).first()[0]
        if abs(last - deviance) <= tol * (abs(deviance) + 1):
            error = None
            break
    else:
        error = f"not converged after {max_rounds} rounds"
    big = y * F.ln(y) - y + F.ln(2 * math.pi * y) / 2 + 1 / (12 * y) - 1 / (360 * y * y * y)  # of y!, beyond 20
    log_factorial = F.when(y > 20, big).otherwise(F.ln(F.factorial(F.least(y, F.lit(20.0)).cast("int"))))
    null_deviance, llf = fitted(beta).agg(
        deviance_of(F.lit(ys / total)), F.sum(n * (y * F.ln(mu) - mu - log_factorial))).first()
    errors = _block_errors(fitted(beta), numeric, {c: (firsts[c], effects[c].count()) for c in categories})
    base = {c: effects[c].where(F.col(c) == F.lit(firsts[c])).first()["effect"] for c in categories}
    beta[0] += sum(base.values())
    effects = {c: effects[c].where(F.col(c) != F.lit(firsts[c])).withColumn("effect", F.col("effect") - base[c]) for c in categories}
    size = k + sum(e.count() for e in effects.values())
    spark = df.sparkSession
    fixed = spark.createDataFrame(
        [(f, float(b)) for f, b in zip(["const", *numeric], beta)], "feature STRING, coefficient DOUBLE")
    for c in categories:
        name = F.concat(F.lit(f"{c}_"), F.col(c).cast("string")).alias("feature")
        fixed = fixed.unionByName(effects[c].select(name, F.col("effect").alias("coefficient")))
    unknown = F.lit(None).cast("double")
    if errors is None:
        fixed, significant = fixed.withColumn("p_value", unknown), None
    else:
        # two-sided normal tail, for each feature on its own row
        fixed = fixed.join(errors, "feature", "left").mapInPandas(
            _tails, "feature STRING, coefficient DOUBLE, p_value DOUBLE")
    coefficients = materialise(fixed, "coefficients")
    keep.append(coefficients)
    if errors is not None:
        significant = [r["feature"] for r in coefficients.where("p_value < 0.05").select("feature").collect()]
    row = (
        "poisson", True, -2 * llf + 2 * size, deviance - (total - size) * math.log(total), -2 * llf + size * math.log(total),
        1 - deviance / null_deviance if null_deviance else None, deviance, null_deviance, total, significant, error,
    )
    return CountFit(spark.createDataFrame([row], _STATS_DDL), coefficients)


def _tails(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for table in tables:
        table["p_value"] = [
            math.erfc(abs(b / e) / math.sqrt(2)) if e and e > 0 else None for b, e in zip(table["coefficient"], table.pop("error"))]
        yield table


def _block_errors(rows: DataFrame, numeric: list[str], levels: dict[str, tuple[str, int]]) -> DataFrame | None:
    """(feature, error): standard errors of a fit with very many indicators; ``levels`` holds first value and count.

    The indicators of the column with most categories exclude each other, so
    their block of the information matrix is diagonal and is eliminated: what
    is left is a small dense matrix S of the constant, the numeric inputs and
    the other columns, summed up per category of the large column. With S
    inverted, each category's own error follows from its sums alone. None if
    the other columns have more than ``SOLVER_COLUMNS`` categories.
    """
    spark = rows.sparkSession
    big = max(levels, key=lambda c: levels[c][1])
    small = [c for c in levels if c != big]
    if sum(levels[c][1] for c in small) > SOLVER_COLUMNS:
        return None
    features = ["const", *numeric]
    for c in small:
        features += [f"{c}_{r[0]}" for r in rows.where(F.col(c) != levels[c][0]).select(c).distinct().orderBy(c).collect()]
    place = {f: i for i, f in enumerate(features)}
    entry = lambda key, value: F.struct(key.alias("key"), value.cast("double").alias("v"))
    entries = F.array(
        entry(F.lit("const"), F.lit(1.0)), *[entry(F.lit(c), F.col(c)) for c in numeric],
        *[entry(F.concat(F.lit(f"{c}_"), F.col(c).cast("string")), (F.col(c) != levels[c][0]).cast("int")) for c in small])
    weighted = materialise(rows.select(
        F.when(F.col(big) != levels[big][0], F.col(big).cast("string")).alias("level"), (F.col("n") * F.col("mu")).alias("w"),
        F.filter(entries, lambda e: e["v"] != 0).alias("entries")), "weighted")
    pairs = weighted.select("w", "entries", F.explode("entries").alias("a")).select("w", "a", F.explode("entries").alias("b"))
    s = np.zeros((len(features), len(features)))
    for r in pairs.groupBy("a.key", F.col("b.key").alias("other")).agg(F.sum(F.col("w") * F.col("a.v") * F.col("b.v")).alias("v")).collect():
        s[place[r["key"]], place[r["other"]]] = r["v"]
    # per category of the large column: its weight and its sums with every other column, at most SOLVER_COLUMNS
    sums = weighted.where("level IS NOT NULL").select("level", "w", F.explode("entries").alias("e")).groupBy("level", "e.key").agg(
        F.sum(F.col("w") * F.col("e.v")).alias("v"), F.sum(F.when(F.col("e.key") == "const", F.col("w"))).alias("d"))
    per_level = materialise(sums.groupBy("level").agg(
        F.collect_list("key").alias("keys"), F.collect_list("v").alias("values"), F.max("d").alias("d")), "per-level")

    def eliminated(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(place), len(place)))
        for table in tables:
            for keys, values, d in zip(table["keys"], table["values"], table["d"]):
                at = [place[k] for k in keys]
                total[np.ix_(at, at)] += np.outer(values, values) / d
        a, b = np.nonzero(total)
        yield pd.DataFrame({"a": a, "b": b, "v": total[a, b]})

    for r in per_level.mapInPandas(eliminated, "a INT, b INT, v DOUBLE").groupBy("a", "b").agg(F.sum("v").alias("v")).collect():
        s[r["a"], r["b"]] -= r["v"]
    inverse = np.linalg.pinv(s, hermitian=True)
    shared = spark.sparkContext.broadcast(inverse)  # at most SOLVER_COLUMNS squared numbers

    def own(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for table in tables:
            errors = []
            for keys, values, d in zip(table["keys"], table["values"], table["d"]):
                at = [place[k] for k in keys]
                errors.append(math.sqrt(1 / d + values @ shared.value[np.ix_(at, at)] @ values / d ** 2))
            yield pd.DataFrame({"feature": [f"{big}_{v}" for v in table["level"]], "error": errors})

    others = spark.createDataFrame(
        [(f, float(math.sqrt(max(v, 0)))) for f, v in zip(features, np.diag(inverse))], "feature STRING, error DOUBLE")
    return per_level.mapInPandas(own, "feature STRING, error DOUBLE").unionByName(others)


def save_fit(fit: CountFit, path: str) -> None:
    fit.stats.write.mode("overwrite").parquet(f"{path}/stats")
    fit.coefficients.write.mode("overwrite").parquet(f"{path}/coefficients")


def load_fit(spark: SparkSession, path: str) -> CountFit:
    return CountFit(spark.read.parquet(f"{path}/stats"), spark.read.parquet(f"{path}/coefficients"))


def _sums(table: DataFrame, expressions: dict[str, Column]) -> dict[str, float]:
    weight = F.col("n")
    return table.agg(*[F.sum(e * weight).alias(k) for k, e in expressions.items()]).first().asDict()


def _nb_deviance(mean: Column) -> Column:
    """Unit deviance of the negative binomial with dispersion 1."""
    y = F.col("y")
    first = F.when(y > 0, y * F.ln(y / mean)).otherwise(F.lit(0.0))
    return (first - (y + 1) * F.ln((y + 1) / (mean + 1))) * 2


def fit_negative_binomial(df: DataFrame, max_iter: int = 100, tol: float = 1e-8) -> CountFit:
    """Negative-binomial regression (log link, dispersion 1) on speed and vehicles.

    Iteratively reweighted least squares: each round is one aggregate of the
    weighted cross products; only a k x k system reaches the driver. ``df`` holds
    rows, or their ``count_profiles``.
    """
    with working_tables():
        return _negative_binomial(df, max_iter, tol)


def _negative_binomial(df: DataFrame, max_iter: int, tol: float) -> CountFit:
    if not {"num_casualties", "y"} & set(df.columns):
        return _unfitted(df, "negative_binomial", "num_casualties column not found")
    names = [c for c in NUMERIC if c in df.columns]
    if not names:
        return _unfitted(df, "negative_binomial", "Insufficient numeric features")
    table = _profiles(df, names)
    base = table.agg(F.sum("n").alias("n"), F.sum(F.col("y") * F.col("n")).alias("y")).first()
    if not base["n"] or not base["y"]:
        return _unfitted(df, "negative_binomial", "no casualties to fit")
    n, mean_y = base["n"], base["y"] / base["n"]
    x = [F.lit(1.0), *[F.col(c) for c in names]]
    k = len(x)
    mean = (F.col("y") + mean_y) / 2
    deviance = math.inf
    for _ in range(max_iter):
        weight = mean / (mean + 1)
        target = F.ln(mean) + (F.col("y") - mean) / mean
        cells = {f"g{i}_{j}": weight * x[i] * x[j] for i in range(k) for j in range(i, k)}
        cells |= {f"h{i}": weight * x[i] * target for i in range(k)}
        sums = _sums(table, cells)
        gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        beta = np.linalg.pinv(gram) @ np.array([sums[f"h{i}"] for i in range(k)])
        eta = sum((F.lit(float(b)) * c for b, c in zip(beta[1:], x[1:], strict=True)), F.lit(float(beta[0])))
        mean = F.exp(eta)
        last, deviance = deviance, _sums(table, {"d": _nb_deviance(mean)})["d"]
        if abs(deviance - last) <= max(tol, 1e-13 * abs(deviance)):  # absolute, down to rounding noise
            break
    weight = mean / (mean + 1)
    final = {f"g{i}_{j}": weight * x[i] * x[j] for i in range(k) for j in range(i, k)}
    final["llf"] = F.col("y") * F.ln(mean) - (F.col("y") + 1) * F.ln(mean + 1)
    final["null"] = _nb_deviance(F.lit(mean_y))
    sums = _sums(table, final)
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    errors = np.sqrt(np.diag(np.linalg.pinv(gram)))
    p_values = [
        math.erfc(abs(b / e) / math.sqrt(2)) if e > 0 else None for b, e in zip(beta, errors, strict=True)
    ]
    return _result(
        df, "negative_binomial", ["const", *names], beta, p_values,
        -2 * sums["llf"] + 2 * k, deviance, sums["null"], n,
    )
