"""Training state that appends add to, so that old rows are never read again.

All models train on counts per distinct combination of inputs and outcome, and
counts of two tables add up. A state is such counts, written per version; an
append counts the new rows only, adds them to the last version and writes the
next. The log holds one row per version, appended last, so a version counts
once its row is there, and readers never see half of one. Every append names
its batch; a batch that is in the log already changes nothing, so a job that
is run again, or a stream's micro-batch, counts once.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators.classify import SeverityModel, save, severity_profiles, train_from_profiles
from kerbside.operators.regression import (
    CountFit, count_profiles, fit_negative_binomial, fit_poisson, save_fit,
)

_LOG_DDL = "version INT, batch STRING, folder STRING"


class State(NamedTuple):
    version: int
    severity: DataFrame  # as from severity_profiles
    counts: DataFrame    # as from count_profiles


class Models(NamedTuple):
    severity: SeverityModel
    poisson: CountFit
    negative_binomial: CountFit


def _log(spark: SparkSession, folder: str) -> list:
    path = f"{folder}/log"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return []
    return spark.read.schema(_LOG_DDL).parquet(path).orderBy("version").collect()


def state(spark: SparkSession, folder: str, version: int | None = None) -> State:
    """The last version, or a given one."""
    rows = [r for r in _log(spark, folder) if version in (None, r["version"])]
    if not rows:
        raise ValueError(f"no training state{'' if version is None else f' of version {version}'} in {folder}")
    path = f"{folder}/{rows[-1]['folder']}"
    return State(
        rows[-1]["version"], spark.read.parquet(f"{path}/severity"), spark.read.parquet(f"{path}/counts"))


def _added(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Counts of both; a column that one side lacks is null there."""
    if old is None:
        return new
    both = old.unionByName(new, allowMissingColumns=True)
    return both.groupBy(*[c for c in both.columns if c != "n"]).agg(F.sum("n").alias("n"))


def append(spark: SparkSession, folder: str, rows: DataFrame, batch: str, key: str = "accident_id") -> int:
    """Add the counts of standardised ``rows``; returns the version that holds them.

    Writers take turns: two that append at the same time would both add to the
    same version, which the log shows and the later one reports.
    """
    log = _log(spark, folder)
    done = [r["version"] for r in log if r["batch"] == batch]
    if done:
        return done[0]
    last = state(spark, folder) if log else None
    version, name = (last.version + 1 if last else 1), f"state-{uuid.uuid4().hex}"
    for label, old, new in (
        ("severity", last and last.severity, severity_profiles(rows, key)),
        ("counts", last and last.counts, count_profiles(rows)),
    ):
        _added(old, new).write.parquet(f"{folder}/{name}/{label}")
    spark.createDataFrame([(version, batch, name)], _LOG_DDL).coalesce(1).write.mode("append").parquet(f"{folder}/log")
    if sum(r["version"] == version for r in _log(spark, folder)) > 1:
        raise RuntimeError(f"another writer added version {version} at the same time")
    return version


def fit(spark: SparkSession, folder: str, version: int | None = None, model_folder: str | None = None) -> Models:
    """All models from the counts of a version; with ``model_folder`` all of them are stored."""
    counted = state(spark, folder, version)
    models = Models(
        train_from_profiles(counted.severity), fit_poisson(counted.counts), fit_negative_binomial(counted.counts))
    if model_folder:
        store(models, model_folder)
    return models


def store(models: Models, model_folder: str) -> str:
    """Write all models under the version of the severity model; ``latest`` moves last."""
    path = f"{model_folder}/{models.severity.version}"
    save_fit(models.poisson, f"{path}/poisson")
    save_fit(models.negative_binomial, f"{path}/negative_binomial")
    return save(models.severity, model_folder)
