"""Session settings and materialisation on the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: ContextVar[dict[str, SparkSession] | None] = ContextVar("written", default=None)


def get_session(app: str = "kerbside", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder named by the session.

    A local master without one gets a temporary folder. A cluster must name a
    folder every executor can reach: a machine-local one would be lost with
    its machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the executors")
            named = tempfile.mkdtemp(prefix="kerbside-")
        sc.setCheckpointDir(named)
        current = sc.getCheckpointDir()
    return current


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed by Hadoop when the driver exits."""
    path = f"{shared_folder(spark)}/kerbside/{label}-{uuid.uuid4().hex}"
    files, target = _hadoop(spark, path)
    files.deleteOnExit(target)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet on the shared folder and read it back.

    Cuts the lineage, survives executor loss, and unlike an RDD checkpoint
    keeps column pruning, filter pushdown and true sizes for join planning.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch = path
    tables = _written.get()
    if tables is not None:
        tables[path] = df.sparkSession
    return table


def discard(table: DataFrame) -> None:
    """Delete a table written by ``materialise`` that nothing reads any more."""
    files, target = _hadoop(table.sparkSession, table._scratch)
    files.delete(target, True)


@contextmanager
def working_tables() -> Iterator[list[DataFrame]]:
    """Delete the tables materialised inside the block, except those put on the yielded list.

    Multi-step operators would otherwise leave several copies of their input
    on the shared folder until the driver exits. Nested blocks hand the tables
    they keep to the enclosing one.
    """
    keep: list[DataFrame] = []
    outer, mine = _written.get(), {}
    token = _written.set(mine)
    try:
        yield keep
    finally:
        _written.reset(token)
        kept = {table._scratch for table in keep}
        for path, spark in mine.items():
            if path not in kept:
                files, target = _hadoop(spark, path)
                files.delete(target, True)
            elif outer is not None:
                outer[path] = spark
