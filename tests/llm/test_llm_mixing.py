from llm_tables import awkward, rows
from pyspark.sql import functions as F

from kerbside.llm import mixing


def table(spark):
    """Source s0 holds far more than the others; sizes from 1 to 12."""
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 7)).alias("source"),
        F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 12 + 1).cast("int"))).alias("text"))
    return df.withColumn("source", F.when(F.col("source") != "s6", F.col("source")))


def test_targets_and_taken(spark):
    df = table(spark)
    got = mixing.mix_report(df).toPandas()
    total = got["size"].sum()
    by = got.merge(df.select("doc_id", "source").toPandas(), on="doc_id").groupby("source", dropna=False)
    report = by.agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (report["size"] == report["source_size"]).all()
    assert abs(report["target"].sum() - 1.5 * total) < 1e-6
    assert (report["target"] <= 2 * report["source_size"]).all()
    assert ((report["taken"] - report["target"]).abs() <= 24).all()
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] % got["size"] == 0).all()
    # sources below their cap share by weight: 5, 2, 1 in code point order, null last
    order = report.sort_index(na_position="last")
    level = (order["target"] / [5, 2, 1, 5, 2, 1, 5][: len(order)]).max()
    for target, cap, weight in zip(order["target"], 2 * order["source_size"], [5, 2, 1, 5, 2, 1, 5]):
        assert abs(target - min(cap, weight * level)) < 1e-6


def test_reruns_agree_and_rows_follow_the_report(spark):
    df = table(spark)
    report = mixing.mix_report(df)
    assert rows(report) == rows(mixing.mix_report(df.repartition(7, "text")))
    mixed = mixing.mix(df.withColumn("copies", F.lit("x")))
    assert mixed.columns == ["doc_id", "source", "text", "copies"]
    assert rows(mixed.groupBy("doc_id").count().select("doc_id", "count")) == rows(
        report.where("copies > 0").select("doc_id", "copies"))


def test_awkward_rows(spark):
    df = awkward(spark)
    got = mixing.mix_report(df)
    assert got.count() == df.count()
    assert {r["size"]: r["taken"] for r in got.where("size = 0").collect()} == {0: 0}
    assert mixing.mix(df).columns == df.columns
    assert mixing.mix_report(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
