"""Small tables with every awkward case, shared by the tests."""

from pyspark.sql import functions as F

CASES = [
    (1, "the cat sat on the mat and the dog ran off home again", "en", "a", 5),
    (1, "the cat sat on the mat and the dog ran off home again", "en", "a", 5),  # repeated row
    (2, None, "en", None, None),
    (3, "", None, "b", 0),
    (None, "the cat sat on the mat and the dog ran off home again", None, None, 1),
    (4, " \t\r\n ", "fr", "c", 5),
    (5, "word " * 30_000, "en", "b", 150_000),
    (6, "ünïcödé \U0001f600 été", "fr", "a", 10),
    (7, "1234 5678 $$$ !!!", "de", "d", 10),
]
# names that operators use themselves
EXTRA = ("size", "copies", "n", "fp", "row", "doc", "start", "n_hit", "items", "score", "component_id", "_row", "a.b")


def awkward(spark):
    df = spark.createDataFrame(CASES, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    return df.select("*", *[F.lit(i).alias(name) for i, name in enumerate(EXTRA)])


def docs_of(spark, texts, **columns):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    return df.select("*", *[F.lit(v).alias(k) for k, v in columns.items()])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
