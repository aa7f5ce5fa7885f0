"""From raw documents to token shards in five stages.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads;
all but the last return the columns of documents. Each works on everything
its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbside.llm import decontaminate, langid, mixing, simhash, token_shards
from kerbside.llm.common import documents
from kerbside.session import discard, materialise, working_tables


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like one of the learned languages."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    return simhash.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token shards in training order below the shared folder; returns their index."""
    return token_shards.write_shards(docs, token_shards.shard_path(spark))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mix", mix),
    ("tokens", tokens),
]

# SQL can express neither the language model nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again.

    A stage's input goes once its result is written, and so does what a stage writes besides.
    """
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        with working_tables() as keep:
            docs = materialise(stage(spark, docs, sf_dir), name)
            keep.append(docs)
        if before is not None:
            discard(before)
        before = docs
    return docs
