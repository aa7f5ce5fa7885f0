import os
import re
from collections import Counter

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F
from test_llm_decontaminate import brute as brute_windows
from test_llm_simhash import components, fingerprint

import corpus_pipeline
from kerbside.llm import langid, token_shards
from kerbside.llm.common import documents
from kerbside.session import materialise, shared_folder


@pytest.fixture(scope="module")
def kept(spark):
    docs, tables = documents(spark, TESTDATA), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, TESTDATA), name)
        tables.append(docs)
    return tables


def test_stages_equal_brute_force(spark, kept):
    docs = documents(spark, TESTDATA)
    assert all(t.columns == docs.columns for t in kept[:-1])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = [{r["doc_id"] for r in t.select("doc_id").collect()} for t in kept[:-1]]
    named = {r["doc_id"] for r in langid.report(docs).where("lang_pred <> 'und'").collect()}
    assert ids[0] <= named and len(ids[0]) >= 0.95 * len(named)
    order = sorted(ids[0])
    roots = components([fingerprint(texts[i]) for i in order])
    assert ids[1] == {order[k] for k in set(roots)}
    items = [tuple(r) for r in spark.read.parquet(f"{TESTDATA}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {d for d, _, n, _ in brute_windows([(i, texts[i]) for i in sorted(ids[1])], items) if n}
    assert ids[2] == ids[1] - hit and hit
    copies = Counter(r["doc_id"] for r in kept[3].select("doc_id").collect())
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", texts[i])) for i in ids[2]}
    assert set(copies) <= ids[2] and max(copies.values()) <= 2
    assert abs(sum(n * size[i] for i, n in copies.items()) - 1.5 * sum(size.values())) <= max(size.values())
    assert {d for r in kept[4].select("doc_ids").collect() for d in r["doc_ids"]} == set(copies)


def test_index_is_whole(kept):
    index = kept[4]
    n = index.count()
    assert index.agg(F.min("slot"), F.max("slot"), F.countDistinct("slot")).first() == (0, n - 1, n)
    assert index.where(F.col("n_ids") > token_shards.SEQUENCE).count() == 0


def _written(spark):
    """Folders with Parquet files on the shared folder, by their labels."""
    top = shared_folder(spark).removeprefix("file:") + "/kerbside"
    return {n for n in os.listdir(top) if os.path.isdir(f"{top}/{n}") and os.listdir(f"{top}/{n}")} if os.path.isdir(top) else set()


def test_run_leaves_its_result_only(spark):
    before = _written(spark)
    result = corpus_pipeline.run(spark, TESTDATA)
    left = {n.rsplit("-", 1)[0] for n in _written(spark) - before}
    assert result.count() > 0
    assert not left & {"language", "near_duplicates", "benchmark", "mix", "rows", "prints", "distinct", "components"}
