import hashlib

import numpy as np
import pytest
from llm_tables import awkward, docs_of
from pyspark.sql import functions as F

from kerbside.llm import token_shards as T
from kerbside.llm.token_shards import Encoder

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(T.VOCABULARY, "rb") as file:
        return file.read()


def test_words_are_encoded_as_whole_texts(ranks):
    encoder = Encoder(ranks)
    for text in (
        "a", " a", "a ", "  a  b ", "Hello, world. It's fine!", "x\n y \nz\n\n w", "tab\there   three", "été,. ça;va ?!", "  no break ",
        "1,5 2.5, don't 'tis we'll.", "\U0001f600 \U0001f600. ", "end.\n", " \n \n ", "a  b c", "ab. cd, ef.",
    ):
        for _ in range(2):
            assert np.frombuffer(encoder.encode(text), "<u2").tolist() == encoder._ids(text)


def test_feistel_is_a_keyed_permutation():
    for n in (1, 2, 3, 4, 5, 16, 17, 1000, 4097):
        slots = T.feistel(np.arange(n), n)
        assert sorted(slots.tolist()) == list(range(n))
    assert T.feistel(np.arange(1000), 1000).tolist() != T.feistel(np.arange(1000), 1000, key=1).tolist()
    assert T.feistel(np.array([5, 7]), 1000).tolist() == T.feistel(np.arange(1000), 1000)[[5, 7]].tolist()


def test_round_trip(spark, ranks, monkeypatch):
    monkeypatch.setattr(T, "_PACK_IDS", 300)
    texts = [f"document {i}: " + "some words, and more. " * (i % 17) for i in range(150)]
    docs = docs_of(spark, texts, size=1).repartition(4)
    path = T.shard_path(spark)
    index = T.write_shards(docs, path, sequence=32, shard_bytes=64 * 9).toPandas()
    back = {r["slot"]: r["ids"] for r in T.read_shards(spark, path, 32, 64 * 9).collect()}
    assert sorted(back) == sorted(index["slot"]) == list(range(len(index)))
    for r in index.itertuples():
        assert hashlib.sha256(np.array(back[r.slot], "<u2").tobytes()).hexdigest() == r.sha256
        assert (r.shard, r.offset) == (r.slot // 9, r.slot % 9 * 64)
    resumed = T.read_shards(spark, path, 32, 64 * 9, first_slot=100)
    assert sorted(r["slot"] for r in resumed.collect()) == list(range(100, len(index)))
    # every document stands whole, its end marked, in the sequences listing it
    encoder = Encoder(ranks)
    marked = sum(r.doc_ids.tolist().count(d) for r in index.itertuples() for d in set(r.doc_ids.tolist()))
    assert marked == sum(len(r.doc_ids) for r in index.itertuples())
    assert sum(index["n_ids"]) == sum(len(encoder.encode(t)) // 2 + 1 for t in texts)
    for doc in (0, 16, 149):
        rows = index[[doc in ids for ids in index["doc_ids"]]]
        want = np.frombuffer(encoder.encode(texts[doc]), "<u2").tolist()
        joined = [x for r in rows.itertuples() for x in back[r.slot]]
        assert set(want) <= set(joined) and len(want) + 1 <= len(joined)


def test_awkward_rows(spark):
    docs = awkward(spark)
    path = T.shard_path(spark)
    index = T.write_shards(docs, path, sequence=64)
    listed = [d for r in index.collect() for d in set(r["doc_ids"])]
    assert set(listed) == {1, None, 4, 5, 6, 7}
    empty = T.shard_path(spark)
    assert T.write_shards(docs.where(F.lit(False)), empty).count() == 0 and T.read_shards(spark, empty).count() == 0
