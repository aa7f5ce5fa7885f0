import math
import re
from collections import Counter

import pytest
from llm_tables import EXTRA, awkward
from pyspark.sql import functions as F

from kerbside.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, items, top=10):
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, n_words = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for t, k in df.items()}
    result = []
    for key, text in items:
        asked, scores = Counter(terms(text)), []
        for i, c in found:
            m = 25 + 75 * c.total() * n_docs // n_words
            s = sum(q * weight[t] * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        result += [(key, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:top])]
    return sorted(result, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} BIGINT, text STRING")


def words(seed, n):
    return " ".join(f"w{(seed * 7919 + i * i * 31 + i) % (3 + (seed + i) % 40)}" for i in range(n))


DOCS = [(i, words(i, 1 + i * i % 97)) for i in range(150)] + [(1000 + i, words(3, 10)) for i in range(60)]
ITEMS = [(i, words(i * 5, 4 + i)) for i in range(20)] + [(99, "nowhere found"), (98, ""), (97, None), (5, "W1 w1, W2")]


@pytest.mark.parametrize("postings,first,part", [(search.BLOCK_POSTINGS, search.FIRST_STRATA, search._PART), (30, 1, 50)])
def test_equals_brute_force(spark, monkeypatch, postings, first, part):
    monkeypatch.setattr(search, "FIRST_STRATA", first)
    monkeypatch.setattr(search, "_PART", part)
    index = search.build_index(corpus(spark, DOCS, "doc_id").repartition(5), block_postings=postings)
    assert got(search.search(index, corpus(spark, ITEMS, "item_id"))) == brute(DOCS, ITEMS)


def test_several_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(search, "ITEMS", 7)
    assert got(search.rank(corpus(spark, DOCS, "doc_id"), corpus(spark, ITEMS, "item_id"))) == brute(DOCS, ITEMS)


def test_blocks_of_the_index(spark):
    blocks = search.build_index(corpus(spark, DOCS, "doc_id"), block_postings=30).blocks.collect()
    assert len({b["m"] for b in blocks}) < len(blocks)
    postings = sum(len(set(terms(t))) for _, t in DOCS)
    assert sum(len(b["docs"]) for b in blocks) == postings and sum(len(b["doc_ids"]) for b in blocks) == len(DOCS)
    for b in blocks:
        assert len(b["terms"]) == len(b["n_docs"]) == len(b["max_tf"]) == len(b["groups"])
        assert sum(b["groups"]) == len(b["tfs"]) == len(b["counts"]) and sum(b["counts"]) == len(b["docs"])


def test_awkward_rows(spark):
    docs = awkward(spark).drop("n_chars")
    items = corpus(spark, [(1, "the cat the WORD"), (1, "word"), (None, "ÉTÉ été 1234"), (3, " \t"), (4, None)], "item_id")
    items = items.withColumns({c: F.lit(1) for c in (*EXTRA, "ordinal", "number", "terms")})
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(search.rank(docs, items)) == brute(plain, [(r["item_id"], r["text"]) for r in items.collect()])
    assert got(search.rank(docs.limit(0), items)) == [] == got(search.rank(docs, items.limit(0)))
