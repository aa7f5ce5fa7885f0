import re
from collections import Counter
from math import log

import pytest
import xxhash
from llm_tables import awkward, docs_of

from kerbside.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {k for i, w in enumerate(windows) if count[w] > 1 for k in range(i, i + 8)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered), failed)


def grams(text):
    """Buckets by plain Python; texts here have cased letters, digits and other signs only."""
    shapes = text or ""
    for kind, sign in ((lambda c: c.isupper(), "A"), (lambda c: c.islower(), "a"), (lambda c: c.isnumeric(), "0")):
        shapes = "".join(sign if kind(c) else c for c in shapes)
        shapes = re.sub(f"{sign}+", sign, shapes) if sign != "0" else re.sub("0+", "0", shapes)
    shapes, words = WORD.findall(shapes), WORD.findall(text or "")

    def hashed(*parts):
        seed = 42
        for part in parts:
            seed = xxhash.xxh64_intdigest(part.encode(), seed)
        return (seed - (1 << 64) if seed >> 63 else seed) % quality.BUCKETS
    return [hashed(w) for w in words] + [hashed(a, b) for a, b in zip(shapes, shapes[1:])]


def ratios(texts, trusted):
    n, good = Counter(), Counter()
    for i, t in texts:
        n.update(grams(t))
        if i in trusted:
            good.update(grams(t))
    scale = good.total() / n.total()
    model = {b: log((good[b] + quality.PSEUDO_COUNT) / (c * scale + quality.PSEUDO_COUNT)) if scale else 0.0 for b, c in n.items()}
    found = {}
    for i, t in texts:
        g = grams(t)
        found[i] = sum(model[b] for b in g) / len(g) if g else 0.0
    return found


CLEAN = "The quick brown fox number {} went home and then some more of the day was spent on a plain walk by the river {}."
TEXTS = [CLEAN.format(i, 7 * i) for i in range(60)]
TEXTS += ["### BUY *** now $$$ cheap &&& " + " ".join(f"a{i}%%% b{j}###" for j in range(12)) for i in range(12)]
TEXTS += ["same words " * 30, "short", "one\ntwo\none\n\n \none", "x " * 8, "a b c d e f g h " * 2 + "end"]


def test_equals_brute_force(spark):
    docs = docs_of(spark, TEXTS).repartition(3)
    trusted = set(range(30))
    expected = ratios(list(enumerate(TEXTS)), trusted)
    ids = spark.createDataFrame([(i,) for i in [*trusted, 3, None, 10**6]], "doc_id BIGINT")
    for r in quality.judge(docs, ids).collect():
        text = TEXTS[r["doc_id"]]
        failed = base(text)[-1]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(text)
        assert r["ratio"] == pytest.approx(expected[r["doc_id"]], abs=1e-12)
        assert r["kept"] == (not failed and r["ratio"] >= quality.MIN_RATIO)
        assert r["kept"] == (r["doc_id"] < 60)


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = quality.judge(docs, docs.select("doc_id")).collect()
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(((r["doc_id"], *r[1:7]) for r in got), key=repr) == sorted(((i, *base(t)) for i, t in plain), key=repr)
    assert quality.judge(docs.limit(0), docs.select("doc_id")).count() == 0
    nobody = quality.judge(docs_of(spark, TEXTS), docs.select("doc_id").limit(0)).collect()
    assert all(r["ratio"] == 0 and r["kept"] != r["base_failed"] for r in nobody)


def test_long_text_with_repeats(spark):
    text = " ".join(f"w{i % 5000}" for i in range(200_000))
    row = quality.judge(docs_of(spark, [text, text.upper()]), docs_of(spark, []).select("doc_id")).collect()
    assert [r["n_repeat_words"] for r in row] == [200_000, 200_000]


def test_trusted_bound_is_deterministic(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRUSTED_DOCS", 5)
    docs = docs_of(spark, TEXTS)
    runs = [sorted(map(tuple, quality.judge(docs.repartition(k), docs.repartition(k).select("doc_id")).collect())) for k in (1, 4)]
    assert runs[0] == runs[1]


def test_no_python_on_the_way(spark):
    docs = docs_of(spark, TEXTS)
    plan = quality.judge(docs, docs.select("doc_id"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|MapInPandas", plan)
