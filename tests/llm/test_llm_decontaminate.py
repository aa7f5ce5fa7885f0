import random
import re

from llm_tables import awkward, docs_of, rows
from pyspark.sql import functions as F

from kerbside.llm import decontaminate

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return _WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(texts, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i:i + n]), set()).add(str(item) if item is not None else "")
    out = []
    for doc, text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                names = windows.get(tuple(w[i:i + n]))
                if names:
                    hit |= set(range(i, i + n))
                    found |= names
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def case(spark):
    draw = random.Random(3)
    word = lambda: draw.choice(["a", "b", "ab", "Él", "x1"])
    items = [(i, " ".join(word() for _ in range(draw.choice([0, 1, 4, 9, 10, 11, 30])))) for i in range(25)]
    items += [(3, items[3][1]), (None, "lone marker phrase of six words"), (77, None)]
    texts = [" ".join(word() for _ in range(draw.randint(0, 60))) for _ in range(40)]
    texts += ["before " + items[k][1].upper().replace(" ", ", ") + " after" for k in range(25)]
    texts += ["A lone marker-phrase of six words!", None, ""]
    return texts, items


def test_equals_brute_force(spark):
    texts, items = case(spark)
    docs = docs_of(spark, texts)
    benchmark = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    for block in (decontaminate.BLOCK_WORDS, 40):  # one block and many
        got = decontaminate.scan(docs, benchmark, ["doc_id"], block_words=block).collect()
        assert sorted((r[0], r["n_words"], r["n_hit"], r["items"]) for r in got) == sorted(brute(enumerate(texts), items))
    clean = {d for d, _, n, _ in brute(enumerate(texts), items) if not n}
    kept = decontaminate.decontaminate(docs, benchmark)
    assert {r["doc_id"] for r in kept.collect()} == clean and kept.columns == docs.columns


def test_long_items_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "_PIECE_WORDS", 7)
    item = " ".join(f"w{i}" for i in range(40))
    texts = [" ".join(f"w{i}" for i in range(a, a + 12)) for a in range(30)]
    benchmark = spark.createDataFrame([(1, item)], "item_id BIGINT, text STRING")
    got = decontaminate.report(docs_of(spark, texts), benchmark)
    assert [r["n_hit"] for r in got.orderBy("doc_id").collect()] == [min(12, 40 - a) if 40 - a >= 10 else 0 for a in range(30)]


def test_awkward_rows(spark):
    docs = awkward(spark)
    benchmark = spark.createDataFrame([(1, "zzz yyy"), (1, "word")], "item_id BIGINT, text STRING").withColumn("n", F.lit(1))
    got = decontaminate.report(docs, benchmark)
    assert got.count() == docs.count() and got.where("contaminated").select("doc_id", "n_hit").collect() == [(5, 30_000)]
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and rows(kept) == rows(docs.where("doc_id IS NULL OR doc_id <> 5"))
    assert decontaminate.report(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(docs.limit(0), benchmark).count() == 0
