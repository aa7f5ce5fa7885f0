import random

from conftest import TESTDATA
from llm_tables import awkward, rows
from pyspark.sql import functions as F

from kerbside.llm import langid
from kerbside.llm.common import documents


def test_held_out_accuracy(spark):
    docs = documents(spark, TESTDATA.replace("0.001", "0.01"))
    got = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(got) == docs.count() and 100 < len(held) < 300
    assert (held["lang_pred"] == held["lang"]).mean() >= 0.97
    assert got["score"].between(0, 1).all()


def test_only_the_text_counts(spark):
    docs = documents(spark, TESTDATA)
    plain = rows(langid.report(docs).where("held_out"))
    shuffled = docs.withColumns({
        "source": F.lit("x"), "lang": F.when(~langid.held_out(), F.col("lang")).otherwise(F.lit("zz"))})
    assert rows(langid.report(shuffled).where("held_out")) == plain


def test_filter_names_every_language_of_a_gram(spark):
    draw = random.Random(1)
    alphabets = {f"l{k:02d}": "abcdefghijklmnopqrstuvwxyz"[k % 20:k % 20 + 5] for k in range(70)}  # more than one slice
    table = [
        (i, " ".join("".join(draw.choice(letters) for _ in range(5)) for _ in range(60)), lang)
        for i, (lang, letters) in enumerate(list(alphabets.items()) * 4)
    ]
    model = langid.fit(spark.createDataFrame(table, "doc_id BIGINT, text STRING, lang STRING"))
    assert model.languages == sorted(alphabets) and len(model.slices) == 2
    for _, text, lang in table[:70]:
        rates = langid._rates(model, langid._grams(text))
        twins = [k for k, v in alphabets.items() if v == alphabets[lang]]
        assert model.languages[int(rates.argmax())] in twins


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = langid.report(docs)
    assert got.count() == docs.count()
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.collect()}
    assert all(found[k] == ("und", 0.0) for k in (2, 3, 4, 7))
    assert found[6][0] in ("en", "fr", "de") and found[None][0] == "en"
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} <= {1, None, 5, 6}
    assert langid.report(docs.limit(0)).count() == 0
    nothing = langid.report(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_nothing_learned_keeps_everything(spark):
    docs = spark.createDataFrame([(i, f"some plain text {i}", None) for i in range(20)], "doc_id BIGINT, text STRING, lang STRING")
    assert langid.keep_identified(docs).count() == 20


def test_any_number_of_labels(spark):
    table = [(i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{w}xq" for w in ("ab", "cd", "ef", "gh")), f"l{k:03}")
             for i, k in enumerate(k for k in range(600) for _ in range(4))]
    docs = spark.createDataFrame(table, "doc_id BIGINT, text STRING, lang STRING")
    assert len(langid.fit(docs).languages) == 600
