from pyspark.sql import functions as F

from kerbside.operators import classify as C
from kerbside.operators.encoding import apply_codes, first_seen_codes, grow_codes


def test_codes_given_once_never_change(spark):
    rows = [(1, "b", "x"), (2, "a", None), (3, "b", "y"), (4, "c", "x"), (5, "a", "z"), (6, None, "w"), (7, "d", "z")]
    df = spark.createDataFrame(rows, "id INT, p STRING, q STRING")
    codes, taken = first_seen_codes(df.where("id <= 2"), "id", ["p", "q"]), {}
    for upto in (2, 4, 4, 7):
        codes = grow_codes(codes, df.where(f"id <= {upto}").withColumn("r", F.lit(1)), "id")
        now = {(r["column"], r["value"]): r["code"] for r in codes.collect()}
        assert taken.items() <= now.items()
        taken = now
    assert taken == {("p", "b"): 0, ("p", "a"): 1, ("p", "c"): 2, ("p", None): 3, ("p", "d"): 4,
                     ("q", "x"): 0, ("q", None): 1, ("q", "y"): 2, ("q", "z"): 3, ("q", "w"): 4}
    assert codes.count() == len(taken) == grow_codes(codes, df.limit(0), "id").count()


def test_scores_of_old_rows_stay(spark, accidents, monkeypatch):
    monkeypatch.setattr(C.fit_boosted, "__defaults__", (5,))
    old = accidents.where("weather IN ('Clear', 'Rain')")
    trained = C.train_severity(old, "row_id")
    grown = trained._replace(encodings=grow_codes(trained.encodings, accidents, "row_id"))
    scored = [sorted(map(tuple, C.predict(old, m).select("row_id", "predicted_severity", "probabilities").collect())) for m in (trained, grown)]
    assert scored[0] == scored[1]
    coded = apply_codes(accidents, grown.encodings)
    assert coded.where("weather_encoded IS NULL").count() == 0
    assert coded.select("weather", "weather_encoded").distinct().count() == accidents.select("weather").distinct().count()
