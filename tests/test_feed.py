import json

from pyspark.sql import functions as F

from kerbside.operators import risk as K
from kerbside.operators import traffic as R
from kerbside.operators.spatial import cities
from kerbside.sources import feed as N
from kerbside.streaming import incidents as W


def line(lat, lon, **properties):
    return {"geometry": {"type": "LineString", "coordinates": [[lon, lat], [lon, lat + 1]]}, "properties": properties}


LONDON = (51.5074, -0.1278)
DOCUMENTS = [
    {"incidents": [
        line(*LONDON, iconCategory=1, magnitudeOfDelay=4, events=[{"description": "Crash", "code": 1}], delay=125, roadNumbers=["A1"]),
        line(*LONDON, iconCategory=12, magnitudeOfDelay=None, events=[]),
        line(*LONDON, iconCategory=6, magnitudeOfDelay=3, events=[{"code": 2}]),
        {"geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"iconCategory": 8}},
        {"geometry": {"type": "LineString", "coordinates": [5.5, 6.5]}},
    ]},
    {"incidents": []},
    {},
]


def documents(spark):
    rows = [(i, json.dumps(d)) for i, d in enumerate(DOCUMENTS)] + [(9, '{"incidents": [{"geom')]
    return spark.createDataFrame(rows, "poll_id INT, payload STRING").withColumn(
        "polled_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("poll_id") * 60))


def test_incident_cases(spark):
    rows = N.parse_incidents(documents(spark)).orderBy("position").collect()
    assert [r["type"] for r in rows] == ["Accident", "Unknown", "Jam", "Road Closed", "Unknown"]
    assert [r["severity"] for r in rows] == ["Critical", "Low", "Major", "Low", "Low"]
    assert [r["description"] for r in rows] == [
        "Crash", "Traffic incident", "Unknown incident", "Traffic incident", "Traffic incident"]
    assert [(r["latitude"], r["longitude"]) for r in rows] == [LONDON] * 3 + [(0, 0), (6.5, 5.5)]
    assert rows[0]["road_numbers"] == ["A1"] and rows[1]["road_numbers"] == [] and rows[4]["delay_seconds"] == 0


def test_flow_cases(spark):
    rows = [
        (1, '{"flowSegmentData": {"currentSpeed": 20, "freeFlowSpeed": 60, "confidence": 0.9, "roadClosure": true}}'),
        (2, '{"flowSegmentData": {"currentSpeed": 20, "freeFlowSpeed": 0}}'), (3, "{}"), (4, "{oops"),
    ]
    got = N.parse_flow(spark.createDataFrame(rows, "id INT, payload STRING")).orderBy("id").collect()
    assert [r["id"] for r in got] == [1, 2, 3]
    assert [r["congestion_percent"] for r in got] == [66.7, 0, 0]
    assert got[0]["road_closure"] and not got[1]["road_closure"]


def test_city_summary(spark):
    incidents = N.parse_incidents(documents(spark))
    rows = {r["city"]: r for r in R.city_summary(incidents, cities(spark)).collect()}
    assert len(rows) == 20
    london = rows["London"]
    assert (london["total_incidents"], london["accidents"], london["jams"], london["critical_incidents"]) == (3, 1, 1, 1)
    assert (london["congestion_percent"], london["risk_level"], london["risk_color"]) == (36, "Moderate", "#ffcc00")
    assert rows["Paris"]["total_incidents"] == 0
    flow = spark.createDataFrame([("London", 1, 10.0, 50.0, 80.0), ("London", 0, 1.0, 1.0, 0.0)],
                                 "city STRING, at INT, current_speed DOUBLE, free_flow_speed DOUBLE, congestion_percent DOUBLE")
    summary = R.city_summary(incidents, cities(spark), R.latest_flow(flow, "at"))
    assert summary.where("city = 'London'").first()["congestion_percent"] == 80
    outlook = spark.createDataFrame([(-3.9,)], "change DOUBLE")
    gauges = {r["city"]: r for r in K.gauge_percentages(summary, outlook).collect()}
    assert (gauges["London"]["congestion_gauge"], gauges["London"]["forecast_gauge"]) == (80, 43)
    assert (gauges["Paris"]["speed_gauge"], gauges["Paris"]["free_flow_speed"]) == (45, 65)


def test_as_accidents(spark):
    now = F.lit("2024-03-02 19:07:00").cast("timestamp")
    rows = R.incidents_to_accidents(N.parse_incidents(documents(spark)), now).orderBy("position").collect()
    assert [r["severity"] for r in rows] == ["Fatal", "Minor", "Serious", "Minor", "Minor"]
    assert [r["num_casualties"] for r in rows] == [2, 0, 1, 0, 0]
    assert (rows[0]["time"], rows[0]["light_conditions"], str(rows[0]["date"])) == ("19:07", "Dark - lights lit", "2024-03-02")


def test_streams_equal_batch(spark, tmp_path):
    path = str(tmp_path / "landed")
    table = documents(spark)
    table.write.parquet(path)
    stream = spark.readStream.schema(table.schema).parquet(path)
    batch = N.parse_incidents(table)
    live = W.run_available(W.normalise(stream), "t", str(tmp_path / "out"))
    assert sorted(map(str, live.collect())) == sorted(map(str, batch.select(live.columns).collect()))
    # a second run finds nothing new and adds nothing
    assert W.run_available(W.normalise(stream), "t", str(tmp_path / "out")).count() == batch.count()


def test_text_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(d) for d in DOCUMENTS))
    assert N.parse_incidents(N.read_payloads(spark, str(tmp_path / "in"))).count() == 5
    live = W.run_available(W.normalise(N.stream_payloads(spark, str(tmp_path / "in"))), "t", str(tmp_path / "out"))
    assert live.count() == 5


def test_repeats_across_polls(spark, tmp_path):
    path = str(tmp_path / "landed")
    polls = spark.range(40).select(
        F.lit(json.dumps(DOCUMENTS[0])).alias("payload"), F.col("id").alias("poll_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 30).alias("polled_at"))
    polls.write.parquet(path)
    stream = spark.readStream.schema(polls.schema).parquet(path)
    kept = W.run_available(W.suppress_repeats(W.normalise(stream)), "t", str(tmp_path / "out"))
    assert kept.count() == 5


def test_live_summary_keeps_open_incidents_and_flow_between_polls(spark):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1, 12)
    place = {"a": (51.5, -0.12), "b": (51.52, -0.13)}
    seen = [("a", 1, "Minor"), ("b", 1, "Critical"), ("a", 7, "Major"), ("a", 7, "Minor"), ("b", 31, "Critical"), ("a", 70, "Low")]
    incidents = spark.createDataFrame(
        [("Jam", s, k, *place[k], "", start + timedelta(minutes=m)) for k, m, s in seen],
        "type STRING, severity STRING, description STRING, latitude DOUBLE, longitude DOUBLE, start_time STRING, polled_at TIMESTAMP")
    speeds = [(2, 50.0, 100.0, 50.0), (9, 20.0, 100.0, 80.0)]
    flow = spark.createDataFrame(
        [("X", start + timedelta(minutes=m), *v) for m, *v in speeds],
        "city STRING, polled_at TIMESTAMP, current_speed DOUBLE, free_flow_speed DOUBLE, congestion_percent DOUBLE")
    cities = spark.createDataFrame([("X", 51.5, -0.12), ("Y", 0.0, 50.0)], "city STRING, city_lat DOUBLE, city_lon DOUBLE")
    got = {
        (r["as_of"], r["city"]): (r["total_incidents"], r["major_incidents"], r["critical_incidents"], r["congestion_percent"], r["current_speed"])
        for r in W.live_summary(incidents, flow, cities).collect()}
    want = {}
    for end in range(5, 120, 5):
        last = {}
        for k, m, s in sorted(seen, key=lambda x: (x[1], x[2])):
            if end - 30 <= m < end:
                last[k] = s
        reading = max([v for v in speeds if end - 30 <= v[0] < end], default=None)
        major, critical = (sum(v == s for v in last.values()) for s in ("Major", "Critical"))
        if last or reading:
            percent = reading[3] if reading else float(critical * 20 + major * 10 + len(last) * 2)
            want[start + timedelta(minutes=end), "X"] = (len(last), major, critical, percent, reading and reading[1])
    assert got == want


def test_plain_lines_start_where_the_json_parser_says(spark):
    plain = ["[[1.5,51.25],[1.6,51.5]]", "[[-0.1278,51.507400000000004]]", "[[0.1,-0.25,7.0],[2.5,3.5]]", "[[13.235,52.358000000000004]]"]
    others = [
        "[[1,2],[3,4]]", "[1.5,51.25]", "[[1.5]]", "[[01.5,2.5]]", "[[1.5,2.5],3.5]", "[[1.5,2.5]", "[[1.5,2.5]]\n", "[ [1.5, 2.5] ]",
        "[[1.5e1,2.5]]", "[[-0,0]]", "[[1.5,\"2.5\"]]", "[[[1.5,2.5]]]", "[[null,2.5]]", "[]", "[[]]", "", "x", "[[.5,1.5]]", "[[1.,2.5]]", "[[+1.5,2.5]]",
        "[[1.5,2.5],[x]]", "[[1.5,2.5],[]]", "[[1.5,2.5]][[3.5,4.5]]", "[[1.5,2.5],[true,1.5]]", "[[1." + "5" * 2000 + ",2.5]]"]
    long = "[" + ",".join(f"[{i}.5,{i}.25]" for i in range(20000)) + "]"
    texts = spark.createDataFrame([(t,) for t in [*plain, *others, long, None]], "coordinates STRING")
    rows = texts.select(
        "coordinates", N._start_of_line(F.struct(F.lit("LineString").alias("type"), "coordinates")).alias("got"),
        F.coalesce(F.get(F.from_json("coordinates", "array<array<double>>"), F.lit(0)), F.from_json("coordinates", "array<double>")).alias("want"),
        F.col("coordinates").rlike(N._PLAIN_POINTS).alias("plain")).collect()
    # whoever reads them, the first two numbers are the ones of the parser
    assert [(r["got"] or [])[:2] for r in rows] == [(r["want"] or [])[:2] for r in rows]
    assert {r["coordinates"] for r in rows if r["plain"]} == {*plain, long}


def test_last_report_is_aggregated_by_hashing(spark):
    """Sorting every report six times over was most of the work of the grouping."""
    incidents = N.parse_incidents(documents(spark))
    flow = spark.createDataFrame([], "city STRING, polled_at TIMESTAMP, current_speed DOUBLE, free_flow_speed DOUBLE, congestion_percent DOUBLE")
    plan = W.live_summary(incidents, flow, cities(spark))._jdf.queryExecution().executedPlan().toString()
    sorted_by = [line for line in plan.splitlines() if "SortAggregate" in line]
    assert "HashAggregate" in plan and not [line for line in sorted_by if "incident" in line]


def test_live_summary_ties_take_the_last_severity_and_type_in_text_order(spark):
    from datetime import datetime

    at = datetime(2024, 1, 1, 12, 1)
    texts = [None, "", "Aa", "Critical", "Lower", "Low", "Major", "Minor", "Moderate", "zz"]
    kinds = [None, "A", "Accident", "Jam", "Lane Closed", "Road Closed", "Road Works", "Zebra"]
    cities = spark.createDataFrame([("X", 51.5, -0.12)], "city STRING, city_lat DOUBLE, city_lon DOUBLE")
    none = spark.createDataFrame([], "city STRING, polled_at TIMESTAMP, current_speed DOUBLE, free_flow_speed DOUBLE, congestion_percent DOUBLE")
    rows = [(f"{i},{j}", s, k, 51.5, -0.12, at) for i in range(len(texts)) for j in range(len(kinds))
            for s, k in ((texts[i], kinds[j]), (texts[i - 1], kinds[j]), (texts[i], kinds[j - 3]))]
    incidents = spark.createDataFrame(rows, "name STRING, severity STRING, type STRING, latitude DOUBLE, longitude DOUBLE, polled_at TIMESTAMP")
    last = {}
    for name, s, k, *_ in rows:
        order = lambda t: (t is not None, t or "")
        last[name] = max(last.get(name, (None, None)), (s, k), key=lambda x: (order(x[0]), order(x[1])))
    want = (len(last), sum(k == "Accident" for _, k in last.values()), sum(k == "Jam" for _, k in last.values()),
            sum(k == "Road Works" for _, k in last.values()), sum(k in ("Road Closed", "Lane Closed") for _, k in last.values()),
            sum(s == "Critical" for s, _ in last.values()), sum(s == "Major" for s, _ in last.values()))
    got = W.live_summary(incidents, none, cities, key=["name"]).select(
        "total_incidents", "accidents", "jams", "road_works", "closures", "critical_incidents", "major_incidents").distinct().collect()
    assert [tuple(r) for r in got] == [want]
