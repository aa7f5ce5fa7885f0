"""Registered queries on the traffic feed, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside.catalogue.adapters import EPOCH, accidents, flow_documents, incident_documents, with_feed
from kerbside.catalogue.batch import derived, q6, r6
from kerbside.operators import risk as K
from kerbside.operators import traffic as R
from kerbside.operators.spatial import cities
from kerbside.session import materialise, scratch_path
from kerbside.sources import feed as N
from kerbside.streaming import incidents as W

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function
    return register


def parsed(spark, sf):
    return N.parse_incidents(incident_documents(spark, sf))


FLAT = ["poll_id", "position", "type", "severity", "description", "delay_seconds", "from_location", "to_location", "start_time"]
FLAT_SQL = f"""SELECT {', '.join(FLAT)}, {q6('latitude')} AS latitude, {q6('longitude')} AS longitude, {q6('length_meters')} AS length_meters, roads FROM incidents"""


def _flat(rows):
    return rows.select(
        *FLAT, r6("latitude").alias("latitude"), r6("longitude").alias("longitude"),
        r6("length_meters").alias("length_meters"), F.array_join("road_numbers", ",").alias("roads"))


@query("feed_flatten", with_feed(FLAT_SQL))
def feed_flatten(spark, sf):
    return _flat(parsed(spark, sf))


FLOW = """WITH docs AS (SELECT event_id, cast((event_id * 13) % 70 AS double) AS cur,
 CASE WHEN event_id % 10 = 0 THEN 0 WHEN event_id % 31 <> 0 THEN event_id % 31 + 40 ELSE 0 END AS free,
 CASE WHEN event_id % 3 <> 0 THEN 0.5 ELSE 0 END AS confidence, event_id % 17 = 0 AS road_closure, event_id % 20 AS city_no FROM events WHERE event_id % 29 <> 0),
flow AS (SELECT *, CASE WHEN free > 0 THEN round_even(greatest(0, (1 - cur / free) * 100) * 10, 0) / 10 ELSE 0 END AS congestion_percent FROM docs)"""


@query("congestion", FLOW + """ SELECT event_id AS reading, cur AS current_speed, cast(free AS double) AS free_flow_speed, congestion_percent, cast(confidence AS double) AS confidence, road_closure,
 CASE WHEN congestion_percent >= 70 THEN 'Critical' WHEN congestion_percent >= 50 THEN 'High' WHEN congestion_percent >= 30 THEN 'Moderate' ELSE 'Low' END AS risk_level FROM flow""")
def congestion(spark, sf):
    from kerbside.functions.scalars import congestion_level
    return N.parse_flow(flow_documents(spark, sf)).drop("city").withColumn(
        "risk_level", congestion_level(F.col("congestion_percent")))


PLACED = """, placed AS (SELECT i.*, c.city, c.city_no FROM incidents i JOIN cities c
 ON i.latitude BETWEEN c.city_lat - 10.0 / 111 AND c.city_lat + 10.0 / 111 AND i.longitude BETWEEN c.city_lon - 10.0 / 111 AND c.city_lon + 10.0 / 111),
counts AS (SELECT city, count(*) AS total_incidents, count(*) FILTER (type = 'Accident') AS accidents, count(*) FILTER (type = 'Jam') AS jams,
 count(*) FILTER (type = 'Road Works') AS road_works, count(*) FILTER (type IN ('Road Closed', 'Lane Closed')) AS closures,
 count(*) FILTER (severity = 'Critical') AS critical_incidents, count(*) FILTER (severity = 'Major') AS major_incidents FROM placed GROUP BY city)"""
COUNTED = "total_incidents accidents jams road_works closures critical_incidents major_incidents".split()
BANDS = "CASE WHEN p >= 70 THEN 'Critical' WHEN p >= 50 THEN 'High' WHEN p >= 30 THEN 'Moderate' ELSE 'Low' END AS risk_level"
COLOURS = "CASE WHEN p >= 70 THEN '#ff0040' WHEN p >= 50 THEN '#ff6600' WHEN p >= 30 THEN '#ffcc00' ELSE '#00ff88' END AS risk_color"


@query("city_feed_summary", with_feed(PLACED + f""" SELECT *, {BANDS}, {COLOURS} FROM (SELECT c.city, {', '.join(f'coalesce({k}, 0) AS {k}' for k in COUNTED)},
 cast(least(100, coalesce(critical_incidents, 0) * 20 + coalesce(major_incidents, 0) * 10 + coalesce(total_incidents, 0) * 2) AS double) AS p FROM cities c LEFT JOIN counts n ON c.city = n.city)"""))
def city_feed_summary(spark, sf):
    summary = R.city_summary(parsed(spark, sf), cities(spark))
    return summary.select("city", *COUNTED, F.col("congestion_percent").alias("p"), "risk_level", "risk_color")


LAST_FLOW = """, last AS (SELECT city_no, arg_max(cur, event_id) AS cur, arg_max(free, event_id) AS free FROM (
 SELECT event_id % 20 AS city_no, event_id, cast((event_id * 13) % 70 AS double) AS cur,
 CASE WHEN event_id % 10 = 0 THEN 0 WHEN event_id % 31 <> 0 THEN event_id % 31 + 40 ELSE 0 END AS free FROM events WHERE event_id % 29 <> 0) GROUP BY city_no),
live AS (SELECT c.city, cur, free, CASE WHEN free > 0 THEN round_even(greatest(0, (1 - cur / free) * 100) * 10, 0) / 10 ELSE 0 END AS p FROM last JOIN cities c USING (city_no))"""


@query("city_flow_summary", with_feed(PLACED + LAST_FLOW + f""" SELECT c.city, cast(p AS double) AS congestion_percent, {BANDS}, coalesce(total_incidents, 0) AS total_incidents, cast(cur AS double) AS current_speed, cast(free AS double) AS free_flow_speed
 FROM cities c LEFT JOIN counts n ON c.city = n.city LEFT JOIN live l ON c.city = l.city"""))
def city_flow_summary(spark, sf):
    flow = R.latest_flow(N.parse_flow(flow_documents(spark, sf)), "reading")
    return R.city_summary(parsed(spark, sf), cities(spark), flow).select(
        "city", "congestion_percent", "risk_level", "total_incidents", "current_speed", "free_flow_speed")


@query("dashboard_gauges", with_feed(PLACED + LAST_FLOW + f""", a AS (SELECT event_type, hour(ts) AS hour, isodow(cast(ts AS date)) - 1 AS day_of_week FROM events),
outlook AS (SELECT round_even(greatest(least(5.0 * count(*) FILTER (event_type = 'purchase') / count(*) + 8.0 * count(*) FILTER (event_type = 'signup') / count(*)
 + 4.0 * count(*) FILTER (hour >= 22 OR hour <= 5) / count(*) + 3.0 * count(*) FILTER (day_of_week >= 5) / count(*), 15), -10) * 10, 0) / 10 AS change FROM a)
SELECT c.city, cast(trunc(least(100, p)) AS int) AS congestion_gauge, cast(least(100, coalesce(total_incidents, 0) * 5) AS int) AS incident_gauge,
 cast(least(100, coalesce(accidents, 0) * 15) AS int) AS accident_gauge, cast(trunc(least(100, cur)) AS int) AS speed_gauge, cast(free AS double) AS free_flow_speed,
 cast(greatest(0, least(100, 50 + trunc(change * 2))) AS int) AS forecast_gauge, coalesce(critical_incidents, 0) + coalesce(major_incidents, 0) AS high_risk_zones
 FROM cities c LEFT JOIN counts n ON c.city = n.city JOIN live l ON c.city = l.city, outlook"""))
def dashboard_gauges(spark, sf):
    flow = R.latest_flow(N.parse_flow(flow_documents(spark, sf)), "reading")
    summary = R.city_summary(parsed(spark, sf), cities(spark), flow)
    return K.gauge_percentages(summary, K.risk_change_24h(derived(spark, sf)))


@query("first_incidents", with_feed(PLACED + """ SELECT city, poll_id, position, rank, upper(type) AS title, substr(description, 1, 60) AS text, severity, cast(delay_seconds // 60 AS int) AS delay_minutes
 FROM (SELECT *, cast(row_number() OVER (PARTITION BY city ORDER BY poll_id, position) AS int) AS rank FROM placed) WHERE rank <= 20"""))
def first_incidents(spark, sf):
    top = R.first_incidents(parsed(spark, sf), cities(spark), ["poll_id", "position"], 20)
    return R.incident_cards(top).select(
        "city", "poll_id", "position", "rank", "title", "text", "severity", "delay_minutes")


@query("incidents_to_accidents", with_feed(""" SELECT poll_id, position, sev AS severity, CASE sev WHEN 'Fatal' THEN 2 WHEN 'Serious' THEN 1 ELSE 0 END AS num_casualties,
 1 AS num_vehicles, 50 AS speed_limit, 'Clear' AS weather, 'Urban' AS road_type, 'Dry' AS road_surface, 'Not at junction' AS junction_type,
 CASE WHEN (poll_second // 3600) % 24 BETWEEN 6 AND 18 THEN 'Daylight' ELSE 'Dark - lights lit' END AS light_conditions,
 lpad(cast((poll_second // 3600) % 24 AS varchar), 2, '0') || ':' || lpad(cast((poll_second // 60) % 60 AS varchar), 2, '0') AS time
 FROM (SELECT *, CASE severity WHEN 'Critical' THEN 'Fatal' WHEN 'Major' THEN 'Serious' WHEN 'Moderate' THEN 'Serious' ELSE 'Minor' END AS sev FROM incidents)"""))
def incidents_to_accidents(spark, sf):
    seconds = F.unix_seconds("polled_at")  # UTC wall clock, whatever the session's zone
    clock = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    return R.incidents_to_accidents(parsed(spark, sf), clock).select(
        "poll_id", "position", "severity", "num_casualties", "num_vehicles", "speed_limit", "weather", "road_type",
        "road_surface", "junction_type", "light_conditions", "time")


@query("feed_selection", with_feed(f"""SELECT poll_id, position, type, {q6('latitude')} AS latitude, {q6('longitude')} AS longitude
 FROM incidents WHERE type IN ('Jam', 'Accident') AND longitude BETWEEN -2.5 AND 0.5 AND latitude BETWEEN 51 AND 54"""))
def feed_selection(spark, sf):
    """Documents read as text, as the collector leaves them."""
    path = scratch_path(spark, "feed-text")
    incident_documents(spark, sf).select(F.to_json(F.struct("poll_id", "payload")).alias("value")).write.text(path)
    lines = N.read_payloads(spark, path).select(F.from_json("payload", "poll_id BIGINT, payload STRING").alias("d"))
    found = N.select_incidents(N.parse_incidents(lines.select("d.*")), ["Jam", "Accident"], (-2.5, 51.0, 0.5, 54.0))
    return found.select("poll_id", "position", "type", r6("latitude").alias("latitude"), r6("longitude").alias("longitude"))


@query("feed_rejects", with_feed(" SELECT DISTINCT poll_id FROM feed WHERE poll_id % 50 = 49"))
def feed_rejects(spark, sf):
    return N.malformed(incident_documents(spark, sf)).select("poll_id")


# ---- streaming -----------------------------------------------------------------------

def _landed(spark, documents, label, per_file=0):
    """Documents as a landing folder of the collector, read back as a stream.

    ``per_file`` (0: any number) keeps files small enough to be dealt evenly to the tasks that parse them.
    """
    path = scratch_path(spark, label)
    documents.write.option("maxRecordsPerFile", per_file).parquet(path)
    return spark.readStream.schema(documents.schema).parquet(path)


@query("stream_normalise", with_feed(FLAT_SQL))
def stream_normalise(spark, sf):
    landed = _landed(spark, incident_documents(spark, sf), "landed")
    return W.run_available(_flat(W.normalise(landed)), "normalised")


@query("stream_city_windows", with_feed(PLACED + f""" SELECT window_second, city, {', '.join(COUNTED)}, congestion_percent,
 CASE WHEN congestion_percent >= 70 THEN 'Critical' WHEN congestion_percent >= 50 THEN 'High' WHEN congestion_percent >= 30 THEN 'Moderate' ELSE 'Low' END AS risk_level FROM (
 SELECT poll_second // 900 * 900 AS window_second, city, count(*) AS total_incidents, count(*) FILTER (type = 'Accident') AS accidents, count(*) FILTER (type = 'Jam') AS jams,
 count(*) FILTER (type = 'Road Works') AS road_works, count(*) FILTER (type IN ('Road Closed', 'Lane Closed')) AS closures,
 count(*) FILTER (severity = 'Critical') AS critical_incidents, count(*) FILTER (severity = 'Major') AS major_incidents,
 cast(least(100, count(*) FILTER (severity = 'Critical') * 20 + count(*) FILTER (severity = 'Major') * 10 + count(*) * 2) AS double) AS congestion_percent
 FROM placed GROUP BY 1, 2)"""))
def stream_city_windows(spark, sf):
    documents = incident_documents(spark, sf)
    landed = _landed(spark, documents.unionByName(W.closing_document(documents)), "landed")
    done = W.run_available(W.rolling_summary(W.normalise(landed), cities(spark)), "windows")
    return done.select(
        F.unix_seconds("window_start").alias("window_second"), "city", *COUNTED, "congestion_percent", "risk_level")


@query("stream_repeats", with_feed(f""" SELECT DISTINCT type, {q6('latitude')} AS latitude, {q6('longitude')} AS longitude, description, start_time FROM incidents"""))
def stream_repeats(spark, sf):
    documents = incident_documents(spark, sf)
    again = documents.withColumns({
        "poll_id": F.col("poll_id") + 1_000_000_000_000, "polled_at": F.col("polled_at") + F.expr("INTERVAL 1 MINUTE"),
    })
    landed = _landed(spark, documents.unionAll(again), "landed")
    kept = W.run_available(W.suppress_repeats(W.normalise(landed)).select(*W.INCIDENT_KEY), "repeats")
    return kept.withColumns({"latitude": r6("latitude"), "longitude": r6("longitude")})


_POLLED_AGAIN = (0, 300, 1500, 5400, 5700)  # seconds; the fourth poll comes after a silence


def _polled_again(documents):
    return documents.withColumn("_after", F.explode(F.array(*[F.lit(s) for s in _POLLED_AGAIN]))).select(
        (F.col("poll_id") + F.col("_after").cast("long") * 1_000_000_000).alias("poll_id"),
        F.timestamp_seconds(F.unix_seconds("polled_at") + F.col("_after")).alias("polled_at"), "payload")


_LIVES = with_feed(f""", reports AS (SELECT type, latitude, longitude, description, start_time, poll_second + s AS seen
 FROM incidents, (VALUES {', '.join(f'({s})' for s in _POLLED_AGAIN)}) polls(s)),
marked AS (SELECT *, CASE WHEN seen - lag(seen) OVER same <= 1800 THEN 0 ELSE 1 END AS begins FROM reports
 WINDOW same AS (PARTITION BY type, latitude, longitude, description, start_time ORDER BY seen)),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY type, latitude, longitude, description, start_time ORDER BY seen ROWS UNBOUNDED PRECEDING) AS life FROM marked)
SELECT type, {q6('latitude')} AS latitude, {q6('longitude')} AS longitude, description, start_time, min(seen)::BIGINT AS first_second,
 max(seen)::BIGINT AS last_second, count(*) AS reports, (max(seen) - min(seen))::BIGINT AS seconds
FROM numbered GROUP BY type, numbered.latitude, numbered.longitude, description, start_time, life""")


def _lives(df):
    return df.select(
        "type", r6("latitude").alias("latitude"), r6("longitude").alias("longitude"), "description", "start_time",
        F.unix_seconds("first_seen").alias("first_second"), F.unix_seconds("last_seen").alias("last_second"), "reports", "seconds")


@query("incident_lives", _LIVES)
def incident_lives(spark, sf):
    return _lives(W.incident_lives(W.normalise(_polled_again(incident_documents(spark, sf)))))


@query("stream_incident_lives", _LIVES)
def stream_incident_lives(spark, sf):
    documents = _polled_again(incident_documents(spark, sf))
    landed = _landed(spark, documents.unionByName(W.closing_document(documents)), "landed-lives")
    done = W.run_available(W.incident_lives(W.normalise(landed)), "lives")
    # the closing document reports an incident of its own
    return _lives(done.where("latitude > -89"))


_LIVE = with_feed(PLACED + f""", reports AS (SELECT *, poll_second + s AS seen FROM placed, (VALUES {', '.join(f'({s})' for s in _POLLED_AGAIN)}) polls(s)),
slots AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS k),
opened AS (SELECT DISTINCT (seen // 300 + k) * 300 AS second, city, type, latitude, longitude, description, start_time, severity FROM reports, slots),
states AS (SELECT second, city, count(*) AS total_incidents, count(*) FILTER (type = 'Accident') AS accidents, count(*) FILTER (type = 'Jam') AS jams,
 count(*) FILTER (type = 'Road Works') AS road_works, count(*) FILTER (type IN ('Road Closed', 'Lane Closed')) AS closures,
 count(*) FILTER (severity = 'Critical') AS critical_incidents, count(*) FILTER (severity = 'Major') AS major_incidents FROM opened GROUP BY 1, 2),
speeds AS (SELECT ((({EPOCH} + event_id // 20 * 60) // 300) + k) * 300 AS second, event_id % 20 AS city_no, arg_max(cast((event_id * 13) % 70 AS double), event_id) AS cur,
 arg_max(cast(CASE WHEN event_id % 10 = 0 THEN 0 WHEN event_id % 31 <> 0 THEN event_id % 31 + 40 ELSE 0 END AS double), event_id) AS free
 FROM events, slots WHERE event_id % 29 <> 0 GROUP BY 1, 2),
flows AS (SELECT second, city, cur, free, CASE WHEN free > 0 THEN round_even(greatest(0, (1 - cur / free) * 100) * 10, 0) / 10 ELSE 0 END AS flow FROM speeds JOIN cities USING (city_no)),
live AS (SELECT coalesce(n.second, l.second) AS second, coalesce(n.city, l.city) AS city, {', '.join(f'coalesce({k}, 0) AS {k}' for k in COUNTED)}, cur, free,
 coalesce(flow, least(100, coalesce(critical_incidents, 0) * 20 + coalesce(major_incidents, 0) * 10 + coalesce(total_incidents, 0) * 2)) AS p
 FROM states n FULL JOIN flows l ON n.second = l.second AND n.city = l.city)
SELECT second::BIGINT AS second, city, {', '.join(COUNTED)}, cast(p AS double) AS congestion_percent, {BANDS}, {COLOURS}, cur AS current_speed, free AS free_flow_speed FROM live""")


def _live(states):
    return states.select(F.unix_seconds("as_of").alias("second"), "city", *COUNTED, "congestion_percent", "risk_level", "risk_color",
                         "current_speed", "free_flow_speed")


def _polled_flow(spark, sf):
    polled = F.timestamp_seconds(F.lit(EPOCH) + F.floor(F.col("reading") / 20) * 60)
    return flow_documents(spark, sf).withColumn("polled_at", polled)


@query("live_summary", _LIVE)
def live_summary(spark, sf):
    incidents = W.normalise(_polled_again(incident_documents(spark, sf)))
    return _live(W.live_summary(incidents, N.parse_flow(_polled_flow(spark, sf)), cities(spark)))


@query("stream_live_summary", _LIVE)
def stream_live_summary(spark, sf):
    documents, readings = _polled_again(incident_documents(spark, sf)), _polled_flow(spark, sf)
    incidents = W.normalise(_landed(spark, documents.unionByName(W.closing_document(documents)), "landed-incidents", 5000))
    flow = N.parse_flow(_landed(spark, readings.unionByName(W.closing_reading(readings)), "landed-flow"))
    return _live(W.run_available(W.live_summary(incidents, flow, cities(spark)), "live"))
