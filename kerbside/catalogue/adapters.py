"""Accident tables over the driver's ``events`` table.

The same SQL text runs in Spark and in the checking engine. Identifiers keep
all digits beyond 999 999 events, so they stay unique at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.schema import CITIES, INCIDENT_TYPES

ACCIDENTS_SQL = """
SELECT event_id AS row_id,
 concat('ACC', CASE WHEN event_id < 1000000 THEN lpad(cast(event_id AS string), 6, '0') ELSE cast(event_id AS string) END) AS accident_id,
 cast(ts AS date) AS date,
 concat(lpad(cast(hour(ts) AS string),2,'0'), ':', lpad(cast(minute(ts) AS string),2,'0')) AS time,
 cast(51.30 AS double) + (user_id % 12) * cast(0.05 AS double) + ((event_id * 7919) % 397) / cast(10000 AS double) AS latitude,
 cast(-0.50 AS double) + (user_id % 5) * cast(0.08 AS double) + ((event_id * 104729) % 599) / cast(10000 AS double) AS longitude,
 CASE event_type WHEN 'error' THEN 'Snow' WHEN 'signup' THEN 'Fog' WHEN 'purchase' THEN 'Rain' ELSE 'Clear' END AS weather,
 CASE WHEN user_id % 10 < 6 THEN 'Urban' WHEN user_id % 10 < 8 THEN 'Rural' ELSE 'Motorway' END AS road_type,
 CASE WHEN user_id % 10 < 4 THEN 30 WHEN user_id % 10 < 6 THEN 20 WHEN user_id % 10 < 7 THEN 50 WHEN user_id % 10 < 8 THEN 60 ELSE 70 END AS speed_limit,
 cast(1 + (event_id * 7 + user_id) % 5 AS int) AS num_vehicles,
 cast((event_id * 11 + user_id * 3) % 5 AS int) AS num_casualties,
 CASE WHEN hour(ts) >= 7 AND hour(ts) < 18 THEN 'Daylight' ELSE 'Dark' END AS light_conditions,
 CASE event_type WHEN 'error' THEN 'Ice' WHEN 'signup' THEN 'Wet' WHEN 'purchase' THEN 'Wet' ELSE 'Dry' END AS road_surface,
 CASE event_id % 5 WHEN 0 THEN 'Crossroads' WHEN 1 THEN 'T-junction' WHEN 2 THEN 'Roundabout' WHEN 3 THEN 'Slip road' ELSE 'Not at junction' END AS junction_type,
 CASE WHEN (event_id * 31 + user_id * 17) % 100 < 60 THEN 'Minor' WHEN (event_id * 31 + user_id * 17) % 100 < 91 THEN 'Serious' ELSE 'Fatal' END AS severity
FROM events
"""

# An upload with foreign headers, dirty words, gaps, bad latitudes, repeated rows and no identifier.
ACCIDENTS_RAW_SQL = """
SELECT row_id AS src_row,
 CASE WHEN row_id % 50 = 0 THEN cast(200.0 AS double) ELSE latitude END AS lat,
 longitude AS lng,
 CASE severity
   WHEN 'Minor' THEN CASE WHEN row_id % 3 = 0 THEN '1' WHEN row_id % 3 = 1 THEN ' Slight ' ELSE 'low' END
   WHEN 'Serious' THEN CASE WHEN row_id % 2 = 0 THEN 'Moderate' ELSE '2' END
   ELSE CASE WHEN row_id % 4 = 0 THEN 'weird' ELSE 'KILLED' END END AS accident_severity,
 CASE WHEN row_id % 23 = 0 THEN cast(NULL AS string) WHEN weather = 'Clear' THEN 'Fine' WHEN weather = 'Rain' THEN 'raining' WHEN weather = 'Fog' THEN 'Mist' ELSE 'high-winds gust' END AS weather_condition,
 CASE road_type WHEN 'Urban' THEN 'City' WHEN 'Rural' THEN 'village' ELSE 'National Highway' END AS road_type,
 road_surface AS road_condition, light_conditions AS lighting, junction_type AS junction,
 CASE WHEN row_id % 17 = 0 THEN cast(NULL AS int) ELSE num_vehicles END AS vehicles,
 CASE WHEN row_id % 19 = 0 THEN cast(NULL AS int) ELSE num_casualties END AS casualties,
 speed_limit AS speed, date AS crash_date, time AS crash_time
FROM accidents
"""
UPLOAD_SQL = "SELECT * FROM accidents_raw UNION ALL SELECT * FROM accidents_raw WHERE src_row % 10 = 0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def accidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ACCIDENTS_SQL.replace("FROM events", "FROM {events}"),
                     events=table(spark, sf_dir, "events"))


def accidents_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ACCIDENTS_RAW_SQL.replace("FROM accidents", "FROM {accidents}"),
                     accidents=accidents(spark, sf_dir))


def upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = accidents_raw(spark, sf_dir)
    return raw.unionAll(raw.where("src_row % 10 = 0"))


def with_accidents(sql: str) -> str:
    """Checking SQL over the canonical adapter."""
    return f"WITH RECURSIVE accidents AS ({ACCIDENTS_SQL}){sql}"


def with_upload(sql: str) -> str:
    return (
        f"WITH RECURSIVE accidents AS ({ACCIDENTS_SQL}),\n"
        f"accidents_raw AS ({ACCIDENTS_RAW_SQL}),\nupload AS ({UPLOAD_SQL}){sql}"
    )


# -- feed documents -----------------------------------------------------------------
# Twenty events make one incident document of one city; every event is a flow reading.

EPOCH = 1704067200
FEED_ROWS_SQL = f"""
SELECT event_id, event_id // 20 AS poll_id, {EPOCH} + (event_id // 20) * 60 AS poll_second,
 event_id % 20 AS position, (event_id // 20) % 20 AS city_no,
 event_id % 97 = 0 AS bare, event_id % 11 = 0 AS point,
 cast(event_id % 15 AS int) AS category,
 CASE WHEN event_id % 6 = 5 THEN NULL ELSE cast(event_id % 6 AS int) END AS magnitude,
 event_id % 7 AS wording, event_type,
 ((event_id * 7919) % 401 - 200) / cast(1000 AS double) AS dlat,
 ((event_id * 104729) % 401 - 200) / cast(1000 AS double) AS dlon,
 CASE WHEN event_id % 13 = 0 THEN NULL ELSE cast((event_id * 37) % 3600 AS int) END AS delay,
 value * 10 AS length, user_id
FROM events
"""


def feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = FEED_ROWS_SQL.replace("event_id // 20", "event_id div 20").replace("FROM events", "FROM {events}")
    return spark.sql(text, events=table(spark, sf_dir, "events"))


def incident_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(poll_id, polled_at, payload): JSON text; every 50th document is cut off, the one before is empty."""
    centres = F.broadcast(spark.createDataFrame(
        [(i, lat, lon) for i, (_, lat, lon) in enumerate(CITIES)], "city_no BIGINT, clat DOUBLE, clon DOUBLE"
    ))
    lat, lon = F.col("clat") + F.col("dlat"), F.col("clon") + F.col("dlon")
    unnamed = F.lit(None).cast("string")
    described = F.when(F.col("wording") == 1, unnamed).otherwise(
        F.concat("event_type", F.lit(" reported on the main road near junction "), (F.col("user_id") % 100).cast("string"),
                 F.lit(", expect delays"))
    )
    event = F.struct(described.alias("description"), F.col("category").alias("code"))
    properties = F.struct(
        F.col("category").alias("iconCategory"), F.col("magnitude").alias("magnitudeOfDelay"),
        F.when(F.col("wording") == 0, F.array().cast("array<struct<description:string,code:int>>"))
        .otherwise(F.array(event)).alias("events"),
        F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("startTime"),
        F.concat(F.lit("Street "), F.col("user_id").cast("string")).alias("from"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("Road "), F.col("category").cast("string"))).alias("to"),
        F.col("length").alias("length"), F.col("delay").alias("delay"),
        F.when(F.col("event_id") % 9 != 0, F.array(F.concat(F.lit("A"), (F.col("user_id") % 100).cast("string"))))
        .alias("roadNumbers"),
    )
    incident = F.struct(
        F.struct(
            F.when(F.col("point"), F.lit("Point")).otherwise(F.lit("LineString")).alias("type"),
            F.array(F.array(lon, lat), F.array(lon + 0.01, lat + 0.01)).alias("coordinates"),
        ).alias("geometry"),
        F.when(~F.col("bare"), properties).alias("properties"),
    )
    documents = (
        feed_rows(spark, sf_dir).join(centres, "city_no")
        .groupBy("poll_id", "poll_second")
        .agg(F.sort_array(F.collect_list(F.struct("position", incident.alias("incident")))).alias("rows"))
        .select("poll_id", F.timestamp_seconds("poll_second").alias("polled_at"),
                F.to_json(F.struct(F.col("rows.incident").alias("incidents"))).alias("payload"))
    )
    turn = F.col("poll_id") % 50
    return documents.withColumn(
        "payload",
        F.when(turn == 49, F.substring("payload", 1, 60)).when(turn == 48, F.lit('{"incidents":[]}'))
        .otherwise(F.col("payload")),
    )


def flow_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reading, city, payload): speeds from events; every 29th document is not JSON."""
    names = F.broadcast(spark.createDataFrame(
        [(i, name) for i, (name, _, _) in enumerate(CITIES)], "city_no BIGINT, city STRING"
    ))
    data = F.struct(
        ((F.col("event_id") * 13) % 70).cast("double").alias("currentSpeed"),
        F.when(F.col("event_id") % 10 == 0, F.lit(0.0))
        .when(F.col("event_id") % 31 != 0, (F.col("event_id") % 31 + 40).cast("double")).alias("freeFlowSpeed"),
        F.when(F.col("event_id") % 3 != 0, F.lit(0.5)).alias("confidence"),
        F.when(F.col("event_id") % 17 == 0, F.lit(True)).alias("roadClosure"),
    )
    return (
        table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 20).alias("city_no"))
        .join(names, "city_no")
        .select(
            F.col("event_id").alias("reading"), "city",
            F.when(F.col("event_id") % 29 == 0, F.lit("{not json"))
            .otherwise(F.to_json(F.struct(data.alias("flowSegmentData")))).alias("payload"),
        )
    )


def with_feed(sql: str) -> str:
    """Checking SQL over the flattened incidents, computed without JSON."""
    cities = ", ".join(
        f"({i}, '{name}', cast({lat} AS double), cast({lon} AS double))" for i, (name, lat, lon) in enumerate(CITIES)
    )
    types = " ".join(f"WHEN {k} THEN '{v}'" for k, v in INCIDENT_TYPES.items())
    return f"""WITH RECURSIVE cities(city_no, city, city_lat, city_lon) AS (VALUES {cities}),
feed AS ({FEED_ROWS_SQL}),
incidents AS (SELECT poll_id, poll_second, position, event_id,
 CASE WHEN bare THEN 'Unknown' ELSE CASE category {types} ELSE 'Unknown' END END AS type,
 CASE WHEN bare OR magnitude IS NULL OR magnitude < 1 THEN 'Low' WHEN magnitude >= 4 THEN 'Critical' WHEN magnitude >= 3 THEN 'Major' WHEN magnitude >= 2 THEN 'Moderate' ELSE 'Minor' END AS severity,
 CASE WHEN bare OR wording = 0 THEN 'Traffic incident' WHEN wording = 1 THEN 'Unknown incident'
   ELSE event_type || ' reported on the main road near junction ' || cast(user_id % 100 AS varchar) || ', expect delays' END AS description,
 CASE WHEN point THEN 0 ELSE city_lat + dlat END AS latitude, CASE WHEN point THEN 0 ELSE city_lon + dlon END AS longitude,
 CASE WHEN bare OR delay IS NULL THEN 0 ELSE delay END AS delay_seconds,
 CASE WHEN bare THEN 0 ELSE length END AS length_meters,
 CASE WHEN bare OR event_id % 9 = 0 THEN '' ELSE 'A' || cast(user_id % 100 AS varchar) END AS roads,
 CASE WHEN bare THEN '' ELSE 'Street ' || cast(user_id AS varchar) END AS from_location,
 CASE WHEN bare OR event_id % 5 = 0 THEN '' ELSE 'Road ' || cast(category AS varchar) END AS to_location,
 CASE WHEN bare THEN '' ELSE 'T' || cast(event_id AS varchar) END AS start_time
 FROM feed JOIN cities USING (city_no) WHERE poll_id % 50 < 48)
{sql}"""
