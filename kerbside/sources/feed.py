"""Traffic feed documents: JSON payloads landed as files, flattened to rows.

A collector outside Spark fetches the feed; executors never call the network.
All functions work on batch and streaming DataFrames alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions import scalars as X

# ``coordinates`` stays raw JSON text: its nesting depends on the geometry type.
INCIDENTS_DDL = """
 incidents ARRAY<STRUCT<
  geometry: STRUCT<type: STRING, coordinates: STRING>,
  properties: STRUCT<iconCategory: INT, magnitudeOfDelay: INT,
   events: ARRAY<STRUCT<description: STRING, code: INT>>,
   startTime: STRING, endTime: STRING, `from`: STRING, `to`: STRING,
   length: DOUBLE, delay: INT, roadNumbers: ARRAY<STRING>>>>
"""
FLOW_DDL = """
 flowSegmentData STRUCT<currentSpeed: DOUBLE, freeFlowSpeed: DOUBLE,
  confidence: DOUBLE, roadClosure: BOOLEAN>
"""
# What ``_start_of_line`` reads without the JSON parser: [[1.5,51.5],[1.6,51.6]], no exponents, integers or blanks.
_DECIMAL = r"-?+(?:0|[1-9][0-9]{0,29}+)\.[0-9]{1,30}+"
_POINT = rf"\[{_DECIMAL},{_DECIMAL}(?:,{_DECIMAL})*+\]"
_PLAIN_POINTS = rf"^\[{_POINT}(?:,{_POINT})*+\]\z"
INCIDENT_FIELDS = [
    "type", "severity", "description", "latitude", "longitude", "delay_seconds",
    "length_meters", "road_numbers", "from_location", "to_location", "start_time", "end_time",
]


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per line, unparsed."""
    return spark.read.text(path).withColumnRenamed("value", "payload")


def stream_payloads(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return (
        spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
        .withColumnRenamed("value", "payload")
    )


def _start_of_line(geometry: Column) -> Column:
    """First point [longitude, latitude] of a LineString; null for anything else.

    A list of points in plain decimal numbers is read by cutting the first point
    out, which gives the same numbers as the JSON parser at a fraction of its time.
    """
    text = geometry["coordinates"]
    nested = F.get(F.from_json(text, "array<array<double>>"), F.lit(0))
    plain = F.split(F.substring_index(F.substr(text, F.lit(3)), "]", 1), ",").try_cast("array<double>")
    return F.when(geometry["type"] == "LineString", F.when(text.rlike(_PLAIN_POINTS), plain).otherwise(
        F.coalesce(nested, F.from_json(text, "array<double>"))))


def select_incidents(
    incidents: DataFrame, types: list[str] | None = None, box: tuple[float, float, float, float] | None = None
) -> DataFrame:
    """Incidents of the given types inside ``box`` (min_lon, min_lat, max_lon, max_lat), bounds included."""
    if types is not None:
        incidents = incidents.where(F.col("type").isin(types))
    if box is not None:
        west, south, east, north = box
        incidents = incidents.where(F.col("longitude").between(west, east) & F.col("latitude").between(south, north))
    return incidents


def malformed(documents: DataFrame, payload: str = "payload") -> DataFrame:
    """The documents that are no JSON object, for a reject table."""
    return documents.where(F.from_json(F.col(payload), "map<string,string>").isNull())


def parse_incidents(documents: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per incident, next to the document's own columns and ``position``.

    Malformed documents and documents without incidents give no rows.
    """
    own = [c for c in documents.columns if c != payload]
    rows = documents.select(
        *own, F.posexplode(F.from_json(F.col(payload), INCIDENTS_DDL)["incidents"])
        .alias("position", "incident"),
    )
    rows = rows.withColumn("start", _start_of_line(F.col("incident.geometry")))
    props = F.col("incident.properties")
    events = props["events"]
    described = F.when(
        F.coalesce(F.size(events), F.lit(0)) > 0,
        F.coalesce(F.get(events, F.lit(0))["description"], F.lit("Unknown incident")),
    ).otherwise(F.lit("Traffic incident"))

    def text(name: str) -> Column:
        return F.coalesce(props[name], F.lit(""))

    return rows.select(
        *own, "position",
        X.incident_type(props["iconCategory"]).alias("type"),
        X.delay_severity(props["magnitudeOfDelay"]).alias("severity"),
        described.alias("description"),
        F.coalesce(F.get("start", F.lit(1)), F.lit(0.0)).alias("latitude"),
        F.coalesce(F.get("start", F.lit(0)), F.lit(0.0)).alias("longitude"),
        F.coalesce(props["delay"], F.lit(0)).alias("delay_seconds"),
        F.coalesce(props["length"], F.lit(0.0)).alias("length_meters"),
        F.coalesce(props["roadNumbers"], F.array().cast("array<string>")).alias("road_numbers"),
        text("from").alias("from_location"), text("to").alias("to_location"),
        text("startTime").alias("start_time"), text("endTime").alias("end_time"),
    )


def parse_flow(documents: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per readable flow document, with its congestion percentage."""
    own = [c for c in documents.columns if c != payload]
    parsed = documents.withColumn("_doc", F.from_json(
        F.col(payload), f"{FLOW_DDL}, _unreadable STRING", {"columnNameOfCorruptRecord": "_unreadable"}
    ))
    data = F.col("_doc.flowSegmentData")
    current = F.coalesce(data["currentSpeed"], F.lit(0.0))
    free = F.coalesce(data["freeFlowSpeed"], F.lit(0.0))
    readable = F.col("_doc").isNotNull() & F.col("_doc._unreadable").isNull()
    return parsed.where(readable).select(
        *own, current.alias("current_speed"), free.alias("free_flow_speed"),
        X.congestion_percent(current, free).alias("congestion_percent"),
        F.coalesce(data["confidence"], F.lit(0.0)).alias("confidence"),
        F.coalesce(data["roadClosure"], F.lit(False)).alias("road_closure"),
    )
