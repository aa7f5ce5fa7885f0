"""Registered queries on accident tables, with checking SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside import schema as S
from kerbside.catalogue.adapters import accidents, upload, with_accidents, with_upload
from kerbside.functions import scalars as X
from kerbside.operators import aggregates as G
from kerbside.operators import cleaning as C
from kerbside.operators import encoding as E
from kerbside.operators import risk as K
from kerbside.operators import rules as U
from kerbside.operators import scenario as Z
from kerbside.operators import spatial as P
from kerbside.operators.classify import feature_names, standard_scores
from kerbside.operators.regression import dummy_columns
from kerbside.plans import features as V
from kerbside.session import scratch_path
from kerbside.sources import tables as T

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function
    return register


def r6(value: Column | str) -> Column:
    """Six decimals, formed alike in both engines."""
    return F.floor((F.col(value) if isinstance(value, str) else value) * 1e6 + 0.5) / 1e6


def long(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("long")


def derived(spark: SparkSession, sf: str) -> DataFrame:
    return V.derive(accidents(spark, sf))


# ---- checking SQL: shared pieces ---------------------------------------------------

def q6(text: str) -> str:
    return f"floor(({text}) * 1e6 + 0.5) / 1e6"


def q1(text: str) -> str:
    return f"round_even(({text}) * 10, 0) / 10"


HOUR = "cast(substr(time, 1, 2) AS int)"
SCORE = """least(100, CASE severity WHEN 'Minor' THEN 20 WHEN 'Serious' THEN 60 WHEN 'Fatal' THEN 100 ELSE 30 END
 + least(num_casualties * 10, 30) + least((num_vehicles - 1) * 5, 15)
 + CASE weather WHEN 'Clear' THEN 0 WHEN 'Rain' THEN 10 WHEN 'Fog' THEN 15 WHEN 'Snow' THEN 20 ELSE 5 END)"""
ROAD = "CASE road_type WHEN 'Rural' THEN 12 WHEN 'Motorway' THEN 15 ELSE 10 END"
LIGHT = "CASE light_conditions WHEN 'Daylight' THEN 10 WHEN 'Dark' THEN 15 ELSE 12 END"
SURFACE = "CASE road_surface WHEN 'Dry' THEN 10 WHEN 'Wet' THEN 13 WHEN 'Ice' THEN 18 ELSE 12 END"
DERIVED = f"""derived AS (SELECT *, isodow(date) - 1 AS day_of_week, month(date) AS month,
 CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend, {HOUR} AS hour,
 CASE WHEN {HOUR} BETWEEN 6 AND 9 THEN 'Morning Rush' WHEN {HOUR} BETWEEN 10 AND 15 THEN 'Midday'
      WHEN {HOUR} BETWEEN 16 AND 19 THEN 'Evening Rush' ELSE 'Night' END AS time_of_day,
 {SCORE} AS severity_score, {ROAD} AS road10, {LIGHT} AS light10, {SURFACE} AS surface10 FROM accidents)"""
RISK = """risk AS (SELECT *, raw * 100.0 / max(raw) OVER () AS risk_index FROM
 (SELECT *, cast(severity_score * road10 * light10 * surface10 AS double) AS raw FROM derived))"""
LEVEL = "CASE WHEN {0} < 25 THEN 'Low' WHEN {0} < 50 THEN 'Medium' WHEN {0} < 75 THEN 'High' ELSE 'Critical' END"
WEIGHT = "CASE severity WHEN 'Serious' THEN 3 WHEN 'Fatal' THEN 5 ELSE 1 END"
CITY = f"""city AS (SELECT *, least(100, severity_factor + casualty_factor + frequency_factor + fatal_factor) AS raw FROM (
 SELECT sum({WEIGHT}) / count(*) / 5 * 30 AS severity_factor, least(sum(cast(num_casualties AS double)) / count(num_casualties) * 5, 25) AS casualty_factor,
  CASE WHEN date_diff('day', min(date), max(date)) > 0 THEN least(count(*) / date_diff('day', min(date), max(date)) * 10, 25)
       ELSE least(count(*) * 2, 25) END AS frequency_factor,
  least(count(*) FILTER (severity = 'Fatal') / count(*) * 100 * 2, 20) AS fatal_factor FROM accidents))"""


def sql(body: str, *pieces: str) -> str:
    return with_accidents("".join(f", {p}" for p in pieces) + "\n" + body)


# ---- scans, sinks, previews ----------------------------------------------------------

COLUMNS = [
    "accident_id", "time", "latitude", "longitude", "weather", "road_type", "speed_limit", "num_vehicles",
    "num_casualties", "light_conditions", "road_surface", "junction_type", "severity",
]


@query("csv_round_trip", sql(
    f"SELECT {', '.join(COLUMNS)}, cast(date AS varchar) AS date FROM accidents"))
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "csv")
    table = accidents(spark, sf)
    T.write_csv(table.select(*[c.split()[0] for c in S.ACCIDENT_DDL.split(",")]), path)
    return T.read_accidents(spark, path).select(*COLUMNS, F.col("date").cast("string").alias("date"))


@query("preview", sql("SELECT accident_id, severity, weather, road_type, num_casualties FROM accidents ORDER BY row_id LIMIT 10"))
def preview(spark, sf):
    chosen = T.active_table(None, accidents(spark, sf))
    return T.preview(chosen, ["row_id"], 10).select(
        "accident_id", "severity", "weather", "road_type", "num_casualties")


# ---- derived columns --------------------------------------------------------------------

@query("time_features", sql(
    "SELECT accident_id, day_of_week, month, is_weekend, hour, time_of_day FROM derived", DERIVED))
def time_features(spark, sf):
    return V.add_time_features(accidents(spark, sf)).select(
        "accident_id", "day_of_week", "month", "is_weekend", "hour", "time_of_day")


@query("severity_score", sql(
    f"SELECT accident_id, cast(severity_score AS double) AS severity_score, {LEVEL.format('severity_score')} AS level FROM derived", DERIVED))
def severity_score(spark, sf):
    return V.add_severity_score(accidents(spark, sf)).select(
        "accident_id", "severity_score", X.risk_level(F.col("severity_score")).alias("level"))


@query("risk_index", sql(
    f"""SELECT accident_id, road10 / 10 AS road_risk_factor, light10 / 10 AS light_risk_factor,
 surface10 / 10 AS surface_risk_factor, {q6('risk_index')} AS risk_index, {LEVEL.format('risk_index')} AS risk_level FROM risk""",
    DERIVED, RISK))
def risk_index(spark, sf):
    return V.add_risk_level(derived(spark, sf)).select(
        "accident_id", "road_risk_factor", "light_risk_factor", "surface_risk_factor",
        r6("risk_index").alias("risk_index"), "risk_level")


@query("risk_level_counts", sql(
    f"SELECT {LEVEL.format('risk_index')} AS risk_level, count(*) AS n, {q6('avg(risk_index)')} AS mean_index FROM risk GROUP BY 1", DERIVED, RISK))
def risk_level_counts(spark, sf):
    return V.add_risk_level(derived(spark, sf)).groupBy("risk_level").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("risk_index")).alias("mean_index"))


# ---- city score and outlook -----------------------------------------------------------------

@query("city_risk", sql(
    f"""SELECT {q1('raw')} AS score, CASE WHEN raw < 33 THEN 'Low' WHEN raw < 66 THEN 'Medium' ELSE 'High' END AS level,
 CASE WHEN raw < 33 THEN 'green' WHEN raw < 66 THEN 'orange' ELSE 'red' END AS color,
 {q1('severity_factor')} AS severity_factor, {q1('casualty_factor')} AS casualty_factor,
 {q1('frequency_factor')} AS frequency_factor, {q1('fatal_factor')} AS fatal_factor FROM city""", CITY))
def city_risk(spark, sf):
    return K.city_risk(accidents(spark, sf))


CHANGE = f"""change AS (SELECT {q1('''greatest(least(5.0 * count(*) FILTER (weather = 'Rain') / count(*) + 8.0 * count(*) FILTER (weather = 'Fog') / count(*)
 + 4.0 * count(*) FILTER (hour >= 22 OR hour <= 5) / count(*) + 3.0 * count(*) FILTER (day_of_week >= 5) / count(*), 15), -10)''')} AS change FROM derived)"""


@query("risk_change_24h", sql(
    f"""SELECT change, CASE WHEN abs(change) < 2 THEN 'stable' WHEN change > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
 CASE WHEN abs(change) < 2 THEN 'High' WHEN abs(change) < 5 THEN 'Medium' ELSE 'High' END AS confidence,
 {q1(f"{q1('raw')} + change")} AS predicted_score FROM change, city""", DERIVED, CITY, CHANGE))
def risk_change_24h(spark, sf):
    return K.risk_change_24h(derived(spark, sf))


# ---- grids and places -----------------------------------------------------------------------

GRID = "cast(round_even(latitude / 0.01, 0) AS bigint) AS gy, cast(round_even(longitude / 0.01, 0) AS bigint) AS gx"


@query("grid_hotspots", sql(
    f"""SELECT {q6('gy * cast(0.01 AS double)')} AS latitude, {q6('gx * cast(0.01 AS double)')} AS longitude, count(*) AS accident_count,
 {q6('avg(severity_score)')} AS avg_severity, cast(sum(num_casualties) AS bigint) AS total_casualties
 FROM (SELECT *, {GRID} FROM derived) GROUP BY gy, gx""", DERIVED))
def grid_hotspots(spark, sf):
    return P.grid_hotspots(V.add_severity_score(accidents(spark, sf))).select(
        r6("latitude").alias("latitude"), r6("longitude").alias("longitude"), "accident_count",
        r6("avg_severity").alias("avg_severity"), "total_casualties")


@query("density_grid", sql(
    f"SELECT {q6('gy * cast(0.01 AS double)')} AS latitude, {q6('gx * cast(0.01 AS double)')} AS longitude, count(*) AS n FROM (SELECT {GRID} FROM accidents) GROUP BY gy, gx"))
def density_grid(spark, sf):
    return P.density_grid(accidents(spark, sf)).select(
        r6("latitude").alias("latitude"), r6("longitude").alias("longitude"), "n")


_KERNEL = "(VALUES (-3, 1), (-2, 6), (-1, 15), (0, 20), (1, 15), (2, 6), (3, 1))"


@query("density_surface", sql(
    f"""SELECT level, gy + dy AS lat_step, gx + dx AS lon_step, cast(sum(CASE WHEN dy = 0 AND dx = 0 THEN n ELSE 0 END) AS bigint) AS n,
 cast(sum(n * wy * wx) AS double) / 4096 AS density
FROM (SELECT level, cast(floor(gy / power(2, level)) AS bigint) AS gy, cast(floor(gx / power(2, level)) AS bigint) AS gx, count(*) AS n
 FROM (SELECT {GRID} FROM accidents), (VALUES (0), (1), (2)) levels(level) GROUP BY ALL) cells,
 {_KERNEL} ky(dy, wy), {_KERNEL} kx(dx, wx) GROUP BY level, gy + dy, gx + dx"""))
def density_surface(spark, sf):
    return P.density_surface(accidents(spark, sf))


@query("map_centre", sql(
    f"""SELECT {q6('la')} AS center_lat, {q6('lo')} AS center_lon, n AS accidents,
 CASE WHEN abs(la - 28.6139) < 0.5 AND abs(lo - 77.2090) < 0.5 THEN 'Delhi, India'
      WHEN abs(la - 19.0760) < 0.5 AND abs(lo - 72.8777) < 0.5 THEN 'Mumbai, India'
      WHEN abs(la - 51.5074) < 0.5 AND abs(lo + 0.1278) < 0.5 THEN 'London, UK'
      WHEN abs(la - 40.7128) < 0.5 AND abs(lo + 74.0060) < 0.5 THEN 'New York, USA' ELSE 'Unknown Location' END AS location
 FROM (SELECT avg(latitude) AS la, avg(longitude) AS lo, count(*) AS n FROM accidents)"""))
def map_centre(spark, sf):
    return P.map_centre(accidents(spark, sf)).select(
        r6("center_lat").alias("center_lat"), r6("center_lon").alias("center_lon"), "accidents", "location")


# ---- distributions, filters ---------------------------------------------------------------------

COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in S.SEVERITIES)


@query("severity_distribution", sql(f"SELECT {COUNTS} FROM accidents"))
def severity_distribution(spark, sf):
    return G.severity_distribution(accidents(spark, sf))


MONTHS = "months AS (SELECT unnest(range(1, 13)) AS month)"


@query("monthly_severity", sql(
    f"""SELECT cast(m.month AS int) AS month, {', '.join(f'coalesce({s.lower()}, 0) AS {s.lower()}' for s in S.SEVERITIES)}
 FROM months m LEFT JOIN (SELECT month, {COUNTS} FROM derived GROUP BY month) d ON m.month = d.month""", DERIVED, MONTHS))
def monthly_severity(spark, sf):
    return G.monthly_severity(V.add_time_features(accidents(spark, sf)))


@query("monthly_casualties", sql(
    """SELECT cast(m.month AS int) AS month, coalesce(accidents, 0) AS accidents, coalesce(casualties, 0) AS casualties, coalesce(deaths, 0) AS deaths
 FROM months m LEFT JOIN (SELECT month, count(severity) AS accidents, cast(sum(num_casualties) AS bigint) AS casualties,
  count(*) FILTER (severity = 'Fatal') AS deaths FROM derived GROUP BY month) d ON m.month = d.month""", DERIVED, MONTHS))
def monthly_casualties(spark, sf):
    return G.monthly_totals(V.add_time_features(accidents(spark, sf)))


@query("filter_options", sql(
    " UNION ALL ".join(f'SELECT DISTINCT \'{c}\' AS "column", {c} AS value FROM accidents' for c in ("severity", "weather", "road_type"))))
def filter_options(spark, sf):
    return G.filter_options(accidents(spark, sf))


@query("map_filter", sql(
    """SELECT accident_id, latitude, longitude, severity, weather, road_type, num_casualties,
 CASE severity WHEN 'Minor' THEN '#34A853' WHEN 'Serious' THEN '#FBBC05' WHEN 'Fatal' THEN '#EA4335' ELSE '#4285F4' END AS colour,
 severity || ' - ' || weather AS tooltip FROM accidents
 WHERE severity IN ('Serious', 'Fatal') AND weather IN ('Rain', 'Fog', 'Snow') AND road_type IN ('Urban', 'Motorway')"""))
def map_filter(spark, sf):
    return G.map_markers(G.map_filter(
        accidents(spark, sf), ["Serious", "Fatal"], ["Rain", "Fog", "Snow"], ["Urban", "Motorway"]))


@query("value_counts", sql(
    """SELECT 'weather' AS "column", weather AS value, count(*) AS n, (SELECT road_type FROM (SELECT road_type, count(*) AS c FROM accidents GROUP BY 1) ORDER BY c DESC, road_type LIMIT 1) AS top_road
 FROM accidents GROUP BY weather"""))
def value_counts(spark, sf):
    table = accidents(spark, sf)
    return G.value_counts(table, "weather").select(
        F.lit("weather").alias("column"), F.col("weather").alias("value"), "n",
        G.most_common(table, "road_type").alias("top_road"))


@query("junction_above_median", sql(
    f"""SELECT junction_type, {q6('m')} AS mean_score FROM means WHERE m > (SELECT median(m) FROM means)""",
    DERIVED, "means AS (SELECT junction_type, avg(severity_score) AS m FROM derived GROUP BY 1)"))
def junction_above_median(spark, sf):
    return G.groups_above_median(
        V.add_severity_score(accidents(spark, sf)), "junction_type", "severity_score"
    ).select("junction_type", r6("mean_score").alias("mean_score"))


# ---- encodings and model inputs --------------------------------------------------------------------

@query("factor_codes", sql(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c} AS value, min(row_id) AS first_row, cast(row_number() OVER (ORDER BY min(row_id)) - 1 AS int) AS code FROM derived GROUP BY {c}"""
        for c in S.FACTOR_COLUMNS), DERIVED))
def factor_codes(spark, sf):
    return E.first_seen_codes(V.add_time_features(accidents(spark, sf)), "row_id")


_GROWN = "weather", "road_type", "junction_type"


@query("grown_codes", sql(f"""SELECT column_name AS "column", value, cast(row_number() OVER (PARTITION BY column_name ORDER BY first_seen) - 1 AS int) AS code FROM (
 SELECT column_name, value, min(batch * 1000000000000 + row_id) AS first_seen FROM (
  {" UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value, row_id, CASE WHEN weather IN ('Clear', 'Rain') AND road_type <> 'Rural' THEN 0 ELSE 1 END AS batch FROM accidents" for c in _GROWN)})
 GROUP BY column_name, value)"""))
def grown_codes(spark, sf):
    """Codes of a first table, then of all rows: values of the first table keep theirs."""
    table = accidents(spark, sf)
    first = E.first_seen_codes(table.where("weather IN ('Clear', 'Rain') AND road_type <> 'Rural'"), "row_id", list(_GROWN))
    return E.grow_codes(first, table, "row_id")


@query("label_codes", sql(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {c} AS value, cast(row_number() OVER (ORDER BY {c}) - 1 AS int) AS code FROM accidents GROUP BY {c}"""
        for c in S.LABEL_COLUMNS)))
def label_codes(spark, sf):
    return E.alphabetical_codes(accidents(spark, sf))


FIRSTS = ", ".join(f"f_{c} AS (SELECT {c}, cast(row_number() OVER (ORDER BY min(row_id)) - 1 AS int) AS code FROM derived GROUP BY {c})" for c in S.FACTOR_COLUMNS)


@query("feature_matrix", sql(
    f"""SELECT accident_id, speed_limit, num_vehicles, num_casualties, is_weekend, hour, day_of_week, month,
 {', '.join(f'f_{c}.code AS {c}_encoded' for c in S.FACTOR_COLUMNS)},
 CASE severity WHEN 'Minor' THEN 0 WHEN 'Serious' THEN 1 WHEN 'Fatal' THEN 2 END AS label
 FROM derived {' '.join(f'JOIN f_{c} USING ({c})' for c in S.FACTOR_COLUMNS)}""", DERIVED, FIRSTS))
def feature_matrix(spark, sf):
    table = V.add_time_features(accidents(spark, sf))
    coded = E.apply_codes(table, E.first_seen_codes(table, "row_id"))
    return coded.select("accident_id", *feature_names(coded.columns), X.severity_code(F.col("severity")).alias("label"))


@query("one_hot", sql(
    """SELECT accident_id, cast(weather = 'Fog' AS double) AS "weather_Fog", cast(weather = 'Rain' AS double) AS "weather_Rain", cast(weather = 'Snow' AS double) AS "weather_Snow",
 cast(road_type = 'Rural' AS double) AS "road_type_Rural", cast(road_type = 'Urban' AS double) AS "road_type_Urban",
 cast(light_conditions = 'Daylight' AS double) AS "light_conditions_Daylight" FROM accidents"""))
def one_hot(spark, sf):
    table = accidents(spark, sf)
    dummies = [d for c in ("weather", "road_type", "light_conditions") for d in dummy_columns(table, c)]
    return table.select("accident_id", *[c.alias(name) for name, c in dummies])


@query("standard_scores", sql(
    "SELECT accident_id, " + ", ".join(
        q6(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()") + f" AS {c}" for c in ("speed_limit", "num_vehicles", "num_casualties"))
    + " FROM accidents"))
def scaled(spark, sf):
    names = ["speed_limit", "num_vehicles", "num_casualties"]
    return standard_scores(accidents(spark, sf), names).select("accident_id", *[r6(c).alias(c) for c in names])


@query("condition_shares", sql(
    f"""SELECT count(*) FILTER (road_surface IN ('Wet', 'Ice')) AS wet, count(*) FILTER (light_conditions LIKE '%Dark%') AS dark,
 count(*) FILTER (hour IN (7, 8, 9, 16, 17, 18)) AS rush, count(*) FILTER (hour >= 22 OR hour <= 5) AS night,
 count(*) FILTER (day_of_week >= 5) AS weekend, count(*) FILTER (weather LIKE '%Fog%') AS fog, count(*) FILTER (speed_limit > 60) AS fast,
 count(*) FILTER (junction_type <> 'Not at junction') AS at_junction, {q6("avg(severity_score) FILTER (speed_limit >= 60)")} AS fast_score,
 {q6("avg(severity_score) FILTER (speed_limit < 60)")} AS slow_score FROM derived""", DERIVED))
def condition_shares(spark, sf):
    return U.condition_shares(derived(spark, sf)).withColumns(
        {c: r6(c) for c in ("fast_score", "slow_score")})


# ---- cleaning ------------------------------------------------------------------------------------------

DISTINCT = "d AS (SELECT DISTINCT * FROM upload)"


def _mode(column: str) -> str:
    return f"(SELECT v FROM (SELECT {column} AS v, count(*) AS c FROM d WHERE {column} IS NOT NULL GROUP BY 1) ORDER BY c DESC, v LIMIT 1)"


FILLED = f"""filled AS (SELECT src_row, lat, lng, accident_severity, coalesce(weather_condition, {_mode('weather_condition')}) AS weather_condition,
 road_type, road_condition, lighting, junction, coalesce(cast(vehicles AS double), (SELECT median(vehicles) FROM d)) AS vehicles,
 coalesce(cast(casualties AS double), (SELECT median(casualties) FROM d)) AS casualties, speed, crash_date, crash_time FROM d)"""
WORDS = """words AS (SELECT *, regexp_replace(lower(trim(accident_severity)), '\\.0$', '') AS sev, lower(trim(weather_condition)) AS wea, replace(lower(trim(road_type)), ' ', '_') AS roa FROM filled)"""
TITLE = "array_to_string(list_transform(regexp_extract_all({0}, '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '')"


def _case(column: str, words: dict, otherwise: str) -> str:
    arms = " ".join(
        f"WHEN {column} IN ({', '.join(repr(w) for w in spellings)}) THEN '{name}'" for name, spellings in words.items())
    return f"CASE {arms} ELSE {otherwise} END"


STANDARD = f"""standard AS (SELECT src_row, lat AS latitude, lng AS longitude, {_case('sev', S.SEVERITY_WORDS, "'Minor'")} AS severity,
 {_case('wea', S.WEATHER_WORDS, TITLE.format('wea'))} AS weather, {_case('roa', S.ROAD_WORDS, TITLE.format('lower(trim(road_type))'))} AS road_type,
 road_condition AS road_surface, lighting AS light_conditions, junction AS junction_type, vehicles AS num_vehicles, casualties AS num_casualties,
 speed AS speed_limit, cast(crash_date AS varchar) AS date, crash_time AS time,
 'ACC' || lpad(cast(row_number() OVER (ORDER BY src_row) AS varchar), cast(greatest(6, length(cast(row_number() OVER (ORDER BY src_row) AS varchar))) AS int), '0') AS accident_id FROM words)"""


def upload_sql(body: str, *pieces: str) -> str:
    return with_upload("".join(f", {p}" for p in pieces) + "\n" + body)


@query("clean_impute", upload_sql(
    "SELECT src_row, lat, lng, accident_severity, weather_condition, road_type, vehicles, casualties, speed, crash_time FROM filled", DISTINCT, FILLED))
def clean_impute(spark, sf):
    return C.clean(upload(spark, sf)).select(
        "src_row", "lat", "lng", "accident_severity", "weather_condition", "road_type", "vehicles", "casualties",
        "speed", "crash_time")


@query("aliases", upload_sql(
    """SELECT src_row, lat AS latitude, lng AS longitude, accident_severity AS severity, weather_condition AS weather, vehicles AS num_vehicles,
 speed AS speed_limit, crash_time AS time FROM upload"""))
def aliases(spark, sf):
    return C.apply_aliases(C.normalise_headers(upload(spark, sf), dashes=True)).select(
        "src_row", "latitude", "longitude", "severity", "weather", "num_vehicles", "speed_limit", "time")


@query("vocabulary", upload_sql(
    f"""SELECT src_row, {_case("regexp_replace(lower(trim(accident_severity)), '\\.0$', '')", S.SEVERITY_WORDS, "'Minor'")} AS severity,
 {_case("replace(lower(trim(road_type)), ' ', '_')", S.ROAD_WORDS, TITLE.format('lower(trim(road_type))'))} AS road_type FROM upload"""))
def vocabulary(spark, sf):
    named = C.apply_aliases(upload(spark, sf))
    return C.standardise_vocabulary(named).select("src_row", "severity", "road_type")


@query("standardise", upload_sql("SELECT * FROM standard", DISTINCT, FILLED, WORDS, STANDARD))
def standardise(spark, sf):
    done = C.optimise(upload(spark, sf), order=["src_row"]).data
    return done.withColumn("date", F.col("date").cast("string"))


UPLOADED = DERIVED.replace("FROM accidents)", "FROM (SELECT * REPLACE (cast(date AS date) AS date) FROM standard))")


@query("upload_pipeline", upload_sql(
    f"""SELECT src_row, accident_id, hour, month, time_of_day, cast(severity_score AS double) AS severity_score,
 {q6('risk_index')} AS risk_index, {LEVEL.format('risk_index')} AS risk_level FROM risk""",
    DISTINCT, FILLED, WORDS, STANDARD, UPLOADED, RISK))
def upload_pipeline(spark, sf):
    table, _ = V.process_upload(upload(spark, sf), order=["src_row"])
    return V.add_risk_level(table).select(
        "src_row", "accident_id", "hour", "month", "time_of_day", "severity_score", r6("risk_index").alias("risk_index"), "risk_level")


@query("upload_file", ORACLES["upload_pipeline"])
def upload_file(spark, sf):
    """The same upload as a user's file: quoted texts with commas, quotes and line breaks, three ways to write a date."""
    day = F.to_date("crash_date")
    written = upload(spark, sf).withColumns({
        "crash_date": F.when(F.col("src_row") % 3 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("src_row") % 3 == 1, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "yyyy/MM/dd")),
        "notes": F.concat(F.lit('said "slow down", then\nleft '), F.col("src_row").cast("string")),
    })
    path = scratch_path(spark, "upload-file")
    T.write_csv(written, path)
    table, _ = V.process_upload(T.read_upload(spark, path, multi_line=True), order=["src_row"])
    return V.add_risk_level(table).select(
        "src_row", "accident_id", "hour", "month", "time_of_day", "severity_score", r6("risk_index").alias("risk_index"), "risk_level")


@query("upload_codes", upload_sql(
    """SELECT road_type, cast(dense_rank() OVER (ORDER BY first_row) - 1 AS int) AS code, n FROM (
 SELECT road_type, min(src_row) AS first_row, count(*) AS n FROM standard GROUP BY road_type)""",
    DISTINCT, FILLED, WORDS, STANDARD))
def upload_codes(spark, sf):
    table, _ = V.process_upload(upload(spark, sf), order=["src_row"], encode=True)
    return table.groupBy("road_type", F.col("road_type_encoded").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("generate_ids", upload_sql(
    """SELECT src_row, 'ACC' || lpad(cast(row_number() OVER (ORDER BY src_row) AS varchar), cast(greatest(6, length(cast(row_number() OVER (ORDER BY src_row) AS varchar))) AS int), '0') AS accident_id
 FROM (SELECT DISTINCT src_row FROM upload)"""))
def generate_ids(spark, sf):
    return C.generate_ids(upload(spark, sf).select("src_row").distinct(), ["src_row"])


@query("quality_report", upload_sql(
    """SELECT (SELECT count(*) FROM upload) AS original_rows, 14 AS original_cols, count(*) AS final_rows, 15 AS final_cols,
 (SELECT count(*) FROM upload) - count(*) AS duplicates_removed,
 count(*) FILTER (sev NOT IN ('1','2','3','slight','minor','low','serious','moderate','medium','fatal','severe','high','killed')) AS severities_replaced,
 count(*) FILTER (lat < -90 OR lat > 90) AS invalid_latitude, count(*) FILTER (lng < -180 OR lng > 180) AS invalid_longitude,
 greatest(0, 100 - least(10, ((SELECT count(*) FROM upload) - count(*)) / (SELECT count(*) FROM upload) * 100)
  - CASE WHEN count(*) FILTER (lat < -90 OR lat > 90) > 0 THEN 5 ELSE 0 END - CASE WHEN count(*) FILTER (lng < -180 OR lng > 180) > 0 THEN 5 ELSE 0 END) AS quality_score
 FROM words""", DISTINCT, FILLED, WORDS))
def quality_report(spark, sf):
    return C.optimise(upload(spark, sf), order=["src_row"]).report


@query("quality_changes", upload_sql(
    """SELECT kind, "column", n FROM (
 SELECT 'renamed' AS kind, NULL AS "column", 12 AS n
 UNION ALL SELECT 'duplicates', NULL, (SELECT count(*) FROM upload) - (SELECT count(*) FROM d)
 UNION ALL SELECT 'median_fill', 'num_vehicles', (SELECT count(*) FROM d WHERE vehicles IS NULL)
 UNION ALL SELECT 'median_fill', 'num_casualties', (SELECT count(*) FROM d WHERE casualties IS NULL)
 UNION ALL SELECT 'mode_fill', 'weather', (SELECT count(*) FROM d WHERE weather_condition IS NULL)
 UNION ALL SELECT 'severity', 'severity', (SELECT count(*) FROM d WHERE accident_severity = 'weird')
 UNION ALL SELECT 'warning', 'latitude', (SELECT count(*) FROM d WHERE lat > 90)
 UNION ALL SELECT 'generated_ids', 'accident_id', (SELECT count(*) FROM d))""", DISTINCT))
def quality_changes(spark, sf):
    return C.optimise(upload(spark, sf), order=["src_row"]).changes.select("kind", "column", "n")


@query("append_records", sql(
    """SELECT accident_id, hour, month, cast(severity_score AS double) AS severity_score, junction_type FROM derived
 UNION ALL SELECT 'NEW-' || accident_id, hour, month, severity_score, NULL FROM derived""", DERIVED))
def append_records(spark, sf):
    table = accidents(spark, sf)
    new = table.drop("junction_type").withColumn("accident_id", F.concat(F.lit("NEW-"), "accident_id"))
    return V.derive(C.append_records(table, new)).select(
        "accident_id", "hour", "month", "severity_score", "junction_type")


# ---- recommendations and scenarios ------------------------------------------------------------------------

def _p1(text: str) -> str:
    return f"printf('%.1f', {q1(text)})"


@query("design_recommendations", sql(
    f"""SELECT rule_no, category, priority, issue FROM (
 SELECT 1 AS rule_no, 'Junction Design' AS category, 'High' AS priority, 'High-risk junction types: ' || (SELECT string_agg(junction_type, ', ' ORDER BY junction_type) FROM means WHERE m > (SELECT median(m) FROM means)) AS issue,
  EXISTS (SELECT 1 FROM means WHERE m > (SELECT median(m) FROM means)) AS fired
 UNION ALL SELECT 2, 'Road Surface', 'High', wet || ' accidents (' || {_p1('wet / n * 100')} || '%) occurred on wet/icy surfaces', wet > n * 0.3 FROM f
 UNION ALL SELECT 3, 'Lighting Infrastructure', 'Medium', dark || ' accidents (' || {_p1('dark / n * 100')} || '%) occurred in dark conditions', dark > n * 0.35 FROM f
 UNION ALL SELECT 4, 'Speed Management', 'High', 'High-speed roads show ' || {_p1('(fast / slow - 1) * 100')} || '% higher severity scores', fast > slow * 1.3 FROM f
 UNION ALL SELECT 5, 'Weather Warning Systems', 'Medium', fog || ' fog-related accidents with avg severity of ' || {_p1('fogscore')}, fog > 5 FROM f
 UNION ALL SELECT 6, 'Traffic Flow Management', 'Medium', rush || ' accidents (' || {_p1('rush / n * 100')} || '%) during rush hours', rush > n * 0.4 FROM f
 ) WHERE fired""",
    DERIVED, "means AS (SELECT junction_type, avg(severity_score) AS m FROM derived GROUP BY 1)",
    """f AS (SELECT count(*) AS n, count(*) FILTER (road_surface IN ('Wet', 'Ice')) AS wet, count(*) FILTER (light_conditions = 'Dark') AS dark,
 avg(severity_score) FILTER (speed_limit >= 60) AS fast, avg(severity_score) FILTER (speed_limit < 60) AS slow,
 count(*) FILTER (weather = 'Fog') AS fog, avg(severity_score) FILTER (weather = 'Fog') AS fogscore,
 count(*) FILTER (hour IN (7, 8, 9, 16, 17, 18)) AS rush FROM derived)"""))
def design_recommendations(spark, sf):
    return U.design_recommendations(derived(spark, sf)).select("rule_no", "category", "priority", "issue")


def _scenario_values() -> str:
    return ", ".join(f"('{n}', cast({s} AS double), cast({c} AS double), cast({f} AS double))" for n, _, s, c, f in S.INTERVENTIONS)


@query("scenarios_expected", sql(
    f"""SELECT intervention, count(*) AS accidents, {q6("count(*) FILTER (severity = 'Fatal') * (1 - fr)")} AS expected_fatal,
 {q6("count(*) FILTER (severity = 'Serious') * (1 - sr) + count(*) FILTER (severity = 'Fatal') * fr")} AS expected_serious,
 {q6("count(*) FILTER (severity = 'Minor') + count(*) FILTER (severity = 'Serious') * sr")} AS expected_minor,
 sum(round_even(num_casualties * (1 - cr), 0)) AS casualties_after
 FROM accidents, (VALUES {_scenario_values()}) i(intervention, sr, cr, fr) GROUP BY intervention, sr, cr, fr"""))
def scenarios_expected(spark, sf):
    return Z.expected_outcomes(accidents(spark, sf)).withColumns(
        {c: r6(c) for c in ("expected_fatal", "expected_serious", "expected_minor")})


def _drawn(purpose: str) -> str:
    return f"('0x' || substr(md5(row_id || '/' || intervention || '/{purpose}/42'), 1, 7))::BIGINT / 268435456.0"


@query("scenario_counts", sql(
    f"""SELECT intervention, fatal_before, fatal_after, serious_before, serious_after, casualties_before, casualties_after,
 fatal_before - fatal_after AS fatal_reduction, casualties_before - casualties_after AS casualty_reduction,
 greatest(1, trunc((fatal_before - fatal_after) * 1.2::DOUBLE + (casualties_before - casualties_after) * 0.1::DOUBLE))::BIGINT AS lives_saved_estimate FROM (
 SELECT intervention, count(*) FILTER (severity = 'Fatal') AS fatal_before, count(*) FILTER (severity = 'Serious') AS serious_before,
  count(*) FILTER (severity = 'Fatal' AND NOT saved) AS fatal_after,
  count(*) FILTER (severity = 'Serious' AND NOT eased) + count(*) FILTER (severity = 'Fatal' AND saved) AS serious_after,
  sum(cast(num_casualties AS double)) AS casualties_before, sum(round_even(num_casualties * (1 - cr), 0)) AS casualties_after
 FROM (SELECT *, {_drawn('fatal')} < fr AS saved, {_drawn('serious')} < sr AS eased
  FROM accidents, (VALUES {_scenario_values()}) i(intervention, sr, cr, fr)) GROUP BY intervention)"""))
def scenario_counts(spark, sf):
    return Z.simulate(accidents(spark, sf), key="row_id").select(
        "intervention", "fatal_before", "fatal_after", "serious_before", "serious_after", "casualties_before",
        "casualties_after", "fatal_reduction", "casualty_reduction", "lives_saved_estimate")


@query("scenarios")
def scenarios(spark, sf):
    return Z.simulate(accidents(spark, sf), key="row_id")
