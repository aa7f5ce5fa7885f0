"""Registered queries on density clusters and the reports that use them."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbside.catalogue.adapters import accidents
from kerbside.catalogue.batch import CITY, DERIVED, derived, q1, q6, r6, sql
from kerbside.operators import clusters as K
from kerbside.operators import dbscan as D
from kerbside.operators import rules as U
from kerbside.operators.silhouette import cluster_stats, silhouette_squared

EPS, MIN_SAMPLES = 0.00305, 3
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Brute force on eps cells, labels by transitive closure: an independent statement of the result.
CLUSTERED = f"""pts AS (SELECT row_id, latitude, longitude, cast(floor(latitude / {EPS}) AS bigint) AS gx, cast(floor(longitude / {EPS}) AS bigint) AS gy FROM accidents),
steps AS (SELECT a.d AS dx, b.d AS dy FROM (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d)),
near AS (SELECT a.row_id AS a, b.row_id AS b FROM pts a JOIN (SELECT pts.*, gx + dx AS kx, gy + dy AS ky FROM pts, steps) b ON a.gx = b.kx AND a.gy = b.ky
 WHERE (a.latitude - b.latitude) * (a.latitude - b.latitude) + (a.longitude - b.longitude) * (a.longitude - b.longitude) <= cast({EPS} AS double) * cast({EPS} AS double)),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= {MIN_SAMPLES}),
edges AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach(root, id) AS (SELECT id, id FROM core UNION SELECT r.root, e.b FROM reach r JOIN edges e ON r.id = e.a),
comp AS (SELECT id, min(root) AS first FROM reach GROUP BY id),
numbers AS (SELECT first, row_number() OVER (ORDER BY first) - 1 AS cluster FROM (SELECT DISTINCT first FROM comp)),
cored AS (SELECT id, cluster FROM comp JOIN numbers USING (first)),
labels AS (SELECT p.row_id, coalesce(c.cluster, (SELECT min(k.cluster) FROM near n JOIN cored k ON n.b = k.id WHERE n.a = p.row_id), -1) AS cluster
 FROM pts p LEFT JOIN cored c ON p.row_id = c.id),
clustered AS (SELECT accidents.*, cluster FROM accidents JOIN labels USING (row_id)),
spots AS (SELECT cluster AS cluster_id, avg(latitude) AS center_lat, avg(longitude) AS center_lon, count(*) AS accident_count, avg(num_casualties) AS avg_casualties,
 count(*) FILTER (severity = 'Fatal') AS fatal_count, count(*) FILTER (severity = 'Serious') AS serious_count,
 CASE WHEN count(*) FILTER (severity = 'Fatal') > 0 THEN 'High' WHEN count(*) FILTER (severity = 'Serious') > count(*) * 0.3 THEN 'Medium' ELSE 'Low' END AS risk_level
 FROM clustered WHERE cluster >= 0 GROUP BY cluster)"""


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function
    return register


def q9(text: str) -> str:
    return f"floor(({text}) * 1e9 + 0.5) / 1e9"


def r9(name: str):
    """Nine decimals: means of few coordinates often end in a 5 at the seventh."""
    return F.floor(F.col(name) * 1e9 + 0.5) / 1e9


def clusters(spark, sf):
    return D.dbscan(accidents(spark, sf), EPS, MIN_SAMPLES, "row_id")


@query("dbscan_points", sql("SELECT accident_id, cluster FROM clustered", CLUSTERED))
def dbscan_points(spark, sf):
    table = accidents(spark, sf)
    return D.label_rows(table, clusters(spark, sf)).select("accident_id", "cluster")


@query("dbscan_appended", sql("SELECT accident_id, cluster FROM clustered", CLUSTERED))
def dbscan_appended(spark, sf):
    """The same labels from a stored state that two later tables are added to."""
    table = accidents(spark, sf)
    state = K.start(table.where("row_id % 10 < 6"), EPS, MIN_SAMPLES, "row_id")
    for late in ("row_id % 10 = 6 AND latitude < 51.5", "row_id % 10 > 6 OR (row_id % 10 = 6 AND latitude >= 51.5)"):
        state = K.append(state, table.where(late))
    return D.label_rows(table, K.clusters(state)).select("accident_id", "cluster")


@query("dbscan_hotspots", sql(
    f"""SELECT cluster_id, {q9('center_lat')} AS center_lat, {q9('center_lon')} AS center_lon, accident_count, {q6('avg_casualties')} AS avg_casualties,
 fatal_count, serious_count, risk_level FROM spots""", CLUSTERED))
def dbscan_hotspots(spark, sf):
    return D.hotspots(clusters(spark, sf)).withColumns(
        {"center_lat": r9("center_lat"), "center_lon": r9("center_lon"), "avg_casualties": r6("avg_casualties")})


@query("dbscan_counts", sql(
    """SELECT (SELECT count(*) FROM spots) AS n_clusters, (SELECT count(*) FROM labels WHERE cluster < 0) AS noise_points""", CLUSTERED))
def dbscan_counts(spark, sf):
    return D.cluster_counts(clusters(spark, sf))


@query("hotspot_levels", sql(
    """SELECT count(*) AS total, count(*) FILTER (risk_level = 'High') AS high, count(*) FILTER (risk_level = 'Medium') AS medium,
 count(*) FILTER (risk_level = 'Low') AS low FROM spots""", CLUSTERED))
def hotspot_levels(spark, sf):
    return D.hotspot_levels(D.hotspots(clusters(spark, sf)))


LABELLED = "loc AS (SELECT cluster, latitude - 51.6 AS y, longitude + 0.3 AS x FROM clustered)"


@query("silhouette_squared", sql(
    f"""SELECT {q6('avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette FROM (
 SELECT any_value(o.n) AS n, any_value(((p.y - o.cy) * (p.y - o.cy) + (p.x - o.cx) * (p.x - o.cx) + o.v) * o.n / greatest(o.n - 1, 1)) AS a,
  min((p.y - c.cy) * (p.y - c.cy) + (p.x - c.cx) * (p.x - c.cx) + c.v) AS b
 FROM (SELECT *, row_number() OVER () AS id FROM loc) p JOIN cs o ON p.cluster = o.cluster JOIN cs c ON p.cluster <> c.cluster GROUP BY id)""",
    CLUSTERED, LABELLED,
    "cs AS (SELECT cluster, count(*) AS n, avg(y) AS cy, avg(x) AS cx, greatest(0, avg(y * y + x * x) - avg(y) * avg(y) - avg(x) * avg(x)) AS v FROM loc GROUP BY cluster)"))
def squared(spark, sf):
    return silhouette_squared(clusters(spark, sf), 4 * EPS).select(r6("silhouette").alias("silhouette"))


@query("dbscan_stats", sql(
    f"""SELECT (SELECT count(*) FROM spots) AS n_clusters, (SELECT count(*) FROM labels WHERE cluster < 0) AS noise_points,
 (SELECT {q6('avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)')} FROM (
 SELECT any_value(o.n) AS n, any_value(((p.y - o.cy) * (p.y - o.cy) + (p.x - o.cx) * (p.x - o.cx) + o.v) * o.n / greatest(o.n - 1, 1)) AS a,
  min((p.y - c.cy) * (p.y - c.cy) + (p.x - c.cx) * (p.x - c.cx) + c.v) AS b
 FROM (SELECT *, row_number() OVER () AS id FROM loc) p JOIN cs o ON p.cluster = o.cluster JOIN cs c ON p.cluster <> c.cluster GROUP BY id)) AS silhouette""",
    CLUSTERED, LABELLED,
    "cs AS (SELECT cluster, count(*) AS n, avg(y) AS cy, avg(x) AS cx, greatest(0, avg(y * y + x * x) - avg(y) * avg(y) - avg(x) * avg(x)) AS v FROM loc GROUP BY cluster)"))
def dbscan_stats(spark, sf):
    return cluster_stats(clusters(spark, sf), 4 * EPS).withColumn("silhouette", r6("silhouette"))


@query("priority_recommendations", sql(
    """SELECT cast(row_number() OVER (ORDER BY impact_score DESC, rule_no) AS int) AS rank, category, impact_score, priority, recommendation FROM (
 SELECT 1 AS rule_no, 'Speed Control' AS category, least(90, 50 + 10 * count(*) FILTER (speed_limit > 60 AND severity = 'Fatal')) AS impact_score,
  CASE WHEN count(*) FILTER (speed_limit > 60 AND severity = 'Fatal') > 0 THEN 'Critical' ELSE 'High' END AS priority,
  'Reduce speed limits in high-accident zones' AS recommendation, count(*) FILTER (speed_limit > 60) > count(*) * 0.2 AS fired FROM accidents
 UNION ALL SELECT 2, 'Junction Redesign', 85, 'High', 'Convert dangerous intersections to roundabouts', count(*) FILTER (junction_type <> 'Not at junction') > count(*) * 0.3 FROM accidents
 UNION ALL SELECT 3, 'Lighting Improvement', 70, 'Medium', 'Install LED street lighting in dark zones', count(*) FILTER (light_conditions LIKE '%Dark%') > count(*) * 0.25 FROM accidents
 UNION ALL SELECT 4, 'Road Surface', 65, 'Medium', 'Improve drainage and install anti-skid surfaces', count(*) FILTER (road_surface LIKE '%Wet%' OR road_surface LIKE '%Ice%') > count(*) * 0.2 FROM accidents
 UNION ALL SELECT 5, 'Visibility Enhancement', 55, 'Medium', 'Install fog warning systems and reflective markers', count(*) FILTER (weather LIKE '%Fog%') > 5 FROM accidents
 UNION ALL SELECT 6, 'Traffic Calming', 80, 'High', 'Deploy traffic calming measures at ' || (SELECT count(*) FROM spots) || ' identified hotspots', (SELECT count(*) FROM spots) > 3
 UNION ALL SELECT 7, 'Signage Improvement', 45, 'Low', 'Upgrade warning signs and road markings', TRUE) WHERE fired""", CLUSTERED))
def priority_recommendations(spark, sf):
    found = D.hotspots(clusters(spark, sf))
    return U.priority_recommendations(
        accidents(spark, sf), found.agg(F.count(F.lit(1))).scalar()
    ).select("rank", "category", "impact_score", "priority", "recommendation")


@query("executive_summary", sql(
    f"""SELECT level, score, n AS total_accidents, fatal AS fatal_count, concat_ws(' ',
 CASE level WHEN 'High' THEN 'ALERT: City risk level is HIGH (' || score || '/100).' WHEN 'Medium' THEN 'CAUTION: City risk level is MODERATE (' || score || '/100).'
  ELSE 'City risk level is LOW (' || score || '/100).' END,
 'Analysis covers ' || n || ' recorded accidents.',
 CASE WHEN fatal > 0 THEN 'CRITICAL: ' || fatal || ' fatal accidents recorded - immediate action required.' END,
 CASE WHEN spots > 0 THEN 'Identified ' || spots || ' accident clusters, ' || high || ' are high-risk zones.' END,
 CASE WHEN rain > n * 0.3 THEN 'Weather factor: Rain contributes to 30%+ of accidents - consider drainage improvements.' END,
 'Most accidents occur on ' || road || ' roads.',
 'RECOMMENDED ACTIONS: ' || concat_ws('; ', CASE WHEN fatal > 0 THEN 'Review speed limits in fatal accident zones' END,
  CASE WHEN spots > 0 THEN 'Deploy traffic calming at identified hotspots' END, CASE WHEN rain > 0 THEN 'Improve road drainage and visibility during rain' END) || '.') AS summary
 FROM (SELECT {q1('raw')} AS score, CASE WHEN raw < 33 THEN 'Low' WHEN raw < 66 THEN 'Medium' ELSE 'High' END AS level FROM city),
 (SELECT count(*) AS n, count(*) FILTER (severity = 'Fatal') AS fatal, count(*) FILTER (weather = 'Rain') AS rain FROM accidents),
 (SELECT count(*) AS spots, count(*) FILTER (risk_level = 'High') AS high FROM spots),
 (SELECT road_type AS road FROM (SELECT road_type, count(*) AS c FROM accidents GROUP BY 1) ORDER BY c DESC, road_type LIMIT 1)""",
    CLUSTERED, CITY))
def executive_summary(spark, sf):
    levels = D.hotspot_levels(D.hotspots(clusters(spark, sf)))
    return U.executive_summary(
        accidents(spark, sf), levels.select("total").scalar(), levels.select("high").scalar())
