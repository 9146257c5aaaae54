"""Queries of regions, depth diagnostics, known windows, sweeps and terrain."""

from __future__ import annotations

from pyspark.sql import functions as F

from seismark.functions.tables import small, table
from seismark.operators import diagnostics, geometry, location, reports
from seismark.plans import adapters as A
from seismark.plans.adapters import with_tables
from seismark.plans.event_queries import SELECTED, TIERED, _selected, _tiered, rounded
from seismark.plans.model_queries import LAYERS, _arrivals
from seismark.plans.registry import query


@query("q132_location_regions")
def q132(spark, d):
    """Where each event may be, with formal errors and flags, on a lattice of one kilometre."""
    v = location.Volume((-10000.0, 10000.0), (-10000.0, 10000.0), (-3000.0, 1000.0), (5000.0, 1000.0), least_picks=6)
    r = location.location_regions(_arrivals(spark, d), LAYERS, v, location.Region(scale=0.1))
    return rounded(r, "meanE", "meanN", "meanZ", "hErrM", "vErrM", places=3)


SENSORS = """, sens AS (SELECT CASE WHEN stationId % 3 = 0 THEN 'borehole' ELSE 'surface' END AS kind, elevM AS z, CASE WHEN stationId % 3 = 0 THEN (stationId % 4) * 50.0::DOUBLE WHEN stationId % 7 = 0 THEN 5 ELSE 0 END AS dep, stationId FROM stations),
ev AS (SELECT eventId, 2000 - focalDepthM AS elevM, hErrM * 1.5 AS vErrM, nStations % 5 >= 2 AS ok, depthOnEdge, 2000 - minEpiDistM AS dz FROM located),
res AS (SELECT p.stationId, p.phase, 'p' || (p.stationId % 3) AS profile, ((degrees(atan2(s.e, s.n)) % 360) + 360) % 360 AS az, p.t - p.eventId * 3600 - 1800 AS r FROM sel p JOIN stations s ON s.stationId = p.stationId), used AS (SELECT * FROM res WHERE abs(r) <= 1500),
med AS (SELECT phase, stationId, count(*) AS n, abs(median(r)) AS off FROM used GROUP BY 1, 2),
az AS (SELECT phase, r, cos(radians(az)) AS c, sin(radians(az)) AS s FROM used), m AS (SELECT phase, count(*)::DOUBLE n, sum(c) c, sum(s) s, sum(c * c) cc, sum(s * s) ss, sum(c * s) cs, sum(r) r, sum(r * c) rc, sum(r * s) rs FROM az GROUP BY 1),
q AS (SELECT *, n * (cc * ss - cs * cs) - c * (c * ss - cs * s) + s * (c * cs - cc * s) AS d FROM m),
wide AS (
  SELECT 'sensors' AS chk, 'all' AS subject, unnest(['boreholes', 'zeroDepth', 'buriedOthers', 'inconsistent']) AS name, unnest([count(*) FILTER (kind = 'borehole'), count(*) FILTER (kind = 'borehole' AND dep = 0), count(*) FILTER (kind <> 'borehole' AND dep > 0), count(*) FILTER (stationId % 11 = 0)]::DOUBLE[]) AS value FROM sens
  UNION ALL SELECT 'shift', unnest(['0.1', '0.5', '0.9']), 'dzM', unnest([quantile_cont(dz, 0.1), quantile_cont(dz, 0.5), quantile_cont(dz, 0.9)]) FROM ev
  UNION ALL SELECT 'sPicks', ok::VARCHAR, unnest(['n', 'medianVErrM', 'iqrElevM', 'onEdge']), unnest([count(*)::DOUBLE, median(vErrM), quantile_cont(elevM, 0.75) - quantile_cont(elevM, 0.25), (count(*) FILTER (depthOnEdge))::DOUBLE]) FROM ev GROUP BY ok
  UNION ALL SELECT 'profile', phase || '/' || profile, unnest(['nAll', 'madAllS']), unnest([count(*)::DOUBLE, mad(r)]) FROM res GROUP BY phase, profile
  UNION ALL SELECT 'profile', phase || '/' || profile, unnest(['nUsed', 'madUsedS', 'medianUsedS']), unnest([count(*)::DOUBLE, mad(r), median(r)]) FROM used GROUP BY phase, profile
  UNION ALL SELECT 'stations', phase, unnest(['stations', 'enough', 'flagged', 'worst']), unnest([count(*)::DOUBLE, (count(*) FILTER (n >= 3))::DOUBLE, (count(*) FILTER (n >= 3 AND off > 600))::DOUBLE, max(off) FILTER (n >= 3)]) FROM med GROUP BY phase
  UNION ALL SELECT 'azimuth', phase, unnest(['n', 'a', 'b', 'c']), unnest([n, (r * (cc * ss - cs * cs) - c * (rc * ss - cs * rs) + s * (rc * cs - cc * rs)) / d, (n * (rc * ss - cs * rs) - r * (c * ss - cs * s) + s * (c * rs - rc * s)) / d, (n * (cc * rs - rc * cs) - c * (c * rs - rc * s) + r * (c * cs - cc * s)) / d]) FROM q)"""


@query("q133_depth_report", with_tables(SELECTED + SENSORS + ' SELECT chk AS "check", subject, name, round(value, 4) + 0 AS value FROM wide WHERE value IS NOT NULL'))
def q133(spark, d):
    """Figures of sensors, shifts, S picks, profiles, stations and azimuths, in one table."""
    k = F.col("stationId")
    depth = F.when(k % 3 == 0, (k % 4) * 50.0).when(k % 7 == 0, 5.0).otherwise(0.0)
    s = A.stations(spark, d)
    sensors = s.select(F.when(k % 3 == 0, "borehole").otherwise("surface").alias("kind"), depth.alias("sensorDepthM"), F.col("elevM").alias("sensorElevM"), (F.col("elevM") + depth + F.when(k % 11 == 0, 2.0).otherwise(0.0)).alias("surfaceElevM"))
    e = A.located(spark, d)
    before = e.select("eventId", (F.col("minEpiDistM") - F.col("focalDepthM")).alias("z"))
    events = e.select("eventId", (2000 - F.col("focalDepthM")).alias("elevM"), (F.col("hErrM") * 1.5).alias("vErrM"), (F.col("nStations") % 5).alias("nS"), "depthOnEdge")
    near = small(s.select("stationId", geometry.azimuth(F.col("e"), F.col("n")).alias("azimuth")))
    r = _selected(spark, d).join(near, "stationId").select("stationId", "phase", F.concat(F.lit("p"), (k % 3).cast("string")).alias("profile"), "azimuth", (F.col("t") - F.col("eventId") * 3600 - 1800).alias("residual"))
    found = diagnostics.depth_report(sensors, before, events, r.withColumn("used", F.abs("residual") <= 1500), tolerance=0.5, least_s=2, least=3, flag=600.0)
    return found.withColumn("value", F.round("value", 4) + F.lit(0.0))


@query("q134_known_windows", with_tables(""", top AS (SELECT catalogId, t - 600 AS a, t + 3000 AS b FROM catalog WHERE mag IS NOT NULL ORDER BY mag DESC, t, catalogId LIMIT 10), part AS (SELECT catalogId, stationId, channel, greatest(start, a) AS s, least(stop, b) AS e FROM segments, top WHERE start < b AND stop > a),
run AS (SELECT *, max(e) OVER (PARTITION BY catalogId, stationId, channel ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM part), ch AS (SELECT catalogId, stationId, sum(greatest(0, e - greatest(s, coalesce(p, s)))) AS s FROM run GROUP BY catalogId, stationId, channel), best AS (SELECT catalogId, stationId, max(s) AS s FROM ch GROUP BY 1, 2)
SELECT catalogId, stationId, round(coalesce(s, 0) / 3600, 6) AS covered, CASE WHEN s IS NULL THEN 'none' WHEN s / 3600 >= 0.5 THEN 'usable' ELSE 'gap' END AS verdict FROM (SELECT stationId, catalogId FROM stations CROSS JOIN top WHERE usedInRun) LEFT JOIN best USING (catalogId, stationId)"""))
def q134(spark, d):
    """What each used station has of the windows around the ten largest known events."""
    return rounded(diagnostics.known_windows(A.catalog(spark, d), A.segments(spark, d), A.stations(spark, d), n=10, before=600.0, after=3000.0, least=0.5), "covered")


@query("q135_sweep_lines", with_tables(TIERED + ", pts AS (SELECT method, profile, nStations::BIGINT AS k, count(*) FILTER (tier = 'A') AS a FROM tiered GROUP BY 1, 2, 3) SELECT method, profile, string_agg(k::VARCHAR, ',' ORDER BY k) AS xs, string_agg(a::VARCHAR, ',' ORDER BY k) AS ys FROM pts GROUP BY 1, 2 HAVING count(*) >= 2"))
def q135(spark, d):
    """Events of tier A over the number of stations, a line for each method and profile."""
    points = _tiered(spark, d).groupBy("method", "profile", F.col("nStations").cast("long").alias("k")).agg(F.count_if(F.col("tier") == "A").alias("a"))
    return reports.sweep_lines(points, ["method", "profile"], "k", "a").select("method", "profile", F.array_join("xs", ",").alias("xs"), F.array_join("ys", ",").alias("ys"))


@query("q136_terrain_under_stations", with_tables(""", px AS (SELECT (c_custkey - 1) % 40 AS i, (c_custkey - 1) // 40 AS j, (133 + c_custkey % 3) * 256 + c_custkey * 7 % 256 + (c_custkey * 13 % 256) / 256 - 32768 AS h FROM customer),
p AS (SELECT stationId, (e + 10000) / 20001 * 39 AS x, (n + 10000) / 20001 * 39 AS y FROM stations),
c AS (SELECT stationId, floor(x)::BIGINT + a AS i, floor(y)::BIGINT + b AS j, (CASE WHEN a = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN b = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w FROM p, (VALUES (0), (1)) v(a), (VALUES (0), (1)) u(b))
SELECT stationId, round(sum(w * h), 5) AS groundM FROM c LEFT JOIN px USING (i, j) WHERE w > 0 GROUP BY 1 HAVING count(*) = count(h)"""))
def q136(spark, d):
    """Ground under stations between the four pixels around, from a raster with a pixel a customer; off the raster there is no row."""
    k = F.col("c_custkey")
    height = geometry.terrain_height(133 + k % 3, k * 7 % 256, k * 13 % 256)
    raster = table(spark, d, "customer").select(((k - 1) % 40).alias("ir"), F.floor((k - 1) / 40).alias("iz"), height.alias("seconds"))
    at = lambda c: (F.col(c) + 10000) / 20001 * 39
    points = A.stations(spark, d).select(F.col("stationId").alias("pointId"), at("e").alias("r"), at("n").alias("z"))
    return location.lookup(points, raster, 0.0, 1.0, 0.0, 1.0).select(F.col("pointId").alias("stationId"), F.round("seconds", 5).alias("groundM"))
