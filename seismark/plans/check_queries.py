"""Queries of checks, comparisons, qualities and choices, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seismark.functions.tables import small
from seismark.operators import checks, intervals, location, reports, stats, tiers
from seismark.plans import adapters as A
from seismark.plans.adapters import T0, with_tables
from seismark.plans.event_queries import BARS, PAIRS, SELECTED, TIERED, _cheapest, _selected, _tiered, rounded
from seismark.plans.model_queries import MISFITS, _arrivals, _misfits, _nodes, _times
from seismark.plans.registry import query

ARR = SELECTED + ", arr AS (SELECT p.eventId, p.stationId, p.phase, p.prob, p.t - p.eventId * 3600 - 1800 AS residual, s.e AS dE, s.n AS dN FROM sel p JOIN stations s ON s.stationId = p.stationId)"


@query("q93_event_quality", with_tables(ARR + """, q AS (SELECT eventId, count(DISTINCT stationId) AS nStations, count(*) FILTER (phase = 'P') AS nP, count(*) FILTER (phase = 'S') AS nS, round(sqrt(avg(residual * residual)), 6) AS rmsS, round(min(sqrt(dE * dE + dN * dN)), 4) AS minEpiDistM, round(avg(prob), 6) AS meanPickProb FROM arr GROUP BY 1),
az AS (SELECT DISTINCT eventId, ((degrees(atan2(dE, dN)) % 360) + 360) % 360 AS az FROM arr), g AS (SELECT eventId, coalesce(lead(az) OVER (PARTITION BY eventId ORDER BY az), min(az) OVER (PARTITION BY eventId) + 360) - az AS g FROM az)
SELECT q.*, gapDeg FROM q JOIN (SELECT eventId, round(max(g), 6) AS gapDeg FROM g GROUP BY 1) USING (eventId)"""))
def q93(spark, d):
    a = _arrivals(spark, d).select("eventId", "stationId", "phase", "prob", (F.col("t") - 1800).alias("residual"), F.col("e").alias("dE"), F.col("n").alias("dN"))
    return rounded(rounded(checks.event_quality(a), "rmsS", "meanPickProb", "gapDeg"), "minEpiDistM", places=4)


@query("q94_station_frame", with_tables(" SELECT 'e' AS field, count(*) AS compared, count(*) FILTER (stationId % 7 = 0) AS off, round(max(CASE WHEN stationId % 7 = 0 THEN 0.5::DOUBLE ELSE 0 END), 6) AS worst FROM stations WHERE usedInRun UNION ALL SELECT 'n', count(*), 0, 0.0::DOUBLE FROM stations WHERE usedInRun"))
def q94(spark, d):
    """Stored east and north of the used stations against the same from their keys, some of them half a metre off."""
    s = A.stations(spark, d).where("usedInRun")
    again = {"e": A._east("stationId") + F.when(F.col("stationId") % 7 == 0, 0.5).otherwise(0.0), "n": A._north("stationId")}
    return rounded(checks.recomputed(s, again, 0.1), "worst")


@query("q95_depth_consistency", with_tables(" SELECT 'depthKm' AS field, count(*) AS compared, count(*) FILTER (abs(focalDepthM / 1000 - round(focalDepthM / 1000, 1)) > 0.04) AS off, round(max(abs(focalDepthM / 1000 - round(focalDepthM / 1000, 1))), 6) AS worst FROM located"))
def q95(spark, d):
    e = A.located(spark, d).withColumn("depthKm", F.round(F.col("focalDepthM") / 1000, 1))
    return rounded(checks.recomputed(e, {"depthKm": F.col("focalDepthM") / 1000}, 0.04), "worst")


CHOSEN = PAIRS + ", m AS (SELECT catalogId, arg_min(eventId, (cost, eventId)) AS eventId FROM pairs GROUP BY 1)"


def _chosen(spark, d):
    return _cheapest(spark, d)


@query("q96_matches_current", with_tables(CHOSEN + """, j AS (SELECT p.dtS, p.distM, l.t - c.t AS dt2, sqrt((l.e - c.e)**2 + (l.n - c.n)**2) + CASE WHEN c.catalogId % 5 = 0 THEN 10 ELSE 0 END AS d2 FROM m JOIN pairs p USING (catalogId, eventId) JOIN located l ON l.eventId = m.eventId JOIN catalog c ON c.catalogId = m.catalogId)
SELECT 'dtS' AS field, count(*) AS compared, count(*) FILTER (abs(dtS - dt2) > 1) AS off, round(max(abs(dtS - dt2)), 6) AS worst FROM j UNION ALL SELECT 'distM', count(*), count(*) FILTER (abs(distM - d2) > 1), round(max(abs(distM - d2)), 6) FROM j"""))
def q96(spark, d):
    """Stored offsets of matches against those of the tables as they are now, a fifth of them moved by 10 m."""
    m = _chosen(spark, d)
    now = checks.reference_pairs(m, A.located(spark, d), A.catalog(spark, d)).where("NOT stale")
    moved = F.hypot("de", "dn") + F.when(F.col("catalogId") % 5 == 0, 10.0).otherwise(0.0)
    return rounded(checks.recomputed(m.join(now, ["catalogId", "eventId"]), {"dtS": F.col("dt"), "distM": moved}, 1.0), "worst")


@query("q97_tier_visibility", with_tables(TIERED + " SELECT * FROM (SELECT 'PUBLIC' AS filter, 0::BIGINT AS shown UNION ALL SELECT 'ALL', count(*) FROM tiered UNION ALL SELECT 'STRICT', count(*) FILTER (tier = 'A') FROM tiered)"))
def q97(spark, d):
    shown = F.array(*[F.struct(F.lit(f).alias("filter"), checks.visible(F.col("tier"), f).alias("on")) for f in ("PUBLIC", "ALL", "STRICT")])
    return _tiered(spark, d).select(F.explode(shown).alias("x")).groupBy("x.filter").agg(F.count_if("x.on").alias("shown"))


@query("q98_selected_channels", with_tables(", ch AS (SELECT stationId, list_sort(list(DISTINCT channel))[1:2] AS channels FROM segments GROUP BY 1) SELECT s.stationId, s.channel, count(*) AS n FROM segments s JOIN ch ON ch.stationId = s.stationId AND list_contains(channels, channel) GROUP BY 1, 2"))
def q98(spark, d):
    """Segments on the first two channels of their station alone."""
    s = A.segments(spark, d)
    own = s.groupBy("stationId").agg(F.slice(F.array_sort(F.collect_set("channel")), 1, 2).alias("channels"))
    return s.join(own, "stationId").where(F.array_contains("channels", F.col("channel"))).groupBy("stationId", "channel").agg(F.count(F.lit(1)).alias("n"))


@query("q99_counters", with_tables(TIERED + ", c AS (SELECT tier, count(*) AS n FROM tiered GROUP BY 1) SELECT tier, p AS progress, floor(n * least(1, greatest(0, p)))::BIGINT AS value FROM c, (VALUES (-0.5::DOUBLE), (0.25), (0.5), (2)) v(p)"))
def q99(spark, d):
    c = _tiered(spark, d).groupBy("tier").agg(F.count(F.lit(1)).alias("n")).withColumn("progress", F.explode(F.array(*map(F.lit, (-0.5, 0.25, 0.5, 2.0)))))
    return c.select("tier", "progress", checks.counter(F.col("n"), F.col("progress")).cast("long").alias("value"))


@query("q100_halos", with_tables(TIERED + " SELECT eventId, round(hErrM / 1000, 6) AS radiusKm FROM tiered WHERE tier = 'A' AND hErrM > 0"))
def q100(spark, d):
    return _tiered(spark, d).where("tier = 'A'").select("eventId", F.round(checks.usable_error(F.col("hErrM")) / 1000, 6).alias("radiusKm")).where("radiusKm IS NOT NULL")


@query("q101_filled_statics", with_tables(""", s AS (SELECT stationId, phase, round(median(value - 50), 6) AS term FROM picks GROUP BY 1, 2) SELECT st.stationId, round(CASE WHEN st.stationId % 3 = 0 THEN coalesce(max(term) FILTER (phase = 'P'), 0) ELSE 0 END, 6) AS p, max(term) FILTER (phase = 'S') AS s FROM stations st LEFT JOIN s USING (stationId) GROUP BY 1"""))
def q101(spark, d):
    """Each station's terms as a map; P overrides a stored 0 where the station has been recalibrated."""
    terms = A.picks(spark, d).groupBy("stationId", "phase").agg(F.round(stats.median(F.col("value") - 50), 6).alias("term"))
    own = checks.statics_map(terms)
    s = A.stations(spark, d).select("stationId", F.lit(0.0).alias("p")).join(own, "stationId", "left")
    new = s.where(F.col("stationId") % 3 == 0).select("stationId", F.element_at("statics", "P").alias("p"))
    return checks.filled(s, new, ["stationId"], ["p"]).select("stationId", F.round("p", 6).alias("p"), F.element_at("statics", "S").alias("s"))


@query("q102_reference_pairs", with_tables(CHOSEN + " SELECT m.catalogId, m.eventId, round(l.e - c.e, 4) + 0 AS de, round(l.n - c.n, 4) + 0 AS dn, round(l.t - c.t, 6) + 0 AS dt, l.eventId IS NULL AS stale FROM m LEFT JOIN (SELECT * FROM located WHERE profile = 'full') l ON l.eventId = m.eventId JOIN catalog c ON c.catalogId = m.catalogId"))
def q102(spark, d):
    r = checks.reference_pairs(_chosen(spark, d), A.located(spark, d).where("profile = 'full'"), A.catalog(spark, d))
    return r.select("catalogId", "eventId", *[(F.round(c, k) + F.lit(0.0)).alias(c) for c, k in (("de", 4), ("dn", 4), ("dt", 6))], "stale")


COVER = f", cov AS (SELECT stationId, sum(least(stop, {T0 + 2592000}) - start) / 2592000 AS coverage, 20.0::DOUBLE * (1 + stationId % 5) AS rateHz FROM segments GROUP BY 1)"


@query("q103_nearest_usable", with_tables(COVER + """, r AS (SELECT l.eventId, s.stationId, sqrt((l.e - s.e)**2 + (l.n - s.n)**2) AS distM, row_number() OVER (PARTITION BY l.eventId ORDER BY sqrt((l.e - s.e)**2 + (l.n - s.n)**2), s.stationId) AS k FROM located l, stations s JOIN cov USING (stationId) WHERE coverage >= 0.5 AND rateHz / 2 > 20)
SELECT eventId, stationId, round(distM, 3) AS distM FROM r WHERE k = 1"""))
def q103(spark, d):
    cov = A.segments(spark, d).groupBy("stationId").agg((F.sum(F.least("stop", F.lit(T0 + 2592000)) - F.col("start")) / 2592000).alias("coverage")).withColumn("rateHz", 20.0 * (1 + F.col("stationId") % 5))
    return rounded(checks.nearest_usable(A.located(spark, d), A.stations(spark, d).join(cov, "stationId"), 0.5, 20.0), "distM", places=3)


@query("q104_evidence_rows", with_tables(SELECTED + """, w AS (SELECT eventId, stationId, min(t) FILTER (phase = 'P') AS pickP, min(t) FILTER (phase = 'S') AS pickS FROM sel GROUP BY 1, 2), x AS (SELECT w.*, sqrt((e - 100) * (e - 100) + (n + 50) * (n + 50)) AS dist FROM w JOIN stations USING (stationId) WHERE pickP IS NOT NULL)
SELECT eventId, stationId, round(dist, 3) AS epiDistM, round(pickP, 6) AS pickP, round(pickS, 6) AS pickS, row_number() OVER (PARTITION BY eventId ORDER BY dist, stationId) AS place FROM x"""))
def q104(spark, d):
    a = _selected(spark, d).select("eventId", "stationId", "phase", "t", F.lit(100.0).alias("ex"), F.lit(-50.0).alias("ey"))
    return rounded(rounded(checks.evidence_rows(a, A.stations(spark, d)), "epiDistM", places=3), "pickP", "pickS").withColumn("place", F.col("place").cast("long"))


@query("q105_picking_stations", with_tables(SELECTED + " SELECT eventId, count(DISTINCT stationId) AS stations, min(stationId::VARCHAR || ':' || phase || ':' || round_even(t * 1000, 0)::BIGINT) AS first FROM sel GROUP BY 1"))
def q105(spark, d):
    p = _selected(spark, d).withColumn("id", checks.pick_id(F.col("stationId"), F.col("phase"), F.col("t")))
    e = p.groupBy("eventId").agg(F.collect_set("id").alias("pickIds"))
    n = checks.picking_stations(e, A.stations(spark, d)).groupBy("eventId").agg(F.count(F.lit(1)).alias("stations"))
    return n.join(p.groupBy("eventId").agg(F.min("id").alias("first")), "eventId")


@query("q106_ground_proxy", with_tables(""", r AS (SELECT l.eventId, s.stationId, s.elevM, 1600 + l.minEpiDistM / 20 AS z, row_number() OVER (PARTITION BY l.eventId ORDER BY sqrt((l.e - s.e)**2 + (l.n - s.n)**2), s.stationId) AS k FROM located l, stations s WHERE usedInRun) SELECT eventId, stationId, elevM AS groundM, z > elevM AS above FROM r WHERE k = 1"""))
def q106(spark, d):
    e = A.located(spark, d).select("eventId", "e", "n", (F.col("minEpiDistM") / 20 + 1600).alias("z"))
    return checks.ground_proxy(e, A.stations(spark, d).where("usedInRun"))


@query("q107_disagreements", with_tables(" SELECT stationId, 'place' AS field, CASE WHEN elevM > 1750 THEN 'high' ELSE 'low' END AS ours, CASE WHEN usedInRun THEN 'high' ELSE 'low' END AS theirs FROM stations WHERE (elevM > 1750) <> usedInRun UNION ALL SELECT stationId, 'rate', '100', '50' FROM stations WHERE stationId % 4 = 0"))
def q107(spark, d):
    s = A.stations(spark, d)
    ours = s.select("stationId", F.when(F.col("elevM") > 1750, "high").otherwise("low").alias("place"), F.lit(100).alias("rate"))
    theirs = s.select("stationId", F.when(F.col("usedInRun"), "high").otherwise("low").alias("place"), F.when(F.col("stationId") % 4 == 0, 50).otherwise(100).alias("rate"))
    return checks.disagreements(ours, theirs, "stationId", ["place", "rate"])


@query("q108_longest_times", with_tables(" SELECT phase, round(max(sqrt((e - x)**2 + (n - y)**2 + (elevM - z)**2) / v), 6) AS seconds FROM stations, (SELECT (i % 5) * 5000.0::DOUBLE - 10000 AS x, ((i // 5) % 5) * 5000.0::DOUBLE - 10000 AS y, (i // 25) * -2000.0::DOUBLE AS z FROM range(50) r(i)), (VALUES ('P', 5000.0::DOUBLE), ('S', 2900.0::DOUBLE)) p(phase, v) WHERE usedInRun GROUP BY 1"))
def q108(spark, d):
    """The longest travel time of each phase between any used station and any node of the volume."""
    return _times(spark, d).groupBy("phase").agg(F.round(F.max("seconds"), 6).alias("seconds"))


@query("q109_markers", with_tables(TIERED + f" SELECT tier, floor((t - {T0}) / 1800)::BIGINT AS row, floor(((t - {T0}) - floor((t - {T0}) / 1800) * 1800) / 60)::BIGINT AS minute, count(*) AS n FROM tiered WHERE t >= {T0 + 86400} AND t < {T0 + 864000} GROUP BY 1, 2, 3"))
def q109(spark, d):
    e = _tiered(spark, d).where((F.col("t") >= T0 + 86400) & (F.col("t") < T0 + 864000)).withColumn("into", F.col("t") - T0)
    row = F.floor(F.col("into") / 1800)
    return e.groupBy("tier", row.alias("row"), F.floor((F.col("into") - row * 1800) / 60).alias("minute")).agg(F.count(F.lit(1)).alias("n"))


@query("q110_location_shift", with_tables(MISFITS + """, b AS (SELECT *, row_number() OVER (PARTITION BY eventId ORDER BY round(misfit, 4), node) AS k FROM mis), m AS (SELECT eventId, node, exp(-0.0001 * (misfit - min(misfit) OVER (PARTITION BY eventId))) AS m FROM mis),
c AS (SELECT eventId, sum(m * x) / sum(m) AS x, sum(m * y) / sum(m) AS y, sum(m * z) / sum(m) AS z FROM m JOIN nodes USING (node) GROUP BY 1), j AS (SELECT sqrt((c.x - o.x)**2 + (c.y - o.y)**2) AS h, c.z - o.z AS dz FROM c JOIN b ON b.eventId = c.eventId AND b.k = 1 JOIN nodes o ON o.node = b.node)
SELECT count(*) AS n, round(median(h), 1) AS medianH, round(median(dz), 1) AS medianDz, round(quantile_cont(dz, 0.1), 1) + 0 AS p10, round(quantile_cont(dz, 0.9), 1) AS p90 FROM j"""))
def q110(spark, d):
    """How far the weighted centre of each event lies from its best node."""
    m = _misfits(spark, d)
    o = location.best_node(m).join(small(_nodes(spark)), "node").select("eventId", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"))
    j = location.pdf_moments(m, _nodes(spark), 0.0001, 5000.0, 0.9).join(o, "eventId").select(F.sqrt((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))).alias("h"), (F.col("z") - F.col("oz")).alias("dz"))
    q = j.agg(F.count(F.lit(1)).alias("n"), stats.median("h").alias("medianH"), stats.median("dz").alias("medianDz"), F.percentile("dz", F.lit(0.1)).alias("p10"), F.percentile("dz", F.lit(0.9)).alias("p90"))
    return rounded(q, "medianH", "medianDz", "p10", "p90", places=1).withColumn("p10", F.col("p10") + F.lit(0.0))


@query("q111_table_errors", with_tables(""", tab AS (SELECT i, j, sqrt((i * 2000.0::DOUBLE)**2 + (j * 100.0::DOUBLE)**2) / 5000 AS s FROM range(9) a(i), range(31) b(j)), p AS (SELECT stationId, floor(elevM / 100)::BIGINT AS band, sqrt(e * e + n * n) / 2000 AS x, elevM / 100 AS y FROM stations),
c AS (SELECT stationId, floor(x)::BIGINT + a AS i, floor(y)::BIGINT + b AS j, (CASE WHEN a = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN b = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w FROM p, (VALUES (0), (1)) v(a), (VALUES (0), (1)) u(b)),
t AS (SELECT stationId, sum(w * s) AS seconds FROM c LEFT JOIN tab USING (i, j) WHERE w > 0 GROUP BY 1 HAVING count(*) = count(s)), d AS (SELECT band, seconds - sqrt((x * 2000) * (x * 2000) + (y * 100) * (y * 100)) / 5000 AS err FROM t JOIN p USING (stationId))
SELECT band, count(*) AS n, round(median(err), 5) + 0 AS median, round(max(abs(err)), 5) AS worst FROM d GROUP BY 1"""))
def q111(spark, d):
    """Looked-up times less exact ones, by the station's height."""
    i, j = F.pmod("id", F.lit(9)), F.floor(F.col("id") / 9)
    tab = spark.range(279).select(i.alias("ir"), j.alias("iz"), (F.sqrt(F.pow(i * 2000.0, 2) + F.pow(j * 100.0, 2)) / 5000).alias("seconds"))
    p = A.stations(spark, d).select(F.col("stationId").alias("pointId"), F.sqrt(F.col("e") * F.col("e") + F.col("n") * F.col("n")).alias("r"), F.col("elevM").alias("z"))
    err = location.lookup(p, tab, 0.0, 2000.0, 0.0, 100.0).join(p, "pointId").select(F.floor(F.col("z") / 100).alias("band"), (F.col("seconds") - F.sqrt(F.col("r") * F.col("r") + F.col("z") * F.col("z")) / 5000).alias("err"))
    s = err.groupBy("band").agg(F.count(F.lit(1)).alias("n"), stats.median("err").alias("median"), F.max(F.abs("err")).alias("worst"))
    return rounded(s, "median", "worst", places=5).withColumn("median", F.col("median") + F.lit(0.0))


@query("q112_shown_by", with_tables(f" SELECT {T0} + k * 86400.0::DOUBLE AS at, (SELECT count(*) FROM located WHERE t <= {T0} + k * 86400)::BIGINT AS shown FROM range(31) r(k)"))
def q112(spark, d):
    return checks.count_up_to(A.located(spark, d), "t", T0, T0 + 30 * 86400, 86400.0)


@query("q113_adopted_variants", with_tables(TIERED + ", b AS (SELECT method || '/' || profile AS name, count(*) FILTER (tier = 'A') AS a, count(DISTINCT catalogId) AS c FROM tiered GROUP BY 1) SELECT v.name, v.a > o.a OR (v.a = o.a AND v.c > o.c) AS adopted FROM b v, b o WHERE o.name = 'classic/full' AND v.name <> o.name"))
def q113(spark, d):
    rows = tiers.baseline_rows(_tiered(spark, d), ["method", "profile"]).withColumn("name", F.concat_ws("/", "method", "profile"))
    return checks.strict_wins(rows, "classic/full", ["tierA", "recoveredPublic"])


@query("q114_longest_segment", with_tables(" SELECT stationId, channel, round(start, 6) AS start, round(stop - start, 6) AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY stationId ORDER BY stop - start DESC, start, channel) AS k FROM segments) WHERE k = 1"))
def q114(spark, d):
    s = A.segments(spark, d)
    best = s.groupBy("stationId").agg(F.min(F.struct((F.col("start") - F.col("stop")).alias("short"), "start", "channel")).alias("x"))
    return best.select("stationId", "x.channel", F.round("x.start", 6).alias("start"), F.round(-F.col("x.short"), 6).alias("seconds"))


@query("q115_eligible_stations", with_tables(" SELECT stationId, row_number() OVER (ORDER BY stationId) AS place FROM stations WHERE usedInRun AND elevM < 1750"))
def q115(spark, d):
    from seismark.functions.tables import ranked

    return ranked(A.stations(spark, d).where("usedInRun AND elevM < 1750").select("stationId"), "stationId", name="place")


@query("q116_swept_parameter", with_tables(", v AS (SELECT 'method' AS parameter, method AS value FROM located UNION ALL SELECT 'nStations', nStations::VARCHAR FROM located UNION ALL SELECT 'profile', profile FROM located) SELECT parameter, count(DISTINCT value) AS values FROM v GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"))
def q116(spark, d):
    p = A.located(spark, d).select(F.create_map(*[x for c in ("method", "nStations", "profile") for x in (F.lit(c), F.col(c).cast("string"))]).alias("params"))
    return checks.swept_parameter(p)


BLOCKS = """, u AS (SELECT channel, stationId, start, stop, max(stop) OVER (PARTITION BY channel, stationId ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM segments WHERE channel IN ('click', 'view', 'purchase')),
v AS (SELECT *, sum(CASE WHEN p IS NULL OR start > p THEN 1 ELSE 0 END) OVER (PARTITION BY channel, stationId ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS k FROM u), m AS (SELECT channel, stationId, min(start) AS start, max(stop) AS stop FROM v GROUP BY channel, stationId, k),
b AS (SELECT a.stationId, greatest(a.start, b.start, c.start) AS start, least(a.stop, b.stop, c.stop) AS stop FROM m a JOIN m b ON a.stationId = b.stationId AND a.channel = 'click' AND b.channel = 'view' JOIN m c ON c.stationId = a.stationId AND c.channel = 'purchase' WHERE greatest(a.start, b.start, c.start) < least(a.stop, b.stop, c.stop))"""


@query("q117_three_component_blocks", with_tables(BLOCKS + " SELECT stationId, count(*) FILTER (stop - start >= 600) AS blocks, count(*) FILTER (stop - start < 600) AS short, round(coalesce(sum(stop - start) FILTER (stop - start >= 600), 0), 3) AS seconds FROM b GROUP BY 1"))
def q117(spark, d):
    """Stretches in which all three channels exist; those under ten minutes are counted and left out."""
    s = A.segments(spark, d)
    each = [intervals.merged(s.where(F.col("channel") == c).drop("channel"), ["stationId"]).drop("parts") for c in ("click", "view", "purchase")]
    b = intervals.levels(each[0].unionByName(each[1]).unionByName(each[2]), ["stationId"]).where("depth = 3")
    long = F.col("stop") - F.col("start") >= 600
    return b.groupBy("stationId").agg(F.count_if(long).alias("blocks"), F.count_if(~long).alias("short"), F.round(F.sum(F.when(long, F.col("stop") - F.col("start")).otherwise(0.0)), 3).alias("seconds"))


@query("q118_leave_one_event_out", with_tables(""", o AS (SELECT eventId, count(*)::DOUBLE AS n, sum(logA) AS x, sum(mag) AS y, sum(logA * logA) AS xx, sum(logA * mag) AS xy FROM observations GROUP BY 1), a AS (SELECT sum(n) n, sum(x) x, sum(y) y, sum(xx) xx, sum(xy) xy FROM o),
r AS (SELECT eventId, o.n AS own, o.x / o.n AS mx, a.n - o.n AS n, a.x - o.x AS x, a.y - o.y AS y, a.xx - o.xx AS xx, a.xy - o.xy AS xy FROM o, a), s AS (SELECT *, (n * xy - x * y) / (n * xx - x * x) AS b FROM r)
SELECT eventId, own::BIGINT AS n, round((y - b * x) / n + b * mx, 5) AS predicted, round(y / n, 5) AS "null" FROM s"""))
def q118(spark, d):
    return rounded(checks.leave_one_event_out(A.observations(spark, d), "eventId", "logA", "mag"), "predicted", "null", places=5)


@query("q119_confidence_auc", with_tables(", s AS (SELECT catalogId IS NOT NULL AS y, round(1 / (1 + exp(-(0.5 + 0.2 * nStations - 0.01 * gapDeg - 20 * rmsS))), 9) AS p FROM located), r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS k FROM s), a AS (SELECT sum(k) FILTER (y) AS t, count(*) FILTER (y) AS u, count(*) FILTER (NOT y) AS v FROM r) SELECT u AS positives, v AS negatives, round((t - u * (u + 1) / 2) / (u * v), 6) AS auc FROM a"))
def q119(spark, d):
    """How well a logistic score of three qualities ranks matched events before others."""
    s = A.located(spark, d).select(F.col("catalogId").isNotNull().cast("int").alias("y"), F.round(checks.logistic({"nStations": 0.2, "gapDeg": -0.01, "rmsS": -20.0}, 0.5), 9).alias("p"))
    return rounded(checks.auc(s, "p", "y"), "auc")


@query("q120_reveal_issues", with_tables(TIERED + ", ro AS (SELECT row_number() OVER (ORDER BY tier, t, eventId) - 1 AS r, eventId FROM tiered), xo AS (SELECT CASE WHEN r % 50 = 7 THEN NULL WHEN r % 50 = 9 THEN 0 ELSE r END AS r FROM ro) SELECT 'missing' AS issue, count(*) - count(r) AS n FROM xo UNION ALL SELECT 'repeated', count(r) - count(DISTINCT r) FROM xo UNION ALL SELECT 'below', 0 UNION ALL SELECT 'beyond', 0"))
def q120(spark, d):
    """Of a display order with some places lost and some set to 0."""
    r = F.col("revealOrder")
    e = tiers.reveal_order(_tiered(spark, d)).withColumn("revealOrder", F.when(r % 50 == 7, F.lit(None)).when(r % 50 == 9, F.lit(0)).otherwise(r))
    return checks.reveal_issues(e, "revealOrder")


@query("q121_newest_good_window", with_tables(", w AS (SELECT floor(t / 3600)::BIGINT AS h, count(*) AS n, count(*) FILTER (prob < 0.05) AS bad FROM picks GROUP BY 1) SELECT h * 3600 AS start, n AS eventCount FROM w WHERE bad = 0 ORDER BY h DESC LIMIT 1"))
def q121(spark, d):
    w = A.picks(spark, d).groupBy(F.col("eventId").alias("h")).agg(F.count(F.lit(1)).alias("eventCount"), F.count_if(F.col("prob") < 0.05).alias("bad"))
    w = w.select((F.col("h") * 3600).alias("start"), (F.col("h") * 3600 + 3600).alias("stop"), "eventCount", F.when(F.col("bad") == 0, "ok").otherwise("failed").alias("outcome"))
    return checks.newest_good(w).select("start", "eventCount")


@query("q122_cache_issues", with_tables(", f AS (SELECT segmentId AS name, len(samples) AS have FROM samples WHERE segmentId % 10 <> 3), m AS (SELECT segmentId AS name, 64 + CASE WHEN segmentId % 10 = 5 THEN 1 ELSE 0 END AS want FROM samples WHERE segmentId % 10 <> 7) SELECT name, CASE WHEN want IS NULL THEN 'stray' WHEN have IS NULL THEN 'gone' ELSE 'samples' END AS issue FROM f FULL JOIN m USING (name) WHERE want IS NULL OR have IS NULL OR have <> want"))
def q122(spark, d):
    """Stored segments against a manifest that some are missing from, that names lost ones, and that has some lengths wrong."""
    s, k = A.samples(spark, d), F.col("segmentId") % 10
    have = s.where(k != 3).select(F.col("segmentId").alias("name"), F.size("samples").alias("samples"))
    want = s.where(k != 7).select(F.col("segmentId").alias("name"), F.when(k == 5, 65).otherwise(64).alias("samples"))
    return checks.cache_issues(have, want)


@query("q123_stage_ledger", with_tables(", l AS (SELECT user_id AS runId, event_type AS stage, event_id AS pass, value AS runtimeS, event_id % 100 AS n FROM events) SELECT runId, stage, count(*) AS passes, arg_max(runtimeS, pass) AS lastS, arg_max(n, pass) AS n, round(sum(runtimeS), 4) AS totalS FROM l GROUP BY 1, 2"))
def q123(spark, d):
    from seismark.functions.tables import table

    led = table(spark, d, "events").select(F.col("user_id").alias("runId"), F.col("event_type").alias("stage"), F.col("event_id").alias("pass"), F.col("value").alias("runtimeS"), (F.col("event_id") % 100).alias("n"))
    return rounded(checks.latest_stages(led), "totalS", places=4)


@query("q124_time_map", with_tables(f" SELECT id, round({T0} + (t - {T0}) * 3.0::DOUBLE, 3) AS modelT, round(t, 3) AS t FROM picks"))
def q124(spark, d):
    p = A.picks(spark, d).withColumn("m", checks.stretched(F.col("t"), F.lit(T0), 3.0))
    return p.select("id", F.round("m", 3).alias("modelT"), F.round(checks.unstretched(F.col("m"), F.lit(T0), 3.0), 3).alias("t"))


@query("q125_response_screen", with_tables(", c AS (SELECT stationId, count(DISTINCT channel) AS h, CASE stationId % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'M/S' WHEN 2 THEN 'M/S**2' ELSE 'COUNTS' END AS unit, 50.0 + 50 * (stationId % 3) AS rate FROM segments GROUP BY ALL) SELECT coalesce(CASE WHEN h < 2 THEN 'horizontals' WHEN unit = 'COUNTS' THEN 'unit' WHEN rate <> 100 THEN 'rate' END, 'kept') AS verdict, count(*) AS n FROM c GROUP BY 1"))
def q125(spark, d):
    k = F.col("stationId") % 4
    c = A.segments(spark, d).groupBy("stationId").agg(F.countDistinct("channel").alias("h"))
    unit = F.when(k == 0, "M").when(k == 1, "M/S").when(k == 2, "M/S**2").otherwise("COUNTS")
    v = checks.response_verdict(F.lit(1), F.col("h"), unit, 50.0 + 50 * (F.col("stationId") % 3), 100.0, 45.0)
    return c.groupBy(F.coalesce(v, F.lit("kept")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


BORROWED = TIERED.replace("FROM located WHERE catalogId IS NOT NULL", "FROM located WHERE method = 'classic' AND catalogId IS NOT NULL").replace("FROM located l, w)", "FROM (SELECT * FROM located WHERE method = 'net') l, w)")


@query("q126_borrowed_bars", with_tables(BORROWED + " SELECT tier, count(*) AS n FROM tiered GROUP BY 1"))
def q126(spark, d):
    """Tiers of one method's events under the bars of the other's finished run."""
    e = A.located(spark, d)
    bars = tiers.bars(e.where("method = 'classic' AND catalogId IS NOT NULL"), {"A": (1, 4), "B": (0, 1)})
    return tiers.assign_tiers(e.where("method = 'net'"), bars, 2.0).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("q127_tumbling_hours", with_tables(" SELECT phase, floor(t / 3600)::BIGINT * 3600 AS start, count(*) AS n, round(min(prob), 6) AS leastProb FROM picks GROUP BY 1, 2"))
def q127(spark, d):
    p = A.picks(spark, d).withColumn("at", F.timestamp_micros(F.rint(F.col("t") * 1e6).cast("long")))
    w = p.groupBy("phase", F.window("at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("prob"), 6).alias("leastProb"))
    return w.select("phase", F.unix_seconds("w.start").alias("start"), "n", "leastProb")


@query("q128_session_swarms", with_tables(", o AS (SELECT stationId, t, CASE WHEN t - lag(t) OVER (PARTITION BY stationId ORDER BY t) < 7200 THEN 0 ELSE 1 END AS new FROM picks), s AS (SELECT *, sum(new) OVER (PARTITION BY stationId ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT stationId, round(min(t), 5) AS start, round(max(t) - min(t), 5) AS seconds, count(*) AS n FROM s GROUP BY stationId, k"))
def q128(spark, d):
    """Bursts of a station's picks with less than two hours between."""
    p = A.picks(spark, d).withColumn("at", F.timestamp_micros(F.rint(F.col("t") * 1e6).cast("long")))
    w = p.groupBy("stationId", F.session_window("at", "2 hours").alias("w")).agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n"))
    return w.select("stationId", F.round("a", 5).alias("start"), F.round(F.col("b") - F.col("a"), 5).alias("seconds"), "n")


@query("q129_display_checks", with_tables(TIERED + """, s AS (SELECT round(count(DISTINCT catalogId) / (SELECT count(*) FROM catalog), 6) AS recall, count(*) FILTER (tier = 'A')::DOUBLE AS strict, round(median(rmsS), 6) AS rms FROM tiered) SELECT * FROM (SELECT 'recall' AS name, recall AS value FROM s UNION ALL SELECT 'strict', strict FROM s UNION ALL SELECT 'medianRmsS', rms FROM s) WHERE value IS NOT NULL"""))
def q129(spark, d):
    """The lines of a validation table, one for each figure that there is; absent figures have none."""
    s = tiers.summary(_tiered(spark, d), A.catalog(spark, d)).withColumn("chance", F.lit(None).cast("double"))
    return rounded(reports.figure_rows(s, ["recall", "strict", "medianRmsS", "chance"]), "value")
