"""The event operators over the logical tables, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import functions as F

from seismark.functions.tables import small
from seismark.operators import geometry, intervals, joins, picks, stats, tiers
from seismark.plans import adapters as A
from seismark.plans.adapters import T0, T1, with_tables
from seismark.plans.registry import query

MIN_PROB = 0.1
MINIMUMS = {"nPicks": 6, "nStations": 4, "nP": 2, "nS": 1}


def rounded(df, *columns: str, places: int = 6):
    return df.withColumns({c: F.round(c, places) for c in columns})


def _selected(spark, d):
    return picks.select_picks(A.picks(spark, d), A.stations(spark, d), MIN_PROB)


SELECTED = ", sel AS (SELECT p.* FROM picks p WHERE prob >= 0.1 AND stationId IN (SELECT id FROM stations WHERE usedInRun))"


@query("q01_pick_ledger", with_tables("""
SELECT CASE WHEN s.id IS NULL THEN 'station' WHEN prob < 0.1 THEN 'below' ELSE 'kept' END AS reason, count(*) AS n
FROM picks p LEFT JOIN (SELECT id FROM stations WHERE usedInRun) s ON s.id = p.stationId GROUP BY 1"""))
def q01(spark, d):
    return picks.pick_ledger(A.picks(spark, d), A.stations(spark, d), MIN_PROB)


@query("q02_pick_counts", with_tables(SELECTED + """, st AS (SELECT eventId, stationId, count(*) n, max((phase = 'P')::INT) p, max((phase = 'S')::INT) s FROM sel GROUP BY 1, 2)
SELECT eventId, sum(n)::BIGINT AS nPicks, sum(p)::BIGINT AS nP, sum(s)::BIGINT AS nS, sum(p * s)::BIGINT AS nPS, count(*) AS nStations FROM st GROUP BY 1
HAVING sum(n) >= 6 AND count(*) >= 4 AND sum(p) >= 2 AND sum(s) >= 1"""))
def q02(spark, d):
    return picks.pick_counts(_selected(spark, d)).where(picks.failed_minimum(MINIMUMS).isNull())


@query("q03_minimum_ledger", with_tables(SELECTED + """, st AS (SELECT eventId, stationId, count(*) n, max((phase = 'P')::INT) p, max((phase = 'S')::INT) s FROM sel GROUP BY 1, 2),
ev AS (SELECT eventId, sum(n) np, sum(p) p, sum(s) s, count(*) ns FROM st GROUP BY 1)
SELECT CASE WHEN np < 6 THEN 'nPicks' WHEN ns < 4 THEN 'nStations' WHEN p < 2 THEN 'nP' ELSE 'nS' END AS cause, count(*) AS events FROM ev
WHERE np < 6 OR ns < 4 OR p < 2 OR s < 1 GROUP BY 1"""))
def q03(spark, d):
    return picks.minimum_ledger(_selected(spark, d), MINIMUMS)


GAPS = f""", inside AS (SELECT stationId, channel, greatest(start, {T0}) a, least(stop, {T1}) b FROM segments WHERE stop > {T0} AND start < {T1}
UNION ALL SELECT DISTINCT stationId, channel, {T1}, {T1} FROM segments),
g AS (SELECT *, greatest(coalesce(max(b) OVER (PARTITION BY stationId, channel ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {T0}), {T0}) AS c FROM inside),
gaps AS (SELECT stationId, channel, c AS gapStart, a AS gapEnd FROM g WHERE a - c > 3600)"""


def _gaps(spark, d):
    return intervals.gaps(A.segments(spark, d), ["stationId", "channel"], T0, T1, 3600.0)


@query("q04_gaps", with_tables(GAPS + " SELECT stationId, channel, round(gapStart, 6) AS gapStart, round(gapEnd, 6) AS gapEnd FROM gaps"))
def q04(spark, d):
    return rounded(_gaps(spark, d), "gapStart", "gapEnd")


@query("q05_merged_intervals", with_tables(""", o AS (SELECT *, max(stop) OVER (PARTITION BY stationId ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM segments),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR start > p THEN 1 ELSE 0 END) OVER (PARTITION BY stationId ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT stationId, round(min(start), 6) AS start, round(max(stop), 6) AS stop, count(*) AS parts FROM i GROUP BY stationId, k"""))
def q05(spark, d):
    return rounded(intervals.merged(A.segments(spark, d), ["stationId"]), "start", "stop")


@query("q06_station_coverage", with_tables(GAPS + f""", per AS (SELECT s.stationId, s.channel, coalesce(lost, 0) / {T1 - T0} AS f FROM (SELECT DISTINCT stationId, channel FROM segments) s
LEFT JOIN (SELECT stationId, channel, sum(gapEnd - gapStart) lost FROM gaps GROUP BY 1, 2) g USING (stationId, channel))
SELECT stationId, count(*) AS channels, round(max(f), 6) AS gapFraction, count(*) >= 3 AND max(f) < 0.97 AS useful FROM per GROUP BY 1"""))
def q06(spark, d):
    s = A.segments(spark, d)
    return rounded(intervals.coverage(_gaps(spark, d), s, "stationId", "channel", T0, T1, 3, 0.97), "gapFraction")


@query("q07_keep_tiles", with_tables("""
SELECT floor(t / 3600)::BIGINT AS tile, CASE WHEN t - floor(t / 3600) * 3600 <= 60 OR 3600 - (t - floor(t / 3600) * 3600) <= 60 THEN 'edge' ELSE 'kept' END AS verdict, count(*) AS n FROM picks GROUP BY 1, 2"""))
def q07(spark, d):
    p = A.picks(spark, d)
    return p.groupBy(intervals.tile(F.col("t"), 3600.0).alias("tile"), intervals.pick_in_tile(F.col("t"), 3600.0, 60.0).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


SWEEP = """, steps AS (SELECT stationId, t, sum(d) AS d FROM (SELECT stationId, start AS t, 1 AS d FROM segments UNION ALL SELECT stationId, stop, -1 FROM segments) GROUP BY 1, 2),
lv AS (SELECT stationId, t AS start, lead(t) OVER w AS stop, sum(d) OVER (PARTITION BY stationId ORDER BY t ROWS UNBOUNDED PRECEDING) AS depth FROM steps WINDOW w AS (PARTITION BY stationId ORDER BY t))"""


@query("q08_overlap_levels", with_tables(SWEEP + " SELECT stationId, depth::BIGINT AS depth, round(sum(stop - start), 3) AS seconds, count(*) AS stretches FROM lv WHERE stop IS NOT NULL AND depth > 0 GROUP BY 1, 2"))
def q08(spark, d):
    lv = intervals.levels(A.segments(spark, d), ["stationId"])
    return lv.groupBy("stationId", "depth").agg(F.round(F.sum(F.col("stop") - F.col("start")), 3).alias("seconds"), F.count(F.lit(1)).alias("stretches"))


@query("q09_conflicting_overlaps", with_tables(SWEEP + """, d2 AS (SELECT stationId, start, stop FROM lv WHERE stop IS NOT NULL AND depth >= 2),
o AS (SELECT *, max(stop) OVER (PARTITION BY stationId ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM d2),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR start > p THEN 1 ELSE 0 END) OVER (PARTITION BY stationId ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT stationId, round(min(start), 6) AS start, round(max(stop), 6) AS stop FROM i GROUP BY stationId, k"""))
def q09(spark, d):
    return rounded(intervals.overlaps(A.segments(spark, d), ["stationId"]), "start", "stop")


@query("q10_dedupe_best", with_tables(", r AS (SELECT *, row_number() OVER (PARTITION BY stationId, phase, eventId ORDER BY prob DESC, t, id) AS n FROM picks) SELECT id, stationId, phase, round(t, 6) AS t, prob FROM r WHERE n = 1"))
def q10(spark, d):
    return rounded(picks.dedupe_best(A.picks(spark, d), "stationId", "phase", "eventId").select("id", "stationId", "phase", "t", "prob"), "t")


SHARED = """, a AS (SELECT id AS pickId, eventId + k AS eventId, (eventId + k) * 3600 AS eventT, abs(t - (eventId + k) * 3600 - 1800) + k AS residual FROM sel CROSS JOIN (VALUES (0), (1)) v(k))"""


def _shared(spark, d):
    k = F.explode(F.array(F.lit(0), F.lit(1)))
    s = _selected(spark, d).withColumn("k", k).withColumn("eventId", F.col("eventId") + F.col("k"))
    return s.select(F.col("id").alias("pickId"), "eventId", (F.col("eventId") * 3600).alias("eventT"), (F.abs(F.col("t") - F.col("eventId") * 3600 - 1800) + F.col("k")).alias("residual"))


@query("q11_shared_pick_owner", with_tables(SELECTED + SHARED + """, z AS (SELECT *, count(*) OVER (PARTITION BY eventId) AS size FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY pickId ORDER BY abs(residual), size DESC, eventT, eventId) AS n FROM z) SELECT pickId, eventId, round(residual, 6) AS residual FROM r WHERE n = 1"""))
def q11(spark, d):
    return rounded(picks.resolve_shared(_shared(spark, d)).select("pickId", "eventId", "residual"), "residual")


@query("q12_s_after_p", with_tables("""
SELECT p.stationId, p.id AS pId, round(p.t, 6) AS tP, round(min(s.t), 6) AS tS FROM picks p JOIN picks s ON p.stationId = s.stationId AND p.phase = 'P' AND s.phase = 'S' AND s.t BETWEEN p.t + 60 AND p.t + 7200 GROUP BY 1, 2, 3"""))
def q12(spark, d):
    p = A.picks(spark, d)
    return rounded(joins.s_after_p(p.where("phase = 'P'"), p.where("phase = 'S'"), 60.0, 7200.0), "tP", "tS")


@query("q13_best_phases", with_tables(""", win AS (SELECT event_id AS windowId, stationId, t - 3600 AS a, t + 3600 AS b FROM picks WHERE phase = 'P'),
i AS (SELECT windowId, p.id, p.phase, p.t, p.prob FROM win JOIN picks p ON p.stationId = win.stationId AND p.t BETWEEN a AND b),
pp AS (SELECT *, row_number() OVER (PARTITION BY windowId ORDER BY prob DESC, t, id DESC) n FROM i WHERE phase = 'P'),
rs AS (SELECT *, row_number() OVER (PARTITION BY windowId ORDER BY prob DESC, t, id DESC) n FROM i WHERE phase = 'S'),
ss AS (SELECT i.windowId, i.id, row_number() OVER (PARTITION BY i.windowId ORDER BY i.prob DESC, i.t, i.id DESC) n FROM i JOIN pp ON pp.windowId = i.windowId AND pp.n = 1 WHERE i.phase = 'S' AND i.t > pp.t)
SELECT pp.windowId, pp.id AS pId, ss.id AS sId, rs.t <= pp.t AS violated FROM pp LEFT JOIN ss ON ss.windowId = pp.windowId AND ss.n = 1 LEFT JOIN rs ON rs.windowId = pp.windowId AND rs.n = 1 WHERE pp.n = 1"""))
def q13(spark, d):
    p = A.picks(spark, d)
    w = p.where("phase = 'P'").select(F.col("event_id").alias("windowId"), "stationId", (F.col("t") - 3600).alias("a"), (F.col("t") + 3600).alias("b"))
    return joins.best_phases(w, p, 7200.0)


@query("q14_nearest_edge", with_tables(""", edges AS (SELECT DISTINCT stationId, start AS edge FROM segments WHERE channel = 'error')
SELECT p.stationId, p.id, round(min(abs(p.t - edge)), 6) AS edgeS FROM picks p LEFT JOIN edges e ON e.stationId = p.stationId GROUP BY 1, 2"""))
def q14(spark, d):
    edges = A.segments(spark, d).where("channel = 'error'").select("stationId", F.col("start").alias("edge")).distinct()
    return rounded(joins.nearest_edge(A.picks(spark, d), edges).select("stationId", "id", "edgeS"), "edgeS")


@query("q15_nearest_station", with_tables(""", r AS (SELECT l.eventId, s.stationId, sqrt((l.e - s.e)**2 + (l.n - s.n)**2) AS distM, row_number() OVER (PARTITION BY l.eventId ORDER BY sqrt((l.e - s.e)**2 + (l.n - s.n)**2), s.stationId) AS k FROM located l, stations s WHERE usedInRun)
SELECT eventId, stationId, round(distM, 3) AS distM FROM r WHERE k = 1"""))
def q15(spark, d):
    return rounded(joins.nearest_station(A.located(spark, d), A.stations(spark, d).where("usedInRun")).drop("place"), "distM", places=3)


TERMS = ", terms AS (SELECT stationId, median(value) AS term FROM picks GROUP BY 1)"


@query("q16_knn_median", with_tables(TERMS + """, r AS (SELECT a.stationId, t.term, row_number() OVER (PARTITION BY a.stationId ORDER BY sqrt((a.e - b.e)**2 + (a.n - b.n)**2), b.stationId) AS k
FROM stations a JOIN stations b ON a.stationId <> b.stationId AND sqrt((a.e - b.e)**2 + (a.n - b.n)**2) <= 8000 JOIN terms t ON t.stationId = b.stationId)
SELECT stationId, count(*) AS neighbours, round(median(term), 6) AS medianTerm FROM r WHERE k <= 5 GROUP BY 1"""))
def q16(spark, d):
    terms = A.picks(spark, d).groupBy("stationId").agg(stats.median("value").alias("term"))
    return rounded(joins.neighbour_median(terms, A.stations(spark, d), 5, 8000.0), "medianTerm")


PAIRS = ", pairs AS (SELECT catalogId, eventId, dtS, distM, abs(dtS) / 1800 + distM / 6000 AS cost FROM (SELECT c.catalogId, l.eventId, l.t - c.t AS dtS, sqrt((l.e - c.e)**2 + (l.n - c.n)**2) AS distM FROM (SELECT catalogId, t, e, n FROM catalog) c, (SELECT eventId, t, e, n FROM located) l WHERE abs(l.t - c.t) <= 1800) WHERE distM <= 6000)"


def _pairs(spark, d):
    return joins.with_cost(joins.pair_offsets(A.located(spark, d), A.catalog(spark, d), 1800.0, 6000.0), 1800.0, 6000.0)


def _cheapest(spark, d):
    return joins.cheapest_pairs(A.located(spark, d), A.catalog(spark, d), 1800.0, 6000.0)


@query("q17_catalog_offsets", with_tables(PAIRS + " SELECT catalogId, eventId, round(dtS, 6) AS dtS, round(distM, 3) AS distM FROM pairs"))
def q17(spark, d):
    return rounded(rounded(_pairs(spark, d).drop("cost"), "dtS"), "distM", places=3)


@query("q18_lowest_cost", with_tables(PAIRS + ", r AS (SELECT *, row_number() OVER (PARTITION BY catalogId ORDER BY cost, eventId) AS k FROM pairs) SELECT catalogId, eventId, round(cost, 6) AS cost FROM r WHERE k = 1"))
def q18(spark, d):
    return rounded(_cheapest(spark, d).select("catalogId", "eventId", "cost"), "cost")


@query("q19_sensitivity", with_tables(PAIRS + """ SELECT maxDt, maxDist, count(*) AS admissible, count(DISTINCT catalogId) AS public FROM pairs JOIN (VALUES (600.0::DOUBLE, 3000.0::DOUBLE), (900, 6000), (1800, 2000), (1800, 6000)) v(maxDt, maxDist)
ON abs(dtS) <= maxDt AND distM <= maxDist GROUP BY 1, 2"""))
def q19(spark, d):
    return joins.sensitivity(_pairs(spark, d), [(600.0, 3000.0), (900.0, 6000.0), (1800.0, 2000.0), (1800.0, 6000.0)])


@query("q20_match_one_to_one")
def q20(spark, d):
    return rounded(rounded(joins.match_catalog(A.located(spark, d), A.catalog(spark, d), 1800.0, 6000.0), "dtS"), "distM", places=3)


@query("q21_residual_stats", with_tables(""", m AS (SELECT stationId, phase, median(value) AS med FROM picks GROUP BY 1, 2)
SELECT stationId, phase, count(*) AS n, round(any_value(med), 6) AS median, round(median(abs(value - med)), 6) AS mad, round(sqrt(avg(value * value)), 6) AS rms FROM picks JOIN m USING (stationId, phase) GROUP BY 1, 2"""))
def q21(spark, d):
    return rounded(stats.residual_stats(A.picks(spark, d), ["stationId", "phase"], "value"), "median", "mad", "rms")


@query("q22_robust_sigma", with_tables(""", m AS (SELECT phase, median(value) AS med FROM picks GROUP BY 1)
SELECT phase, round(1.4826 * median(abs(value - med)), 6) AS sigma, round(1.4826 * median(abs(value - med)) / 25, 6) AS ratio FROM picks JOIN m USING (phase) GROUP BY 1"""))
def q22(spark, d):
    return rounded(stats.robust_sigma(A.picks(spark, d), ["phase"], "value", 25.0), "sigma", "ratio")


@query("q23_weighted_median", with_tables(""", g AS (SELECT stationId, value, sum(w) AS w FROM picks WHERE w > 0 GROUP BY 1, 2),
r AS (SELECT *, sum(w) OVER (PARTITION BY stationId ORDER BY value ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY stationId) AS total FROM g)
SELECT stationId, min(value) AS weightedMedian FROM r WHERE 2 * run >= total GROUP BY 1"""))
def q23(spark, d):
    return stats.weighted_median(A.picks(spark, d), ["stationId"], "value", "w")


@query("q24_station_terms", with_tables("""
SELECT stationId, phase, round(median(value - 50), 6) AS raw, count(DISTINCT eventId) AS nEvents, CASE WHEN count(DISTINCT eventId) < 20 THEN 0 ELSE round(greatest(-10, least(10, median(value - 50))), 6) END AS term FROM picks GROUP BY 1, 2"""))
def q24(spark, d):
    p = A.picks(spark, d).withColumn("r", F.col("value") - 50)
    return rounded(stats.station_terms(p, ["stationId", "phase"], "r", "eventId", 10.0, 20), "raw", "term")


BARS = """, long AS (SELECT 'rmsS' AS metric, rmsS AS cost FROM located WHERE catalogId IS NOT NULL UNION ALL SELECT 'gapDeg', gapDeg FROM located WHERE catalogId IS NOT NULL
UNION ALL SELECT 'nStations', -nStations FROM located WHERE catalogId IS NOT NULL UNION ALL SELECT 'hErrM', hErrM FROM located WHERE catalogId IS NOT NULL AND hErrM IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY cost) AS k, count(*) OVER (PARTITION BY metric) AS n FROM long),
bars AS (SELECT tier, metric, n, CASE WHEN metric = 'nStations' THEN -cost ELSE cost END AS bar FROM o, (VALUES ('A', 3, 4), ('B', 1, 1)) q(tier, a, b) WHERE k = greatest(1, (a * n + b - 1) // b))"""
QUANTILES = {"A": (1, 4), "B": (0, 1)}


def _bars(spark, d):
    return tiers.bars(A.located(spark, d).where("catalogId IS NOT NULL"), QUANTILES)


@query("q25_tier_bars", with_tables(BARS + " SELECT tier, metric, n, bar FROM bars"))
def q25(spark, d):
    return _bars(spark, d)


TIERED = BARS + """, w AS (SELECT max(bar) FILTER (tier = 'A' AND metric = 'rmsS') ar, max(bar) FILTER (tier = 'A' AND metric = 'gapDeg') ag, max(bar) FILTER (tier = 'A' AND metric = 'nStations') an, max(bar) FILTER (tier = 'A' AND metric = 'hErrM') ah,
max(bar) FILTER (tier = 'B' AND metric = 'rmsS') br, max(bar) FILTER (tier = 'B' AND metric = 'gapDeg') bg, max(bar) FILTER (tier = 'B' AND metric = 'nStations') bn, max(bar) FILTER (tier = 'B' AND metric = 'hErrM') bh FROM bars),
x AS (SELECT l.*, concat_ws(',', CASE WHEN NOT coalesce(rmsS <= ar, false) THEN 'A:rmsS' END, CASE WHEN NOT coalesce(gapDeg <= ag, false) THEN 'A:gapDeg' END, CASE WHEN NOT coalesce(nStations >= an, false) THEN 'A:nStations' END, CASE WHEN NOT coalesce(hErrM <= ah, false) THEN 'A:hErrM' END,
CASE WHEN depthOnEdge THEN 'A:depthOnEdge' END, CASE WHEN minEpiDistM > 2 * focalDepthM THEN 'A:minEpiDistM' END) AS fa,
concat_ws(',', CASE WHEN NOT coalesce(rmsS <= br, false) THEN 'B:rmsS' END, CASE WHEN NOT coalesce(gapDeg <= bg, false) THEN 'B:gapDeg' END, CASE WHEN NOT coalesce(nStations >= bn, false) THEN 'B:nStations' END, CASE WHEN NOT coalesce(hErrM <= bh, false) THEN 'B:hErrM' END) AS fb FROM located l, w),
tiered AS (SELECT *, CASE WHEN fa = '' THEN 'A' WHEN fb = '' THEN 'B' ELSE 'C' END AS tier FROM x)"""


def _tiered(spark, d):
    return tiers.assign_tiers(A.located(spark, d), _bars(spark, d), 2.0)


@query("q26_tier_assignment", with_tables(TIERED + " SELECT eventId, tier, CASE tier WHEN 'A' THEN '' WHEN 'B' THEN fa ELSE fa || ',' || fb END AS reasons FROM tiered"))
def q26(spark, d):
    return _tiered(spark, d).select("eventId", "tier", F.array_join("tierReasons", ",").alias("reasons"))


@query("q27_summary", with_tables(TIERED + """ SELECT count(*) AS candidates, count(*) FILTER (catalogId IS NULL) AS additional, count(DISTINCT catalogId) AS recovered, count(*) FILTER (tier = 'A') AS strict, count(*) FILTER (tier = 'A' AND catalogId IS NULL) AS strictUnmatched,
round(median(rmsS), 6) AS medianRmsS, median(nStations) AS medianStations, (SELECT count(*) FROM catalog) AS public, round(count(DISTINCT catalogId) / (SELECT count(*) FROM catalog), 6) AS recall FROM tiered"""))
def q27(spark, d):
    return rounded(tiers.summary(_tiered(spark, d), A.catalog(spark, d)), "medianRmsS", "recall")


BASE = TIERED + ", b AS (SELECT method, profile, count(*) AS candidates, count(DISTINCT catalogId) AS recoveredPublic, count(*) FILTER (tier = 'A') AS tierA, count(*) FILTER (tier = 'B') AS tierB, count(*) FILTER (tier = 'C') AS tierC, round(median(rmsS), 6) AS medianRmsS, median(nStations) AS medianStations FROM tiered GROUP BY 1, 2)"


@query("q28_baseline_rows", with_tables(BASE + " SELECT * FROM b"))
def q28(spark, d):
    return rounded(tiers.baseline_rows(_tiered(spark, d), ["method", "profile"]), "medianRmsS")


@query("q29_baseline_gain", with_tables(BASE + """, r AS (SELECT (SELECT tierA FROM b WHERE method = 'net' AND profile = 'full') / nullif((SELECT tierA FROM b WHERE method = 'classic' AND profile = 'full'), 0) AS f, (SELECT tierA FROM b WHERE method = 'net' AND profile = 'p_only') / nullif((SELECT tierA FROM b WHERE method = 'classic' AND profile = 'p_only'), 0) AS p)
SELECT round(CASE WHEN f > 0.5 AND p > 0.5 THEN f END, 6) AS ratio, coalesce(f > 0.5 AND p > 0.5, false) AS claimed FROM r"""))
def q29(spark, d):
    return rounded(tiers.baseline_gain(tiers.baseline_rows(_tiered(spark, d), ["method", "profile"]), "net", "classic", ("full", "p_only"), 0.5), "ratio")


@query("q30_histogram", with_tables(f", k AS (SELECT least(greatest(floor((t - {T0 + 86400}) / 21600), 0), 111)::BIGINT AS bin, count(*) AS n FROM picks GROUP BY 1) SELECT r.range AS bin, coalesce(n, 0) AS n FROM range(112) r LEFT JOIN k ON k.bin = r.range"))
def q30(spark, d):
    return stats.histogram(A.picks(spark, d), "t", T0 + 86400, T1 - 86400, 21600.0)


@query("q31_busiest_bin", with_tables(" SELECT floor(t / 600)::BIGINT AS bin, count(*) AS n FROM picks GROUP BY 1 ORDER BY n DESC, bin LIMIT 1"))
def q31(spark, d):
    return stats.busiest_bin(A.picks(spark, d), "t", 600.0)


@query("q32_gr_cumulative", with_tables(", b AS (SELECT round_even(mag / 0.1, 0)::BIGINT AS k, count(*) AS n FROM catalog GROUP BY 1), r AS (SELECT unnest(generate_series((SELECT min(k) FROM b), (SELECT max(k) FROM b))) AS k) SELECT r.k, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (ORDER BY r.k DESC)::BIGINT AS atLeast FROM r LEFT JOIN b ON b.k = r.k"))
def q32(spark, d):
    return stats.cumulative_counts(A.catalog(spark, d), "mag", 0.1)


MC = ", bins AS (SELECT magType, round_even(mag / 0.1, 0)::BIGINT AS k, count(*) AS n FROM catalog GROUP BY 1, 2), mc AS (SELECT magType, sum(n)::BIGINT AS events, arg_max(k, n * 1000 - k) * 0.1 + 0.2 AS m FROM bins GROUP BY 1)"


@query("q33_completeness", with_tables(MC + " SELECT magType, events, round(CASE WHEN events >= 30 THEN m END, 6) AS mc FROM mc"))
def q33(spark, d):
    return rounded(stats.max_curvature(A.catalog(spark, d), ["magType"], "mag", 0.1, 0.2, 30), "mc")


@query("q34_b_value", with_tables(", a AS (SELECT magType, mag FROM catalog WHERE round_even(mag / 0.1, 0) >= round_even(0.3::DOUBLE / 0.1, 0)), s AS (SELECT magType, count(*) AS n, avg(mag) AS m, var_samp(mag) AS v FROM a GROUP BY 1) SELECT magType, n, round(log10(exp(1)) / (m - 0.25), 6) AS b, round(2.3 * (log10(exp(1)) / (m - 0.25))**2 * sqrt(v / n), 6) AS sigmaB FROM s WHERE n > 1"))
def q34(spark, d):
    return rounded(stats.b_value(A.catalog(spark, d).withColumn("mc", F.lit(0.3)), ["magType"], "mag", "mc", 0.1), "b", "sigmaB")


AZ = ", az AS (SELECT DISTINCT p.eventId, ((degrees(atan2(s.e - c.e, s.n - c.n)) % 360) + 360) % 360 AS az FROM sel p JOIN stations s USING (stationId), (SELECT 0 AS e, 0 AS n) c)"


def _azimuths(spark, d):
    s = A.stations(spark, d).select("stationId", geometry.azimuth(F.col("e"), F.col("n")).alias("az"))
    return _selected(spark, d).join(small(s), "stationId")


@query("q35_azimuthal_gap", with_tables(SELECTED + AZ + """, g AS (SELECT eventId, coalesce(lead(az) OVER (PARTITION BY eventId ORDER BY az), min(az) OVER (PARTITION BY eventId) + 360) - az AS g FROM az) SELECT eventId, round(max(g), 6) AS gapDeg, count(*) AS azimuths FROM g GROUP BY 1"""))
def q35(spark, d):
    return rounded(geometry.azimuthal_gap(_azimuths(spark, d), "eventId", "az"), "gapDeg")


@query("q36_minimum_curvature", with_tables(""", l AS (SELECT *, radians(lag(inc) OVER w) AS i1, radians(lag(azi) OVER w) AS a1, md - lag(md) OVER w AS dm, radians(inc) AS i2, radians(azi) AS a2 FROM surveys WINDOW w AS (PARTITION BY well ORDER BY md)),
c AS (SELECT *, acos(least(1, greatest(-1, cos(i2 - i1) - sin(i1) * sin(i2) * (1 - cos(a2 - a1))))) AS dl FROM l), r AS (SELECT *, dm / 2 * CASE WHEN dl < 1e-6 THEN 1 ELSE 2 / dl * tan(dl / 2) END AS h FROM c)
SELECT well, md, round(coalesce(sum(h * (sin(i1) * cos(a1) + sin(i2) * cos(a2))) OVER w, 0), 4) + 0 AS north, round(coalesce(sum(h * (sin(i1) * sin(a1) + sin(i2) * sin(a2))) OVER w, 0), 4) + 0 AS east, round(coalesce(sum(h * (cos(i1) + cos(i2))) OVER w, 0), 4) + 0 AS tvd FROM r WINDOW w AS (PARTITION BY well ORDER BY md ROWS UNBOUNDED PRECEDING)"""))
def q36(spark, d):
    w = rounded(geometry.minimum_curvature(A.surveys(spark, d), "well"), "north", "east", "tvd", places=4)
    return w.withColumns({c: F.col(c) + F.lit(0.0) for c in ("north", "east", "tvd")})


@query("q37_reveal_order", with_tables(TIERED + " SELECT eventId, tier, row_number() OVER (ORDER BY tier, t, eventId) - 1 AS revealOrder FROM tiered"))
def q37(spark, d):
    return tiers.reveal_order(_tiered(spark, d)).select("eventId", "tier", "revealOrder")


@query("q38_hero", with_tables(TIERED + " SELECT eventId, nStations, round(rmsS, 6) AS rmsS FROM tiered WHERE tier = 'A' ORDER BY nStations DESC, rmsS NULLS LAST, t, eventId LIMIT 1"))
def q38(spark, d):
    return rounded(tiers.hero(_tiered(spark, d)).select("eventId", "nStations", "rmsS"), "rmsS")


@query("q39_spearman", with_tables(""", r AS (SELECT stationId, rank() OVER (PARTITION BY stationId ORDER BY t) + (count(*) OVER (PARTITION BY stationId, t) - 1) / 2 AS x, rank() OVER (PARTITION BY stationId ORDER BY value) + (count(*) OVER (PARTITION BY stationId, value) - 1) / 2 AS y FROM picks)
SELECT stationId, count(*) AS n, CASE WHEN count(*) >= 8 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN round(corr(x, y), 6) END AS rho FROM r GROUP BY 1"""))
def q39(spark, d):
    return rounded(stats.spearman(A.picks(spark, d), ["stationId"], "t", "value", 8), "rho")


@query("q40_azimuth_fit", with_tables(SELECTED + """, a AS (SELECT phase, value AS r, cos(radians(az)) AS c, sin(radians(az)) AS s FROM sel JOIN (SELECT stationId, ((degrees(atan2(e, n)) % 360) + 360) % 360 AS az FROM stations) USING (stationId)),
m AS (SELECT phase, count(*)::DOUBLE n, sum(c) c, sum(s) s, sum(c * c) cc, sum(s * s) ss, sum(c * s) cs, sum(r) r, sum(r * c) rc, sum(r * s) rs FROM a GROUP BY 1),
q AS (SELECT *, n * (cc * ss - cs * cs) - c * (c * ss - cs * s) + s * (c * cs - cc * s) AS d FROM m)
SELECT phase, n::BIGINT AS n, round((r * (cc * ss - cs * cs) - c * (rc * ss - cs * rs) + s * (rc * cs - cc * rs)) / d, 5) AS a, round((n * (rc * ss - cs * rs) - r * (c * ss - cs * s) + s * (c * rs - rc * s)) / d, 5) AS b, round((n * (cc * rs - rc * cs) - c * (c * rs - rc * s) + r * (c * cs - cc * s)) / d, 5) AS c FROM q"""))
def q40(spark, d):
    return rounded(stats.azimuth_fit(_azimuths(spark, d), ["phase"], "value", "az"), "a", "b", "c", places=5)


@query("q41_loo_null_model", with_tables(" SELECT eventId, stationId, round(avg((sum_m - mag) / nullif(n - 1, 0)), 6) AS predicted FROM (SELECT *, sum(mag) OVER (PARTITION BY stationId) AS sum_m, count(*) OVER (PARTITION BY stationId) AS n FROM observations) GROUP BY 1, 2"))
def q41(spark, d):
    loo = stats.leave_one_out_mean(A.observations(spark, d), ["stationId"], "mag")
    return loo.groupBy("eventId", "stationId").agg(F.round(F.avg("others"), 6).alias("predicted"))


@query("q42_null_shift", with_tables(""", s AS (SELECT i, p.stationId, p.phase, floor((t + ((i * 7919 + p.stationId * 104729 + 5) % 60001) / 1000.0::DOUBLE - 30) / 3600)::BIGINT AS eventId FROM picks p, range(5) r(i))
SELECT i AS shuffle, eventId, count(*) AS nPicks, count(DISTINCT stationId) AS nStations FROM s GROUP BY 1, 2 HAVING count(*) >= 10"""))
def q42(spark, d):
    """Clock-scrambled reruns: each station's picks move by one shift a rerun, all reruns in one job."""
    p = A.picks(spark, d).withColumn("shuffle", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    shift = F.pmod(F.col("shuffle") * 7919 + F.col("stationId") * 104729 + 5, F.lit(60001)) / F.lit(1000.0) - 30
    moved = p.withColumn("eventId", F.floor((F.col("t") + shift) / 3600))
    return moved.groupBy("shuffle", "eventId").agg(F.count(F.lit(1)).alias("nPicks"), F.countDistinct("stationId").alias("nStations")).where("nPicks >= 10")


@query("q43_sliding_counts", with_tables(""", w AS (SELECT phase, (floor(t / 600) - k) * 600 AS start FROM picks, range(12) r(k)) SELECT start::BIGINT AS start, phase, count(*) AS n FROM w GROUP BY 1, 2"""))
def q43(spark, d):
    from seismark.streaming.windows import sliding_counts

    return sliding_counts(A.picks(spark, d), 7200, 600)


@query("q44_event_picks", with_tables(", e AS (SELECT eventId, list(id ORDER BY t, id) AS ids FROM picks GROUP BY 1), x AS (SELECT eventId, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS pos FROM e) SELECT x.eventId, pos, id, stationId, phase FROM x JOIN picks USING (id)"))
def q44(spark, d):
    p = A.picks(spark, d)
    e = p.groupBy("eventId").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "id"))), lambda x: x["id"]).alias("pickIds"))
    return joins.event_picks(e, p.drop("eventId")).select("eventId", F.col("pos").cast("long").alias("pos"), "id", "stationId", "phase")


@query("q45_array_stats", with_tables(" SELECT segmentId, len(samples) AS n, round(list_max(list_transform(samples, lambda x: abs(x))), 6) AS peak, round(1 / nullif(list_max(list_transform(samples, lambda x: abs(x))), 0), 6) AS gain, round(list_avg(samples), 6) AS mean FROM samples"))
def q45(spark, d):
    from seismark.operators import signal

    return signal.array_stats(A.samples(spark, d))


@query("q46_event_magnitudes", with_tables(", s AS (SELECT eventId, logA + logR AS m FROM observations), k AS (SELECT eventId, median(m) AS med FROM s GROUP BY 1) SELECT eventId, count(*) AS nStations, CASE WHEN count(*) >= 3 THEN round(any_value(med), 6) END AS magnitude, CASE WHEN count(*) >= 3 THEN round(1.4826 * median(abs(m - med)), 6) END AS sigma FROM s JOIN k USING (eventId) GROUP BY 1"))
def q46(spark, d):
    o = A.observations(spark, d).withColumn("m", F.col("logA") + F.col("logR"))
    return rounded(stats.event_magnitudes(o, "eventId", "m", 3), "magnitude", "sigma")


@query("q47_interval_subtract", with_tables(""", a AS (SELECT stationId, start, stop FROM segments WHERE channel = 'view'), h0 AS (SELECT stationId, start, stop, max(stop) OVER (PARTITION BY stationId ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM segments WHERE channel = 'click'),
h1 AS (SELECT *, sum(CASE WHEN p IS NULL OR start > p THEN 1 ELSE 0 END) OVER (PARTITION BY stationId ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS k FROM h0), h AS (SELECT stationId, min(start) AS x, max(stop) AS y FROM h1 GROUP BY stationId, k),
cut AS (SELECT DISTINCT a.stationId, a.start, a.stop, h.x, h.y FROM a JOIN h ON h.stationId = a.stationId AND h.x < a.stop AND h.y > a.start)
SELECT stationId, round(start, 6) AS start, round(stop, 6) AS stop FROM (
SELECT DISTINCT stationId, start, stop FROM a WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.stationId = a.stationId AND h.x < a.stop AND h.y > a.start)
UNION ALL SELECT stationId, start, min(x) FROM cut GROUP BY stationId, start, stop HAVING min(x) > start
UNION ALL SELECT stationId, greatest(start, y), least(stop, coalesce(lead(x) OVER (PARTITION BY stationId, start, stop ORDER BY x), stop)) FROM cut) WHERE start < stop"""))
def q47(spark, d):
    s = A.segments(spark, d)
    return rounded(intervals.subtract(s.where("channel = 'view'"), s.where("channel = 'click'").drop("channel"), ["stationId"]), "start", "stop")


@query("q48_decile_table", with_tables(""", q AS (SELECT quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM located), b AS (SELECT value, nStations, len(list_filter(edges, lambda x: value > x)) + 1 AS bin FROM located, q)
SELECT bin::BIGINT AS bin, min(value) AS low, max(value) AS high, count(*) AS n, median(nStations) AS medianStations, min(nStations) AS minStations FROM b GROUP BY 1"""))
def q48(spark, d):
    return stats.decile_table(A.located(spark, d), "value", "nStations").withColumn("bin", F.col("bin").cast("long"))


@query("q49_trimmed_extent", with_tables(" SELECT 'e' AS axis, round(quantile_cont(e, 0.02) - 100, 6) AS low, round(quantile_cont(e, 0.98) + 100, 6) AS high FROM located UNION ALL SELECT 'n', round(quantile_cont(n, 0.02) - 100, 6), round(quantile_cont(n, 0.98) + 100, 6) FROM located"))
def q49(spark, d):
    return rounded(stats.trimmed_extent(A.located(spark, d), ["e", "n"], 0.02, 100.0), "low", "high")
