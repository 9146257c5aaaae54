"""What might bend depths, as one table of figures: sensors, shifts, phases, profiles, stations, azimuths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.functions.tables import small
from seismark.operators.intervals import merged
from seismark.operators.iterative import synthetic_arrivals
from seismark.operators.location import Layers, Volume, locate_events
from seismark.operators.stats import azimuth_fit, quantiles, residual_stats


def sensors(stations: DataFrame, tolerance: float) -> DataFrame:
    """One row: sensors in boreholes, those at depth 0, others below ground, and rows whose three heights disagree.

    stations has kind, surfaceElevM, sensorDepthM and sensorElevM.
    """
    bore, depth = F.col("kind") == "borehole", F.col("sensorDepthM")
    apart = F.abs(F.col("surfaceElevM") - depth - F.col("sensorElevM")) > tolerance
    return stations.agg(F.count_if(bore).alias("boreholes"), F.count_if(bore & (depth == 0)).alias("zeroDepth"), F.count_if(~bore & (depth > 0)).alias("buriedOthers"), F.count_if(apart).alias("inconsistent"))


def shifts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(q, value): quantiles of how much higher events lie in the second of two tables of locations (eventId, z)."""
    j = before.select("eventId", F.col("z").alias("_z")).join(after.select("eventId", "z"), "eventId")
    return quantiles(j.select((F.col("z") - F.col("_z")).alias("dz")), [], "dz", [0.1, 0.5, 0.9])


def by_s_picks(events: DataFrame, least: int) -> DataFrame:
    """(enoughS, n, medianVErrM, iqrElevM, onEdge): depth errors and spread of events with enough S picks, and of the rest.

    events has nS, vErrM, elevM and depthOnEdge; errors that are missing are left out.
    """
    e = events.withColumn("enoughS", F.col("nS") >= least)
    n = e.groupBy("enoughS").agg(F.count(F.lit(1)).alias("n"), F.count_if("depthOnEdge").alias("onEdge"))
    err = quantiles(e, ["enoughS"], "vErrM", [0.5]).select("enoughS", F.col("value").alias("medianVErrM"))
    wide = quantiles(e, ["enoughS"], "elevM", [0.25, 0.75]).groupBy("enoughS").agg((F.max("value") - F.min("value")).alias("iqrElevM"))
    return n.join(err, "enoughS", "left").join(wide, "enoughS", "left").select("enoughS", "n", "medianVErrM", "iqrElevM", "onEdge")


def by_profile(residuals: DataFrame) -> DataFrame:
    """(phase, profile, nAll, nUsed, madAllS, madUsedS, medianUsedS) from residuals of all picks, used or dropped (phase, profile, residual, used)."""
    keys = ["phase", "profile"]
    whole = residual_stats(residuals, keys, "residual", few=True).select(*keys, F.col("n").alias("nAll"), F.col("mad").alias("madAllS"))
    used = residual_stats(residuals.where("used"), keys, "residual", few=True).select(*keys, F.col("n").alias("nUsed"), F.col("mad").alias("madUsedS"), F.col("median").alias("medianUsedS"))
    return whole.join(used, keys, "left").select(*keys, "nAll", F.coalesce("nUsed", F.lit(0)).alias("nUsed"), "madAllS", "madUsedS", "medianUsedS")


def by_station(residuals: DataFrame, least: int, flag: float) -> DataFrame:
    """(phase, stations, enough, flagged, worst): how many stations' median residuals can be told, and how many of them are too large."""
    s = residual_stats(residuals.where("used"), ["stationId", "phase"], "residual")
    off = F.when(F.col("n") >= least, F.abs("median"))
    return s.groupBy("phase").agg(F.count(F.lit(1)).alias("stations"), F.count(off).alias("enough"), F.count_if(off > flag).alias("flagged"), F.max(off).alias("worst"))


def datum_check(points: DataFrame, stations: DataFrame, layers: Layers, volume: Volume, nearest: int) -> DataFrame:
    """(eventId, dzM, dhM): how far exact P and S times of given places (eventId, e, n, z) are located from them."""
    exact = synthetic_arrivals(points, stations, layers, nearest=nearest, keep_s=1.1, sigma=(0.0, 0.0), seed=0).where("eventId % 2 = 0")
    found = locate_events(exact.withColumn("eventId", (F.col("eventId") / 2).cast("long")), layers, volume)
    j = points.select("eventId", F.col("e").alias("te"), F.col("n").alias("tn"), F.col("z").alias("tz")).join(found, "eventId")
    return j.select("eventId", (F.col("z") - F.col("tz")).alias("dzM"), F.hypot(F.col("e") - F.col("te"), F.col("n") - F.col("tn")).alias("dhM"))


def figures(check: str, rows: DataFrame, subject: list[str], names: list[str]) -> DataFrame:
    """(check, subject, name, value): a row for each figure that isn't missing; subject joins the key columns' values."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names])
    about = F.concat_ws("/", *[F.col(c).cast("string") for c in subject]) if subject else F.lit("all")
    return rows.select(F.lit(check).alias("check"), about.alias("subject"), F.explode(cells).alias("x")).select("check", "subject", "x.*").where("value IS NOT NULL")


def depth_report(stations: DataFrame, before: DataFrame, events: DataFrame, residuals: DataFrame, *, tolerance: float, least_s: int, least: int, flag: float) -> DataFrame:
    """All checks on tables at hand, as figures; `datum_check` locates anew and stands apart.

    residuals has stationId, phase, profile, azimuth, residual and used.
    """
    parts = [
        figures("sensors", sensors(stations, tolerance), [], ["boreholes", "zeroDepth", "buriedOthers", "inconsistent"]),
        figures("shift", shifts(before, events.withColumn("z", F.col("elevM"))).withColumnRenamed("value", "dzM"), ["q"], ["dzM"]),
        figures("sPicks", by_s_picks(events, least_s), ["enoughS"], ["n", "medianVErrM", "iqrElevM", "onEdge"]),
        figures("profile", by_profile(residuals), ["phase", "profile"], ["nAll", "nUsed", "madAllS", "madUsedS", "medianUsedS"]),
        figures("stations", by_station(residuals, least, flag), ["phase"], ["stations", "enough", "flagged", "worst"]),
        figures("azimuth", azimuth_fit(residuals.where("used"), ["phase"], "residual", "azimuth"), ["phase"], ["n", "a", "b", "c"]),
    ]
    return reduce(DataFrame.unionByName, parts)


def known_windows(public: DataFrame, segments: DataFrame, stations: DataFrame, *, n: int, before: float, after: float, least: float) -> DataFrame:
    """(catalogId, stationId, covered, verdict) for windows around the n largest known events: 'usable' with enough of the window, 'gap' with less, 'none' without any.

    The windows are n, so that every used station's is n rows; segments of a station and channel may
    overlap, and the best channel counts.
    """
    top = public.where("mag IS NOT NULL").orderBy(F.desc("mag"), "t", "catalogId").limit(n).select("catalogId", (F.col("t") - before).alias("a"), (F.col("t") + after).alias("b"))
    cells = stations.where("usedInRun").select("stationId").join(F.broadcast(top.select("catalogId")))  # n rows
    part = segments.join(F.broadcast(top), (F.col("start") < F.col("b")) & (F.col("stop") > F.col("a")))
    part = part.select("catalogId", "stationId", "channel", F.greatest("start", "a").alias("start"), F.least("stop", "b").alias("stop"))
    seen = merged(part, ["catalogId", "stationId", "channel"]).groupBy("catalogId", "stationId", "channel").agg(F.sum(F.col("stop") - F.col("start")).alias("s")).groupBy("catalogId", "stationId").agg(F.max("s").alias("s"))
    covered = F.coalesce("s", F.lit(0.0)) / (before + after)
    verdict = F.when(F.col("s").isNull(), "none").when(covered >= least, "usable").otherwise("gap")
    return cells.join(seen, ["catalogId", "stationId"], "left").select("catalogId", "stationId", covered.alias("covered"), verdict.alias("verdict"))
