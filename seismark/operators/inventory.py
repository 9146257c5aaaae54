"""Station inventory: elevation conventions, channel triplets, explanations of station terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seismark.functions.tables import small
from seismark.operators.stats import median


def elevation_decision(station: Column, depth: Column, dem: Column, *, tolerance: float, shallow: float, on_shallow: str = "keep", on_ambiguous: str = "dem") -> Column:
    """struct(convention, basis, surfaceElevM, sensorElevM, flagged): whether a station's elevation is its surface, its sensor or neither.

    Both readings are held against a terrain height.  Where neither fits, shallow sensors keep the
    stated value within `shallow` metres; beyond that, and for deeper ones, the two actions decide:
    "keep" or "surface", "dem", "skip" (a null struct) or "error".
    """
    as_surface, as_sensor = station - dem, station + depth - dem
    fits, fits_sensor, is_shallow = F.abs(as_surface) <= tolerance, F.abs(as_sensor) <= tolerance, depth <= tolerance

    def made(convention: str, basis: str, flagged: bool | Column) -> Column:
        surface = {"surface": station, "sensor": station + depth, "dem": dem}[convention]
        return F.struct(F.lit(convention).alias("convention"), F.lit(basis).alias("basis"), surface.alias("surfaceElevM"), (surface - depth).alias("sensorElevM"), (F.lit(flagged) if isinstance(flagged, bool) else flagged).alias("flagged"))

    def action(name: str, basis: str) -> Column:
        if name == "error":
            return F.when(F.raise_error(F.lit("the station's elevation fits neither reading")).isNull(), made("dem", basis, True))
        if name == "skip":
            return F.when(F.lit(False), made("dem", basis, True))
        return made("dem" if name == "dem" else "surface", "mismatch" if name == "dem" and basis == "shallow" else basis, True)

    closer = F.when(F.abs(as_sensor) < F.abs(as_surface), made("sensor", "both-match", True)).otherwise(made("surface", "both-match", True))
    return (
        F.when(fits & fits_sensor & is_shallow, made("surface", "both-match", False)).when(fits & fits_sensor, closer)
        .when(fits, made("surface", "dem", False)).when(fits_sensor, made("sensor", "dem", False))
        .when(is_shallow & (F.abs(as_surface) <= shallow), made("surface", "shallow", True))
        .when(is_shallow, action(on_shallow, "shallow")).otherwise(action(on_ambiguous, "assumed"))
    )


def triplets(channels: DataFrame, depth_tolerance: float) -> DataFrame:
    """Three-component sets by (site, location, code): a vertical and a horizontal pair of one rate and one depth.

    channels has site, location, code (band and instrument), component, rateHz, depthM.
    """
    c = channels.groupBy("site", "location", "code").agg(F.collect_set("component").alias("has"), F.min("rateHz").alias("rateHz"), F.max("rateHz").alias("fastest"), F.min("depthM").alias("depthM"), F.max("depthM").alias("deepest"))
    pair = F.greatest(*[F.array_contains("has", a) & F.array_contains("has", b) for a, b in (("N", "E"), ("1", "2"))])
    return c.where(F.array_contains("has", "Z") & pair & (F.col("rateHz") == F.col("fastest")) & (F.col("deepest") - F.col("depthM") <= depth_tolerance)).select("site", "location", "code", "rateHz", "depthM")


def choose_triplets(found: DataFrame, kinds: DataFrame, profile: Column, depth_tolerance: float, borehole: float) -> DataFrame:
    """found with `verdict`: 'kept', or why a triplet isn't used.

    kinds (one row a code) has code, family ('velocity' or 'accelerometer') and place; profile names
    what prepares a rate, null if nothing does.  Velocity goes before accelerometers at a site, the
    first place at a location, and of one kind and depth at a site the first stays.
    """
    t = found.join(F.broadcast(kinds), "code", "left").withColumn("profile", profile)
    usable = F.col("profile").isNotNull() & F.col("family").isNotNull()
    t = t.withColumn("kind", F.when(F.col("depthM") >= borehole, "borehole").otherwise("surface"))
    t = t.withColumn("fast", F.max(F.when(usable & (F.col("family") == "velocity"), 1).otherwise(0)).over(Window.partitionBy("site")))
    pool = usable & ((F.col("fast") == 0) | (F.col("family") == "velocity"))
    order = [F.col("place"), F.desc("rateHz"), F.col("location"), F.col("code")]
    t = t.withColumn("pool", pool).withColumn("n", F.row_number().over(Window.partitionBy("site", "location", "pool").orderBy(*order)))
    t = t.withColumn("first", pool & (F.col("n") == 1))
    # A site has a handful of triplets: those of a kind are taken in order, each kept unless a kept one is as deep.
    row = F.struct("place", (-F.col("rateHz")).alias("slow"), "location", "code", "depthM")
    kept = F.aggregate(
        "sets",
        F.slice("sets", F.lit(1), F.lit(0)),
        lambda out, x: F.when(F.exists(out, lambda k: F.abs(k["depthM"] - x["depthM"]) <= depth_tolerance), out).otherwise(F.concat(out, F.array(x))),
    )
    solo = t.where("first").groupBy("site", "kind").agg(F.array_sort(F.collect_list(row)).alias("sets")).select("site", "kind", F.explode(kept).alias("x"))
    solo = solo.select("site", "x.location", "x.code", F.lit(True).alias("solo"))
    t = t.join(solo, ["site", "location", "code"], "left")
    verdict = (
        F.when(F.col("family").isNull(), "no velocity or accelerometer code").when(F.col("profile").isNull(), "no profile for the rate").when(~pool, "the site has a velocity triplet")
        .when(F.col("n") > 1, "lower priority at its location").when(F.col("solo").isNull(), "same kind and depth").otherwise("kept")
    )
    return t.withColumn("verdict", verdict).select("site", "location", "code", "rateHz", "depthM", "kind", "profile", "verdict")


def station_ids(kept: DataFrame) -> DataFrame:
    """kept triplets with `id`: the site, and the location behind it only where two coexist."""
    n = F.count(F.lit(1)).over(Window.partitionBy("site"))
    return kept.withColumn("id", F.when(n == 1, F.col("site")).otherwise(F.concat("site", F.lit("."), "location")))


def explain_terms(terms: DataFrame, stations: DataFrame, *, flag: float, least: int, k: int, max_dist: float, lateral: float, ratio_floor: float, band: float, far: float) -> DataFrame:
    """(stationId, phase, term, neighbourMedian, spRatio, distanceM, verdict) of each term beyond `flag`.

    terms has stationId, phase, term, nEvents; stations stationId, e, n, vpvs (the model's ratio at
    the sensor).  The first of lateral, path, vpvs, timing and far that the evidence fits, else unexplained.
    """
    s = small(stations.select("stationId", "e", "n", "vpvs"))
    t = terms.join(s, "stationId").withColumn("dist", F.hypot("e", "n"))
    # Stations meet those of their own cell of max_dist metres and of the cells around it.
    cell = lambda c: F.floor(F.col(c) / max_dist)
    around = lambda c: F.explode(F.array(*[cell(c) + d for d in (-1, 0, 1)]))
    other = t.where(F.col("nEvents") >= least).select(F.col("stationId").alias("o"), "phase", F.col("term").alias("ot"), F.col("e").alias("oe"), F.col("n").alias("on"), around("e").alias("ce")).select("*", around("on").alias("cn"))
    near = t.where(F.abs("term") > flag).withColumns({"ce": cell("e"), "cn": cell("n")}).join(other, ["phase", "ce", "cn"]).where("o <> stationId").withColumn("d", F.hypot(F.col("e") - F.col("oe"), F.col("n") - F.col("on"))).where(F.col("d") <= max_dist)
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("stationId", "phase").orderBy("d", "o"))).where(F.col("_n") <= k).groupBy("stationId", "phase").agg(median("ot").alias("neighbourMedian"))
    both = terms.groupBy("stationId").agg(F.max(F.when(F.col("phase") == "P", F.col("term"))).alias("p"), F.max(F.when(F.col("phase") == "S", F.col("term"))).alias("s"))
    late = t.where((F.col("dist") > far) & (F.col("term") > flag) & (F.col("nEvents") >= least)).groupBy("phase").agg(F.collect_set("stationId").alias("late"))
    x = t.where(F.abs("term") > flag).join(near, ["stationId", "phase"], "left").join(both, "stationId").join(F.broadcast(late), "phase", "left")  # two phases
    ratio = F.when((F.abs("p") >= ratio_floor) & (F.col("p") * F.col("s") > 0), F.col("s") / F.nullif("p", F.lit(0.0)))
    x = x.withColumn("spRatio", ratio)
    shared = (F.signum("neighbourMedian") == F.signum("term")) & (F.abs("neighbourMedian") >= lateral * F.abs("term"))
    contradicted = F.size(F.array_remove(F.coalesce("late", F.array().cast("array<bigint>")), F.col("stationId"))) > 0
    verdict = (
        F.when(shared, "lateral").when(F.col("spRatio").between(F.col("vpvs") / band, F.col("vpvs") * band), "path").when(F.col("spRatio") > F.col("vpvs") * band, "vpvs")
        .when(F.col("spRatio").between(1 / band, band), "timing").when((F.col("term") < 0) & (F.col("dist") > far) & ~contradicted, "far").otherwise("unexplained")
    )
    return x.select("stationId", "phase", "term", "neighbourMedian", "spRatio", F.col("dist").alias("distanceM"), verdict.alias("verdict"))


#: Integrations from what a sensor feels to displacement, by the unit of its response; fixed.
TO_DISPLACEMENT = {"M": 0, "M/S": 1, "M/S**2": 2}


def ground_responses(channels: DataFrame) -> DataFrame:
    """channels with `gain` (counts per unit of ground motion, the factor of zeros and poles) and `integrations` to displacement.

    channels is as `sources.files.read_stations` gives it.  Without zeros and poles the sensitivity is the
    whole response; a unit that isn't ground motion gives null integrations.
    """
    unit = F.create_map(*[F.lit(x) for pair in TO_DISPLACEMENT.items() for x in pair])
    none = F.expr("cast(array() as array<double>)")
    return channels.withColumns({
        "gain": F.col("sensitivity") * F.coalesce("norm", F.lit(1.0)), "integrations": unit[F.regexp_replace("unit", r"\^", "**")],
        "zeros": F.coalesce("zeros", none), "poles": F.coalesce("poles", none),
    })
