"""Many reruns of the association in one job: scrambled clocks and swept parameters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.functions.tables import materialised
from seismark.operators.association import associate
from seismark.operators.iterative import uniform
from seismark.operators.picks import pick_counts


def associate_each(picks: DataFrame, times: DataFrame, **options) -> DataFrame:
    """The association of every `scenario` of picks (a long from 0), as if each ran alone.

    Scenarios are moved apart in time by more than an event or a rule reaches, by whole slots, and so
    they share one association's rounds and never a candidate.
    """
    picks = materialised(picks)
    seen = picks.agg(F.min("t"), F.max("t")).first()
    longest = times.agg(F.max("seconds")).first()[0] or 0.0
    width = options["width"]
    reach = options["apart"] + options["within"] + 4 * (width + options["tolerance"] + longest)
    apart = width * math.ceil(((seen[1] or 0.0) - (seen[0] or 0.0) + reach) / width)
    moved = picks.withColumn("t", F.col("t") + F.col("scenario") * apart).withColumn("id", F.concat_ws("|", F.col("scenario").cast("string"), "id"))
    rows = associate(moved, times, **options)
    rows = rows.withColumn("scenario", F.substring_index("pickId", "|", 1).cast("long"))
    return rows.withColumn("eventT", F.col("eventT") - F.col("scenario") * apart).withColumn("pickId", F.expr("substring(pickId, locate('|', pickId) + 1)"))


def scrambled(picks: DataFrame, reruns: int, seed: int, most: float) -> DataFrame:
    """The picks of each rerun (`scenario`), every station's clock moved by one draw from -most to most: P and S of a station stay together."""
    each = picks.withColumn("scenario", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reruns - 1).cast("long"))))
    return each.withColumn("t", F.col("t") + (2 * uniform(seed, F.col("scenario"), F.col("stationId")) - 1) * most)


def null_test(picks: DataFrame, times: DataFrame, *, reruns: int, seed: int, most: float, **options) -> DataFrame:
    """(scenario, events, picks) that the association still finds after the clocks are scrambled, for each rerun."""
    rows = associate_each(scrambled(picks, reruns, seed, most), times, **options)
    found = rows.groupBy("scenario").agg(F.countDistinct("eventId").alias("events"), F.count(F.lit(1)).alias("picks"))
    return picks.sparkSession.range(reruns).withColumnRenamed("id", "scenario").join(found, "scenario", "left").fillna(0, ["events", "picks"])


def association_sweep(picks: DataFrame, times: DataFrame, *, probs: list[float], s_picks: list[int], stations: list[int], minimums: dict[str, int], **options) -> DataFrame:
    """(minPickProb, nSPicks, minStations, candidates): events found at every point of the grid.

    All probabilities are scenarios of one association a value of nSPicks; the minimum of stations is
    a filter on what was found.
    """
    spark = picks.sparkSession
    levels = spark.createDataFrame(list(enumerate(probs)), "scenario long, minPickProb double")
    grid = levels.crossJoin(spark.createDataFrame([(n,) for n in s_picks], "nSPicks int")).crossJoin(spark.createDataFrame([(n,) for n in stations], "minStations int"))  # parameters only
    thinned = materialised(picks.withColumn("scenario", F.explode(F.array([F.lit(k).cast("long") for k in range(len(probs))]))).join(F.broadcast(levels), "scenario").where(F.col("prob") >= F.col("minPickProb")).drop("minPickProb"))
    found = None
    for n in s_picks:
        rows = associate_each(thinned, times, minimums={**minimums, "nS": n}, **options)
        size = pick_counts(rows).join(rows.select("eventId", "scenario").distinct(), "eventId").select("scenario", "nStations", F.lit(n).alias("nSPicks"))
        found = size if found is None else found.unionByName(size)
    hit = grid.join(found, ["scenario", "nSPicks"]).where(F.col("nStations") >= F.col("minStations")).groupBy("scenario", "nSPicks", "minStations").agg(F.count(F.lit(1)).alias("c"))
    return grid.join(hit, ["scenario", "nSPicks", "minStations"], "left").select("minPickProb", "nSPicks", "minStations", F.coalesce("c", F.lit(0)).alias("candidates"))
