"""Picks: selection with a ledger, counts and minimums, duplicates, shared picks, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seismark.functions.tables import ranked


def drop_reason(min_prob: float, known: Column) -> Column:
    """Why a pick isn't selected; null if it is.  The first of several reasons counts."""
    return (
        F.when(~F.coalesce(F.col("phase").isin("P", "S"), F.lit(False)), "phase")
        .when(F.col("t").isNull() | F.isnan("t"), "time")
        .when(F.col("prob").isNull() | ~F.col("prob").between(0, 1), "probability")
        .when(~F.coalesce(known, F.lit(False)), "station")
        .when(F.col("prob") < min_prob, "below")
    )


def judged_picks(picks: DataFrame, stations: DataFrame, min_prob: float) -> DataFrame:
    """picks with `reason`; stations has id and usedInRun.  Stations that aren't used drop their picks, counted."""
    used = stations.where("usedInRun").select(F.col("id").alias("stationId"), F.lit(True).alias("_known")).distinct()
    return picks.join(used, "stationId", "left").withColumn("reason", drop_reason(min_prob, F.col("_known"))).drop("_known")


def select_picks(picks: DataFrame, stations: DataFrame, min_prob: float) -> DataFrame:
    return judged_picks(picks, stations, min_prob).where("reason IS NULL").drop("reason")


def pick_ledger(picks: DataFrame, stations: DataFrame, min_prob: float) -> DataFrame:
    """(reason, n): every pick once, the kept ones under 'kept'."""
    return judged_picks(picks, stations, min_prob).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def pick_counts(assigned: DataFrame, event: str = "eventId") -> DataFrame:
    """nPicks, nP, nS, nPS (stations with both) and nStations of each event."""
    by_station = assigned.groupBy(event, "stationId").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("phase") == "P").cast("int")).alias("p"), F.max((F.col("phase") == "S").cast("int")).alias("s"))
    return by_station.groupBy(event).agg(
        F.sum("n").alias("nPicks"), F.sum("p").cast("long").alias("nP"), F.sum("s").cast("long").alias("nS"),
        F.sum(F.col("p") * F.col("s")).cast("long").alias("nPS"), F.count(F.lit(1)).alias("nStations"),
    )


def failed_minimum(minimums: dict[str, int]) -> Column:
    """The first count that is below its minimum; null if none is."""
    reason = F.lit(None).cast("string")
    for name, least in reversed(minimums.items()):
        reason = F.when(F.col(name) < least, name).otherwise(reason)
    return reason


def apply_minimums(assigned: DataFrame, minimums: dict[str, int], event: str = "eventId") -> DataFrame:
    """The picks of events that meet every minimum."""
    good = pick_counts(assigned, event).where(failed_minimum(minimums).isNull()).select(event)
    return assigned.join(good, event, "left_semi")


def minimum_ledger(assigned: DataFrame, minimums: dict[str, int], event: str = "eventId") -> DataFrame:
    """(cause, events) of events that are dropped, each under the first minimum that it misses."""
    return pick_counts(assigned, event).withColumn("cause", failed_minimum(minimums)).where("cause IS NOT NULL").groupBy("cause").agg(F.count(F.lit(1)).alias("events"))


def dedupe_best(picks: DataFrame, *keys: str) -> DataFrame:
    """One pick a key: the highest probability, then the earliest, then the smallest id."""
    w = Window.partitionBy(*keys).orderBy(F.desc("prob"), "t", "id")
    return picks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resolve_shared(assigned: DataFrame) -> DataFrame:
    """Each pick stays with the event of the smallest |residual|; then more picks, the earlier origin, the smaller id."""
    size = F.count(F.lit(1)).over(Window.partitionBy("eventId"))
    w = Window.partitionBy("pickId").orderBy(F.abs("residual"), F.desc("_size"), "eventT", "eventId")
    return assigned.withColumn("_size", size).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_size")


def number_events(events: DataFrame, prefix: str, *order: Column | str) -> DataFrame:
    """events with `id`: prefix and a number of six digits from 0 in the given order."""
    return ranked(events, *order, name="_rank").withColumn("id", F.concat(F.lit(prefix), F.lpad((F.col("_rank") - 1).cast("string"), 6, "0"))).drop("_rank")


def one_pick_per_station_phase(assigned: DataFrame) -> DataFrame:
    """Violations: (eventId, stationId, phase, n) with more than one pick."""
    return assigned.groupBy("eventId", "stationId", "phase").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
