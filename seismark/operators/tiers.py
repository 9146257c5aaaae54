"""Quality bars and tiers, summaries, display order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seismark.functions.tables import ranked
from seismark.operators.stats import median, quantiles

#: Metric -> whether larger is better.
METRICS = {"rmsS": False, "gapDeg": False, "nStations": True, "hErrM": False}


def bars(matched: DataFrame, quantiles: dict[str, tuple[int, int]], keys: list[str] = ()) -> DataFrame:
    """(tier, metric, n, bar): the ceil((1 - q) n)-th best matched value; q = a / b exactly.  Nulls never loosen a bar."""
    long = matched.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(m) if not up else -F.col(m)).cast("double").alias("cost")) for m, up in METRICS.items()])).alias("x")).select(*keys, "x.*").where("cost IS NOT NULL")
    # Ranks come from counts of distinct values, which are far fewer than rows.
    values = long.groupBy(*keys, "metric", "cost").agg(F.count(F.lit(1)).alias("c"))
    part = Window.partitionBy(*keys, "metric")
    values = values.withColumn("upTo", F.sum("c").over(part.orderBy("cost").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(part))
    tiers = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(a).alias("a"), F.lit(b).alias("b")) for t, (a, b) in quantiles.items()]))
    picked = values.withColumn("q", tiers).withColumn("place", F.ceil((F.col("q.b") - F.col("q.a")) * F.col("n") / F.col("q.b"))).where("upTo >= greatest(place, 1)")
    best = picked.groupBy(*keys, F.col("q.tier").alias("tier"), "metric").agg(F.min("cost").alias("cost"), F.max("n").alias("n"))
    up = F.col("metric").isin([m for m, u in METRICS.items() if u])
    return best.select(*keys, "tier", "metric", "n", F.when(up, -F.col("cost")).otherwise(F.col("cost")).alias("bar"))


def failed(tier: str, bar: dict[str, Column]) -> Column:
    """The metrics of a tier's bars that an event misses, in order; a null value misses its bar."""
    miss = [F.when(~F.coalesce((F.col(m) >= bar[m]) if up else (F.col(m) <= bar[m]), F.lit(False)), F.lit(f"{tier}:{m}")) for m, up in METRICS.items()]
    return F.array_compact(F.array(*miss))


def assign_tiers(events: DataFrame, bar_rows: DataFrame, factor: float) -> DataFrame:
    """events with tier and tierReasons: A meets all A bars and its rules, B all B bars, else C."""
    wide = bar_rows.groupBy().agg(*[F.max(F.when((F.col("tier") == t) & (F.col("metric") == m), F.col("bar"))).alias(f"bar_{t}_{m}") for t in "AB" for m in METRICS])
    e = events.join(F.broadcast(wide))  # one row of bars
    a = failed("A", {m: F.col(f"bar_A_{m}") for m in METRICS})
    b = failed("B", {m: F.col(f"bar_B_{m}") for m in METRICS})
    rules = F.array_compact(F.array(F.when(F.col("depthOnEdge"), F.lit("A:depthOnEdge")), F.when(F.col("minEpiDistM") > factor * F.col("focalDepthM"), F.lit("A:minEpiDistM"))))
    e = e.withColumn("_a", F.concat(a, rules)).withColumn("_b", b)
    e = e.withColumn("tier", F.when(F.size("_a") == 0, "A").when(F.size("_b") == 0, "B").otherwise("C"))
    e = e.withColumn("tierReasons", F.when(F.col("tier") == "A", F.array().cast("array<string>")).when(F.col("tier") == "B", F.col("_a")).otherwise(F.concat("_a", "_b")))
    return e.select(*events.columns, "tier", "tierReasons")


def tier_counts(events: DataFrame, keys: list[str] = ()) -> DataFrame:
    return events.groupBy(*keys).agg(*[F.count_if((F.col("tier") == t) & on).alias(f"{name}{t}") for name, on in (("all", F.lit(True)), ("additional", F.col("catalogId").isNull()), ("matched", F.col("catalogId").isNotNull())) for t in "ABC"])


def summary(events: DataFrame, public: DataFrame) -> DataFrame:
    """One row: counts, recall and medians; medians of nothing are 0."""
    e = events.agg(
        F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("catalogId").isNull()).alias("additional"), F.countDistinct("catalogId").alias("recovered"),
        F.count_if(F.col("tier") == "A").alias("strict"), F.count_if((F.col("tier") == "A") & F.col("catalogId").isNull()).alias("strictUnmatched"),
    )
    for c, name in (("rmsS", "medianRmsS"), ("nStations", "medianStations")):
        e = e.join(quantiles(events, [], c, [0.5]).agg(F.coalesce(F.max("value"), F.lit(0.0)).alias(name)))  # one row each
    p = public.agg(F.count(F.lit(1)).alias("public"))
    return e.join(p).withColumn("recall", F.try_divide(F.col("recovered").cast("double"), F.col("public")))


def baseline_rows(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidates"), F.countDistinct("catalogId").alias("recoveredPublic"), *[F.count_if(F.col("tier") == t).alias(f"tier{t}") for t in "ABC"],
        median("rmsS").alias("medianRmsS"), median("nStations").alias("medianStations"),
    )


def baseline_gain(rows: DataFrame, better: str, base: str, profiles: tuple[str, str], least: float) -> DataFrame:
    """(ratio, claimed): the gain in tier A on the first profile, claimed if it exceeds `least` on both."""
    at = lambda m, p: F.max(F.when((F.col("method") == m) & (F.col("profile") == p), F.col("tierA")))
    w = rows.agg(*[at(m, p).alias(f"{m}_{p}") for m in (better, base) for p in profiles])
    r = [F.try_divide(F.col(f"{better}_{p}").cast("double"), F.col(f"{base}_{p}")) for p in profiles]
    ok = F.coalesce((r[0] > least) & (r[1] > least), F.lit(False))
    return w.select(F.when(ok, r[0]).alias("ratio"), ok.alias("claimed"))


def reveal_order(events: DataFrame) -> DataFrame:
    """events with revealOrder from 0 by tier, time and id."""
    return ranked(events, "tier", "t", "eventId", name="_r").withColumn("revealOrder", F.col("_r") - 1).drop("_r")


def hero(events: DataFrame, unmatched: bool = False) -> DataFrame:
    """The tier A event with the most stations, the lowest rms (nulls last), the earliest, the smallest id; no row without one."""
    e = events.where("tier = 'A'")
    e = e.where("catalogId IS NULL") if unmatched else e
    return e.orderBy(F.desc("nStations"), F.asc_nulls_last("rmsS"), "t", "eventId").limit(1)


def user_order(column: str, descending: bool) -> list[Column]:
    """A user's sort: missing values last either way, ties by time and id."""
    c = F.col(column)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col("t"), F.col("eventId")]


def metric_best(rows: DataFrame, keys: list[str], best: list[Column], take: str) -> DataFrame:
    """Lexicographic best of each key."""
    w = Window.partitionBy(*keys).orderBy(*best)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").select(*keys, take)
