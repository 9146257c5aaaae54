"""Robust statistics, histograms, magnitudes of completeness and b-values, fits from sums."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seismark.functions.tables import materialised, ranked, small


def median(c: Column | str) -> Column:
    return F.percentile(c, F.lit(0.5))


def quantiles(rows: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """(*keys, q, value): linear quantiles of groups of any size; nulls are left out, and groups without a value have no row.

    Values get their places by a sort over ranges, and those that a quantile lies between are picked
    by place: no task holds a group.
    """
    r = ranked(rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")), *keys, "_v", name="_rank")
    n = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_rank").alias("_first"))
    place = F.col("q") * (F.col("_n") - 1)
    want = n.withColumn("q", F.explode(F.array(*map(F.lit, at)))).withColumn("_share", place - F.floor(place)).withColumn("_low", F.col("_first") + F.floor(place))
    ends = F.array(F.struct(F.col("_low").alias("_rank"), (1 - F.col("_share")).alias("_w")), F.struct((F.col("_low") + 1).alias("_rank"), F.col("_share").alias("_w")))
    want = want.select(*keys, "q", F.explode(ends).alias("x")).select(*keys, "q", "x.*").where("_w > 0")
    return r.select("_rank", "_v").join(small(materialised(want)), "_rank").groupBy(*keys, "q").agg(F.sum(F.col("_w") * F.col("_v")).alias("value"))


def residual_stats(rows: DataFrame, keys: list[str], value: str, few: bool = False) -> DataFrame:
    """n, median, MAD (unscaled) and rms by key.  few: the keys are few and their groups of any size."""
    if few:
        at = lambda df, c, name: quantiles(df, keys, c, [0.5]).select(*keys, F.col("value").alias(name))
        mid = materialised(at(rows, value, "median"))
        off = at(rows.join(small(mid), keys).withColumn("_off", F.abs(F.col(value) - F.col("median"))), "_off", "mad")
        s = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
        return s.join(mid, keys, "left").join(off, keys, "left").select(*keys, "n", "median", "mad", "rms")
    mid = rows.groupBy(*keys).agg(F.count(value).alias("n"), median(value).alias("median"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    off = rows.join(mid.select(*keys, "median"), keys).groupBy(*keys).agg(median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return mid.join(off, keys).select(*keys, "n", "median", "mad", "rms")


def robust_sigma(rows: DataFrame, keys: list[str], value: str, configured: float) -> DataFrame:
    """1.4826 * MAD by key, and its ratio to the configured sigma."""
    return residual_stats(rows, keys, value, few=True).select(*keys, (F.col("mad") * 1.4826).alias("sigma"), (F.col("mad") * 1.4826 / configured).alias("ratio"))


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Lower weighted median: the first value whose running weight reaches half of the total; weights above 0."""
    rows = rows.where(F.col(weight) > 0).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    part = Window.partitionBy(*keys)
    running = F.sum("_w").over(part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_run", running).withColumn("_all", F.sum("_w").over(part)).where("2 * _run >= _all").groupBy(*keys).agg(F.min(value).alias("weightedMedian"))


def station_terms(rows: DataFrame, keys: list[str], value: str, event: str, cap: float, least: int) -> DataFrame:
    """Median residual by key, within +-cap, 0 where fewer than `least` events support it."""
    t = rows.groupBy(*keys).agg(median(value).alias("raw"), F.countDistinct(event).alias("nEvents"))
    return t.withColumn("term", F.when(F.col("nEvents") < least, 0.0).otherwise(F.greatest(F.lit(-cap), F.least(F.lit(cap), F.col("raw")))))


def event_magnitudes(rows: DataFrame, event: str, value: str, least: int) -> DataFrame:
    """Median of station magnitudes with 1.4826 * MAD; both null below `least` stations."""
    s = residual_stats(rows, [event], value)
    enough = F.col("n") >= least
    return s.select(event, F.col("n").alias("nStations"), F.when(enough, F.col("median")).alias("magnitude"), F.when(enough, F.col("mad") * 1.4826).alias("sigma"))


def equal_count_bins(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """rows with `bin` from 1: cut at linear quantiles, right-closed, repeated edges dropped."""
    edges = quantiles(rows, [], value, [i / bins for i in range(bins + 1)]).agg(F.array_distinct(F.array_sort(F.collect_list("value"))).alias("edges"))
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    return rows.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter(inner, lambda e: F.col(value) > e)) + 1).drop("edges")  # one row of edges


def decile_table(rows: DataFrame, value: str, stations: str, bins: int = 10) -> DataFrame:
    return equal_count_bins(rows, value, bins).groupBy("bin").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n"), median(stations).alias("medianStations"), F.min(stations).alias("minStations"))


def histogram(rows: DataFrame, t: str, start: float, stop: float, width: float) -> DataFrame:
    """(bin, n): fixed bins of [start, stop), times outside clamped to the first and last, empty bins kept."""
    n = max(1, math.ceil((stop - start) / width))
    k = F.least(F.greatest(F.floor((F.col(t) - start) / width), F.lit(0)), F.lit(n - 1))
    counts = rows.where(F.col(t).isNotNull()).groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return rows.sparkSession.range(n).withColumnRenamed("id", "bin").join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def busiest_bin(rows: DataFrame, t: str, width: float) -> DataFrame:
    """The epoch-aligned bin with the most rows, the earliest of equals."""
    return rows.groupBy(F.floor(F.col(t) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bin").limit(1)


def grid_index(m: Column, width: float) -> Column:
    """Nearest grid value, ties to even."""
    return F.rint(m / width).cast("long")


def max_curvature(rows: DataFrame, keys: list[str], mag: str, width: float, offset: float, least: int) -> DataFrame:
    """Magnitude of completeness: the fullest grid value, the lowest of equals, plus an offset; null below `least` events."""
    bins = rows.groupBy(*keys, grid_index(F.col(mag), width).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return bins.groupBy(*keys).agg(F.sum("n").alias("events"), F.max(F.struct("n", (-F.col("k")).alias("low"))).alias("top")).select(*keys, "events", F.when(F.col("events") >= least, -F.col("top.low") * width + offset).alias("mc"))


def cumulative_counts(rows: DataFrame, mag: str, width: float) -> DataFrame:
    """(k, n, atLeast): events at each grid value, and at it or above; empty values between included."""
    bins = rows.groupBy(grid_index(F.col(mag), width).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    ends = bins.agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a IS NOT NULL")
    full = ends.select(F.explode(F.sequence("a", "b")).alias("k")).join(bins, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"))
    # One row a grid value: the window holds magnitudes' steps, not events.
    return full.withColumn("atLeast", F.sum("n").over(Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)))


def b_value(rows: DataFrame, keys: list[str], mag: str, mc: str, width: float) -> DataFrame:
    """Aki-Utsu b over magnitudes of mc or more, and the Shi-Bolt sigma.  rows carries mc."""
    above = rows.where(grid_index(F.col(mag), width) >= grid_index(F.col(mc), width))
    s = above.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(mag).alias("mean"), F.var_samp(mag).alias("var"), F.min(mc).alias("mc"))
    b = math.log10(math.e) / (F.col("mean") - (F.col("mc") - width / 2))
    return s.where("n > 1").withColumn("b", b).select(*keys, "n", "b", (2.3 * F.col("b") * F.col("b") * F.sqrt(F.col("var") / F.col("n"))).alias("sigmaB"))


def spearman(rows: DataFrame, keys: list[str], x: str, y: str, least: int) -> DataFrame:
    """Correlation of average ranks; null with fewer than `least` rows or a constant side."""
    def mean_rank(c: str) -> Column:
        part = Window.partitionBy(*keys)
        return F.rank().over(part.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2

    r = rows.withColumn("_rx", mean_rank(x)).withColumn("_ry", mean_rank(y))
    rho = F.when((F.count(F.lit(1)) >= least) & (F.stddev_pop("_rx") > 0) & (F.stddev_pop("_ry") > 0), F.corr("_rx", "_ry"))
    return r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rho.alias("rho"))


def azimuth_fit(rows: DataFrame, keys: list[str], residual: str, azimuth: str) -> DataFrame:
    """residual = a + b cos az + c sin az by least squares, from sums and a closed 3 x 3 solution."""
    c, s, r = F.cos(F.radians(azimuth)), F.sin(F.radians(azimuth)), F.col(residual)
    m = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(c).alias("c"), F.sum(s).alias("s"), F.sum(c * c).alias("cc"), F.sum(s * s).alias("ss"), F.sum(c * s).alias("cs"),
        F.sum(r).alias("r"), F.sum(r * c).alias("rc"), F.sum(r * s).alias("rs"),
    )

    def det(a: list[list[str]]) -> Column:
        x = [[F.col(i) for i in row] for row in a]
        return x[0][0] * (x[1][1] * x[2][2] - x[1][2] * x[2][1]) - x[0][1] * (x[1][0] * x[2][2] - x[1][2] * x[2][0]) + x[0][2] * (x[1][0] * x[2][1] - x[1][1] * x[2][0])

    base, right = [["n", "c", "s"], ["c", "cc", "cs"], ["s", "cs", "ss"]], ["r", "rc", "rs"]
    d = det(base)
    put = lambda k: [[right[i] if j == k else base[i][j] for j in range(3)] for i in range(3)]
    return m.select(*keys, F.col("n").cast("long").alias("n"), *[F.when(F.abs(d) > 1e-9, det(put(k)) / d).alias(name) for k, name in enumerate("abc")])


def leave_one_out_mean(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with the mean of all others of their key; null for a lone row.

    Sums by key, and not a window, which would sort all rows: no task holds a key's rows.  A null key is a key.
    """
    both = rows.groupBy(*keys).agg(F.count(value).alias("_n"), F.sum(value).alias("_sum"))
    both = small(both.select(*[F.col(k).alias(f"_{k}") for k in keys], "_n", "_sum"), 1_000_000)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    n = F.col("_n")
    out = rows.join(both, same).withColumn("others", F.when(n > 1, (F.col("_sum") - F.col(value)) / F.nullif(n - 1, F.lit(0))))
    return out.select(*rows.columns, "others")


def trimmed_extent(rows: DataFrame, columns: list[str], trim: float, margin: float) -> DataFrame:
    """(axis, low, high): linear quantiles at trim and 1 - trim (none if n < 1 / trim), with a margin."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("_x")) for c in columns])).alias("x")).select("x.*")
    ends = long.groupBy("axis").agg(F.count("_x").alias("_n"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
    q = quantiles(long, ["axis"], "_x", [trim, 1 - trim]).groupBy("axis").agg(F.min("value").alias("_p"), F.max("value").alias("_q"))
    few = F.col("_n") < 1 / trim
    return ends.join(q, "axis", "left").select("axis", (F.when(few, F.col("_a")).otherwise(F.col("_p")) - margin).alias("low"), (F.when(few, F.col("_b")).otherwise(F.col("_q")) + margin).alias("high"))


def calibrated(obs: DataFrame, ridge: float = 1.0, least: int = 3, rounds: int = 500, scale: float = 0.3, tolerance: float = 1e-9) -> tuple[dict[str, float], DataFrame]:
    """mag = logA + b * logR + c + station term by robust (soft L1) least squares with ridge-damped station terms.

    Returns b and c, and (stationId, term).  Each round sums the weighted normal equations by station
    in Spark.  A station's term is in its own equation only, and so is eliminated there; the sums of
    what remains, a 2 x 2 system, are all that reaches the driver.  Stops when no unknown moves by
    the tolerance; raises if that takes more rounds.
    """
    rows = materialised(obs.select("stationId", "logR", (F.col("mag") - F.col("logA")).alias("d")))
    terms = rows.groupBy("stationId").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("stationId", F.lit(0.0).alias("term"))
    terms = materialised(terms)
    b = c = 0.0
    for _ in range(rounds):
        r = F.col("d") - (b * F.col("logR") + c + F.col("term"))
        w, x, d = F.col("w"), F.col("logR"), F.col("d")
        near = rows.join(terms, "stationId").withColumn("w", 1 / F.sqrt(1 + (r / scale) * (r / scale)))
        s = materialised(near.groupBy("stationId").agg(F.first("term").alias("term"), *[F.sum(e).alias(a) for a, e in {"w": w, "r": w * x, "rr": w * x * x, "d": w * d, "rd": w * x * d}.items()]))
        own = F.col("w") + ridge
        left = {"rr": F.col("rr") - F.col("r") * F.col("r") / own, "r": F.col("r") - F.col("r") * F.col("w") / own, "w": F.col("w") - F.col("w") * F.col("w") / own, "rd": F.col("rd") - F.col("r") * F.col("d") / own, "d": F.col("d") - F.col("w") * F.col("d") / own}
        m = s.agg(*[F.sum(e).alias(a) for a, e in left.items()]).first()
        if m.w is None:
            return {"b": 0.0, "c": 0.0}, terms
        new_b, new_c = map(float, np.linalg.lstsq(np.array([[m.rr, m.r], [m.r, m.w]]), np.array([m.rd, m.d]), rcond=None)[0])
        new = s.select("stationId", ((F.col("d") - new_b * F.col("r") - new_c * F.col("w")) / own).alias("term"), F.col("term").alias("before"))
        moved = max(abs(new_b - b), abs(new_c - c), new.agg(F.max(F.abs(F.col("term") - F.col("before"))).alias("x")).first().x)
        b, c, terms = new_b, new_c, new.select("stationId", "term")
        if moved < tolerance:
            return {"b": b, "c": c}, terms
    raise ArithmeticError(f"the calibration still moves by {moved:.3g} after {rounds} rounds")


def fit_calibration(obs: DataFrame, **limits) -> tuple[dict[str, float], dict]:
    """`calibrated`, with the terms of a network that the driver can hold as a dict."""
    line, terms = calibrated(obs, **limits)
    return line, {r.stationId: r.term for r in terms.collect()}
