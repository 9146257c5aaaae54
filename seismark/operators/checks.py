"""Checks that stored values still hold, joins that fill or compare tables, and choices among configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seismark.functions.tables import ranked, small
from seismark.operators.geometry import azimuthal_gap
from seismark.operators.joins import nearest_station


def recomputed(rows: DataFrame, pairs: dict[str, Column], tolerance: float) -> DataFrame:
    """(field, compared, off, worst): stored columns against what they are recomputed as.

    A value is off if it differs by more than the tolerance, or if only one side is missing.
    """
    own = F.array(*[F.struct(F.lit(c).alias("field"), F.abs(F.col(c) - again).alias("diff"), (F.col(c).isNull() != again.isNull()).alias("lone")) for c, again in pairs.items()])
    long = rows.select(F.explode(own).alias("x")).select("x.*")
    return long.groupBy("field").agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("lone") | (F.col("diff") > tolerance)).alias("off"), F.max("diff").alias("worst"))


def filled(left: DataFrame, right: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """left with columns taken from right where right has a row and a value; right has one row a key."""
    other = right.select(*on, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return left.join(other, on, "left").withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns}).drop(*[f"_new_{c}" for c in columns])


def statics_map(terms: DataFrame) -> DataFrame:
    """(stationId, statics): a map from phase to term; a station has a term a phase."""
    return terms.groupBy("stationId").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("phase", "term")))).alias("statics"))


def reference_pairs(matches: DataFrame, located: DataFrame, public: DataFrame) -> DataFrame:
    """Matched events with both hypocentres: (catalogId, eventId, de, dn, dt); `stale` where the match names an event that is no more."""
    l = located.select("eventId", F.col("e").alias("le"), F.col("n").alias("ln"), F.col("t").alias("lt"))  # noqa: E741
    p = public.select("catalogId", F.col("e").alias("pe"), F.col("n").alias("pn"), F.col("t").alias("pt"))
    j = matches.select("catalogId", "eventId").join(l, "eventId", "left").join(p, "catalogId", "left")
    stale = F.col("lt").isNull() | F.col("pt").isNull()
    return j.select("catalogId", "eventId", (F.col("le") - F.col("pe")).alias("de"), (F.col("ln") - F.col("pn")).alias("dn"), (F.col("lt") - F.col("pt")).alias("dt"), stale.alias("stale"))


def nearest_usable(events: DataFrame, stations: DataFrame, least: float, above_hz: float) -> DataFrame:
    """The nearest station of each event, among those with enough coverage and a Nyquist frequency over the band; stations carry coverage and rateHz."""
    ok = stations.where((F.col("coverage") >= least) & (F.col("rateHz") / 2 > above_hz))
    return nearest_station(events, ok).drop("place")


def evidence_rows(arrivals: DataFrame, stations: DataFrame) -> DataFrame:
    """(eventId, stationId, epiDistM, pickP, pickS, place): both picks of a station in one row, P required, the nearest first.

    arrivals has eventId, stationId, phase, t and the event's e and n (ex, ey).  An event's stations are
    those with its picks.
    """
    at = lambda p: F.min(F.when(F.col("phase") == p, F.col("t")))
    w = arrivals.groupBy("eventId", "stationId").agg(at("P").alias("pickP"), at("S").alias("pickS"), F.first("ex").alias("ex"), F.first("ey").alias("ey")).where("pickP IS NOT NULL")
    w = w.join(small(stations.select("stationId", "e", "n")), "stationId").withColumn("epiDistM", F.hypot(F.col("e") - F.col("ex"), F.col("n") - F.col("ey")))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("eventId").orderBy("epiDistM", "stationId"))
    return w.select("eventId", "stationId", "epiDistM", "pickP", "pickS", place.alias("place"))


def pick_id(station: Column, phase: Column, t: Column) -> Column:
    """station:phase:milliseconds"""
    return F.concat_ws(":", station.cast("string"), phase, F.rint(t * 1000).cast("long").cast("string"))


def picking_stations(events: DataFrame, stations: DataFrame) -> DataFrame:
    """(eventId, stationId): the known stations that an event's pick ids name."""
    named = events.select("eventId", F.explode("pickIds").alias("id")).select("eventId", F.substring_index("id", ":", 1).alias("name")).distinct()
    return named.join(stations.select(F.col("stationId").cast("string").alias("name"), "stationId"), "name").select("eventId", "stationId")


def ground_proxy(events: DataFrame, stations: DataFrame) -> DataFrame:
    """(eventId, stationId, groundM, above): the surface at the nearest station, and whether the event (z) lies over it."""
    near = nearest_station(events, stations).join(stations.select("stationId", F.col("elevM").alias("groundM")), "stationId")
    return near.join(events.select("eventId", "z"), "eventId").select("eventId", "stationId", "groundM", (F.col("z") > F.col("groundM")).alias("above"))


def disagreements(ours: DataFrame, theirs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, ours, theirs) of every value on which two tables with the same keys differ; missing equals missing."""
    other = theirs.select(key, *[F.col(c).cast("string").alias(f"_their_{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("ours"), F.col(f"_their_{c}").alias("theirs")) for c in columns])
    return ours.join(other, key).select(key, F.explode(rows).alias("x")).select(key, "x.*").where(~F.col("ours").eqNullSafe(F.col("theirs")))


def event_quality(arrivals: DataFrame) -> DataFrame:
    """Quality of each event from its used picks: counts, rms, azimuthal gap, nearest distance, mean probability.

    arrivals has eventId, stationId, phase, prob, residual, dE and dN (station minus event, metres).
    """
    q = arrivals.groupBy("eventId").agg(
        F.countDistinct("stationId").alias("nStations"), F.count_if(F.col("phase") == "P").alias("nP"), F.count_if(F.col("phase") == "S").alias("nS"),
        F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmsS"), F.min(F.hypot("dE", "dN")).alias("minEpiDistM"), F.avg("prob").alias("meanPickProb"),
    )
    az = arrivals.select("eventId", F.pmod(F.degrees(F.atan2("dE", "dN")), F.lit(360.0)).alias("az"))
    return q.join(azimuthal_gap(az, "eventId", "az").drop("azimuths"), "eventId")


def visible(tier: Column, shown: str) -> Column:
    """Whether a candidate counts under a filter: PUBLIC none, STRICT tier A, ALL every tier."""
    return {"PUBLIC": F.lit(False), "ALL": F.lit(True), "STRICT": F.coalesce(tier == "A", F.lit(False))}[shown]


def usable_error(error: Column) -> Column:
    """A positive, finite error; null otherwise."""
    return F.when((error > 0) & ~F.isnan(error) & (error < float("inf")), error)


def counter(total: Column, progress: Column) -> Column:
    """A counter on its way from 0 to its total, in whole numbers."""
    return F.floor(total * F.least(F.lit(1.0), F.greatest(F.lit(0.0), progress)))


def reveal_issues(events: DataFrame, order: str) -> DataFrame:
    """(issue, n): why `order` isn't a permutation of 0 to n - 1."""
    s = events.agg(F.count(F.lit(1)).alias("rows"), F.count(order).alias("known"), F.countDistinct(order).alias("distinct"), F.min(order).alias("least"), F.max(order).alias("most"))
    issues = {"missing": F.col("rows") - F.col("known"), "repeated": F.col("known") - F.col("distinct"), "below": F.when(F.col("least") < 0, 1).otherwise(0), "beyond": F.when(F.col("most") >= F.col("rows"), 1).otherwise(0)}
    return s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("issue"), v.cast("long").alias("n")) for k, v in issues.items()])).alias("x")).select("x.*")


def strict_wins(rows: DataFrame, base: str, keys: list[str]) -> DataFrame:
    """(name, adopted): variants are adopted only if they beat the base on the keys in order; equal ones aren't.  One row a configuration."""
    top = rows.where(F.col("name") == base).select(F.struct(*keys).alias("_base"))
    return rows.where(F.col("name") != base).join(F.broadcast(top)).select("name", (F.struct(*keys) > F.col("_base")).alias("adopted"))  # one row


def swept_parameter(sweep: DataFrame, params: str = "params") -> DataFrame:
    """(parameter, values): the parameter with the most distinct values, the first name of equals."""
    return sweep.select(F.explode(params).alias("parameter", "value")).groupBy("parameter").agg(F.countDistinct("value").alias("values")).orderBy(F.desc("values"), "parameter").limit(1)


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """(positives, negatives, auc) from average ranks; null with one class only.  Ranks come from a range sort, not from one task."""
    r = ranked(rows.select(score, label), score, name="_rank")
    ties = r.groupBy(score).agg(F.avg("_rank").alias("_mean"), F.sum(label).cast("double").alias("up"), F.count(F.lit(1)).alias("_n"))
    s = ties.agg(F.sum(F.col("_mean") * F.col("up")).alias("ranks"), F.sum("up").alias("p"), (F.sum("_n") - F.sum("up")).alias("q"))
    p, q = F.col("p"), F.col("q")
    return s.select(p.cast("long").alias("positives"), q.cast("long").alias("negatives"), F.when((p > 0) & (q > 0), (F.col("ranks") - p * (p + 1) / 2) / (p * q)).alias("auc"))


def logistic(weights: dict[str, float], bias: float) -> Column:
    return 1 / (1 + F.exp(-(F.lit(bias) + sum(F.lit(w) * F.col(c) for c, w in weights.items()))))


def newest_good(windows: DataFrame) -> DataFrame:
    """The newest window whose outcome is ok and that holds an event; no row without one."""
    return windows.where("outcome = 'ok' AND eventCount > 0").orderBy(F.desc("stop"), F.desc("start")).limit(1)


def cache_issues(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, issue): files whose samples differ from the manifest's, that the manifest doesn't know, or that are gone."""
    f, m = files.select("name", F.col("samples").alias("have")), manifest.select("name", F.col("samples").alias("want"))
    j = f.join(m, "name", "full")
    why = F.when(F.col("want").isNull(), "stray").when(F.col("have").isNull(), "gone").when(F.col("have") != F.col("want"), "samples")
    return j.select("name", why.alias("issue")).where("issue IS NOT NULL")


def latest_stages(ledger: DataFrame) -> DataFrame:
    """The last pass of each stage of each run from an append-only ledger (runId, stage, pass, runtimeS, n), with the passes' number and whole time."""
    last = F.max_by(F.struct("runtimeS", "n"), F.col("pass")).alias("x")
    return ledger.groupBy("runId", "stage").agg(last, F.count(F.lit(1)).alias("passes"), F.sum("runtimeS").alias("totalS")).select("runId", "stage", "passes", F.col("x.runtimeS").alias("lastS"), F.col("x.n").alias("n"), "totalS")


def stretched(t: Column, anchor: Column, factor: float) -> Column:
    """Real time to a model's time that runs `factor` times slower from an anchor."""
    return anchor + (t - anchor) * factor


def unstretched(t: Column, anchor: Column, factor: float) -> Column:
    return anchor + (t - anchor) / factor


def response_verdict(epochs: Column, horizontals: Column, unit: Column, rate: Column, want: float, high: float) -> Column:
    """Why a station's response can't be used, the first of several reasons; null if it can."""
    return (
        F.when(epochs != 1, "epochs").when(horizontals < 2, "horizontals").when(~F.coalesce(unit.isin("M", "M/S", "M/S**2"), F.lit(False)), "unit")
        .when(F.abs(rate - want) > 1e-6 * want, "rate").when(rate / 2 <= high, "nyquist")
    )


def leave_one_event_out(obs: DataFrame, event: str, x: str, y: str) -> DataFrame:
    """(event, n, predicted, null): the mean y that a line through all other events gives an event, and their plain mean.

    The line without an event comes from the whole sums less the event's own, so that nothing is
    fitted twice and the sums alone are shared.
    """
    a, b = F.col(x), F.col(y)
    parts = {"n": F.count(F.lit(1)).cast("double"), "x": F.sum(a), "y": F.sum(b), "xx": F.sum(a * a), "xy": F.sum(a * b)}
    own = obs.groupBy(event).agg(*[e.alias(k) for k, e in parts.items()])
    whole = own.agg(*[F.sum(k).alias(f"all_{k}") for k in parts])
    j = own.join(F.broadcast(whole))  # one row
    n, sx, sy, sxx, sxy = (F.col(f"all_{k}") - F.col(k) for k in parts)
    det = n * sxx - sx * sx
    slope = F.when(F.abs(det) > 1e-9, (n * sxy - sx * sy) / det)
    return j.select(event, F.col("n").cast("long").alias("n"), F.when(n > 1, (sy - slope * sx) / n + slope * F.col("x") / F.col("n")).alias("predicted"), F.when(n > 0, sy / n).alias("null"))


def count_up_to(rows: DataFrame, t: str, start: float, stop: float, every: float) -> DataFrame:
    """(at, shown): how many rows have come by each instant of a grid, that instant included."""
    from pyspark.sql import Window

    last = int((stop - start) // every)
    slot = F.greatest(F.lit(0), F.ceil((F.col(t) - start) / every))
    n = rows.where(F.col(t) <= start + last * every).groupBy(slot.cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    grid = rows.sparkSession.range(last + 1).withColumnRenamed("id", "k").join(n, "k", "left")
    # One row a grid instant: the window holds the grid, not events.
    return grid.select((F.lit(start) + F.col("k") * every).alias("at"), F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)).alias("shown"))
