"""Evidence of an event: for each station the stretch of signal around its predicted P, filtered, scaled and within a budget of bytes."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seismark.functions.tables import materialised
from seismark.operators.chunks import Preparation, filtered, with_runs

HOUR = 3600.0
SNIPPETS = "status string, channel string, t0 double, dt double, samples array<double>"


@dataclass(frozen=True)
class Display:
    """before, after, pad: seconds around the predicted P.  priority: component codes, the last letters of channels, the best first."""

    before: float = 2.0
    after: float = 8.0
    pad: float = 5.0
    least: float = 2.0
    priority: tuple[str, ...] = ("Z", "N", "E")
    places: int = 4
    signal: Preparation = field(default_factory=lambda: Preparation(rate=100.0, high=40.0, low=2.0))


def windows_and_pieces(arrivals: DataFrame, pieces: DataFrame, d: Display) -> DataFrame:
    """(eventId, stationId, predP, _piece, channel) of pieces that overlap an arrival's padded window, by hours that both touch."""
    low, high = F.col("predP") - d.before - d.pad, F.col("predP") + d.after + d.pad
    a = arrivals.where("predP IS NOT NULL").select("eventId", "stationId", "predP", low.alias("low"), high.alias("high"), F.floor(low / HOUR).alias("h0"), F.explode(F.sequence(F.floor(low / HOUR), F.floor(high / HOUR))).alias("hour"))
    begin, end = (F.col("i0") + F.col("phase")) / F.col("rate"), (F.col("i0") + F.col("n") - 1 + F.col("phase")) / F.col("rate")
    p = pieces.select("stationId", "channel", "_piece", begin.alias("begin"), end.alias("end"))
    p = p.select("*", F.floor(F.col("begin") / HOUR).alias("g0"), F.explode(F.sequence(F.floor(F.col("begin") / HOUR), F.floor(F.col("end") / HOUR))).alias("hour"))
    met = a.join(p, ["stationId", "hour"]).where((F.col("begin") <= F.col("high")) & (F.col("end") >= F.col("low")))
    return met.where(F.col("hour") == F.greatest("h0", "g0")).select("eventId", "stationId", "predP", "_piece", "channel")


def chosen_channel(met: DataFrame, priority: tuple[str, ...]) -> DataFrame:
    """(eventId, stationId, channel): of the channels with data the one of the best component, then the first name; others have none."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.right("channel", F.lit(1)))
    best = F.min(F.struct(place.alias("place"), "channel")).alias("x")
    return met.where(place > 0).groupBy("eventId", "stationId").agg(best).select("eventId", "stationId", "x.channel")


def shown(x: np.ndarray, first: int, phase: float, rate: float, w: tuple[float, float], p: Preparation) -> tuple[int, np.ndarray]:
    """A stretch of samples without its line, tapered and filtered: number of the first output sample in the window, and the samples."""
    i = np.arange(len(x))
    if p.detrend and len(x) > 1:
        x = x - np.polyval(np.polyfit(i, x, 1), i)
    ramp = min(p.taper * rate, p.share * len(x))
    if ramp >= 1:
        x = x * np.sin(np.pi / 2 * np.clip(np.minimum(i, len(x) - 1 - i) / ramp, 0, 1)) ** 2
    m0 = int(np.ceil(max(w[0], (first + phase) / rate) * p.rate - 1e-6))
    m1 = int(np.floor(min(w[1], (first + len(x) - 1 + phase) / rate) * p.rate + 1e-6))
    m = np.arange(m0, m1 + 1)
    return m0, filtered(x, first, phase, rate, m, p) if len(m) else np.zeros(0)


def _snippet(d: Display):
    p = d.signal

    def of_group(rows: pa.Table) -> pa.Table:
        """The longest stretch of one station's window, the earliest of equals."""
        pred = rows["predP"][0].as_py()
        w, found = (pred - d.before, pred + d.after), []
        runs = rows["run"].to_numpy()
        for run in np.unique(runs):
            own = rows.filter(pa.array(runs == run))
            rate, phase = own["rate"][0].as_py(), min(own["phase"].to_pylist(), key=lambda v: (abs(v), v))
            first = own["from"].to_numpy()
            low = int(first.min())
            x = np.full(max(int(f) + len(v) for f, v in zip(first, own["part"])) - low, np.nan)
            for f, v in zip(first - low, own["part"]):
                there, v = x[f : f + len(v)], np.asarray(v.values, np.float64)
                if (np.isfinite(there) & (there != v)).any():
                    raise ValueError("pieces hold different samples for the same time")
                x[f : f + len(v)] = v
            if len(x) >= 2:
                found.append(shown(x, low, phase, rate, w, p))
        found = [(m, y) for m, y in found if len(y) > 1]
        m, y = max(found, key=lambda f: (len(f[1]), -f[0]), default=(0, np.zeros(0)))
        peak = float(np.abs(y).max()) if len(y) else 0.0
        status = "empty" if not len(y) else "short" if len(y) / p.rate < d.least else "flat" if not np.isfinite(peak) or peak == 0 else "kept"
        y = np.round(y / peak, d.places) + 0.0 if status == "kept" else None
        key = {c: rows[c].combine_chunks().slice(0, 1) for c in ("eventId", "stationId")}
        return pa.table({**key, "status": [status], "channel": rows["channel"].combine_chunks().slice(0, 1), "t0": pa.array([m / p.rate if status == "kept" else None], pa.float64()), "dt": pa.array([1 / p.rate if status == "kept" else None], pa.float64()), "samples": pa.array([y], pa.list_(pa.float64()))})

    return of_group


def snippets(arrivals: DataFrame, pieces: DataFrame, d: Display) -> DataFrame:
    """arrivals (eventId, stationId, predP and more) with status, channel, t0, dt and samples, scaled to -1..1.

    status: kept; no_data (no piece of a wanted component in the padded window); empty (nothing left in the window); short; flat.
    Only kept ones have samples.  A gap is never filled: of several stretches the longest counts.  Pieces are (stationId,
    channel, start, rate, samples); which of them are needed is found without their samples.  A null predP is no_data; a pair of event and
    station stands once in arrivals.
    """
    of_pieces = materialised(with_runs(pieces, d.signal.misaligned).withColumn("_piece", F.monotonically_increasing_id()))
    # A snippet depends on its station and time alone: arrivals that share both share it, under a number of its own.
    asked = materialised(arrivals.where("predP IS NOT NULL").select("stationId", "predP").distinct().withColumn("eventId", F.monotonically_increasing_id()))
    met = materialised(windows_and_pieces(asked, of_pieces, d))
    mine = met.join(chosen_channel(met, d.priority), ["eventId", "stationId", "channel"])
    s = mine.join(of_pieces.select("_piece", "run", "i0", "n", "phase", "rate", "samples"), "_piece")
    edge = lambda t: t * F.col("rate") - F.col("phase") - F.col("i0")
    low = F.greatest(F.lit(0), F.ceil(edge(F.col("predP") - d.before - d.pad)))
    high = F.least(F.col("n"), F.floor(edge(F.col("predP") + d.after + d.pad)) + 1)
    s = s.withColumns({"_low": low, "_high": high}).where("_high > _low")
    part = F.slice("samples", (F.col("_low") + 1).cast("int"), (F.col("_high") - F.col("_low")).cast("int")).cast("array<double>")
    s = s.select("eventId", "stationId", "predP", "channel", "run", "phase", "rate", (F.col("i0") + F.col("_low")).alias("from"), part.alias("part"))
    station = arrivals.schema["stationId"].dataType.simpleString()
    # A number of its own keeps few bytes from being put together in one task: the work is in the filter.
    parts = int(arrivals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = s.repartition(parts, "eventId", "stationId").groupBy("eventId", "stationId").applyInArrow(_snippet(d), f"eventId long, stationId {station}, {SNIPPETS}")
    made = materialised(asked.join(made.drop("stationId"), "eventId").drop("eventId"))
    rest = [c for c in arrivals.columns if c not in ("eventId", "stationId")]
    out = arrivals.join(made, ["stationId", "predP"], "left").withColumn("status", F.coalesce("status", F.lit("no_data")))
    return out.select("eventId", "stationId", *rest, "status", "channel", "t0", "dt", "samples")


def evidence_files(kept: DataFrame, max_traces: int, max_bytes: int, fields: list[str]) -> DataFrame:
    """(eventId, nTraces, nDropped, bytes, json): each event's kept snippets, the nearest first, as one line of JSON under max_bytes.

    At most max_traces; while the line has max_bytes or more, the farthest trace goes.  fields are the columns of a trace; keys are sorted and
    without blanks.  Ties of epiDistM go by stationId.  An event of which no trace fits has none.
    """
    order = Window.partitionBy("eventId").orderBy("epiDistM", "stationId")
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(fields)]), {"ignoreNullFields": "false"})
    head = F.concat(F.lit('{"eventId":'), F.to_json(F.array("eventId")).substr(F.lit(2), F.length(F.to_json(F.array("eventId"))) - 2), F.lit(',"traces":['))
    t = kept.select("eventId", "epiDistM", "stationId", head.alias("head"), line.alias("line")).withColumn("k", F.row_number().over(order))
    size = F.sum(F.octet_length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    t = t.withColumn("bytes", F.octet_length("head") + size - 1 + 3)  # commas between, and the end: ]} and a line feed
    fits = (F.col("k") <= max_traces) & (F.col("bytes") < max_bytes)
    lines = F.array_sort(F.collect_list(F.when(fits, F.struct("k", "line"))))
    g = t.groupBy("eventId").agg(F.first("head").alias("head"), lines.alias("lines"), F.count(F.lit(1)).alias("n"))
    text = F.concat("head", F.array_join(F.transform("lines", lambda x: x["line"]), ","), F.lit("]}\n"))
    return g.select("eventId", F.size("lines").cast("long").alias("nTraces"), (F.col("n") - F.size("lines")).alias("nDropped"), F.octet_length(text).cast("long").alias("bytes"), text.alias("json"))
