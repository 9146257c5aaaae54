"""Signals prepared for a model at one rate, chunk by chunk over any cutting into files; and reads grouped by span.

Pieces of a channel that abut on one grid of samples are one segment; gaps are never bridged.  A segment's trend
comes from sums over its pieces and its taper from the distance to its own ends, and the filter is a finite
symmetric kernel, so a chunk with as much around it as the kernel and the taper reach gives the very samples that the uncut
segment would.  No task holds more than a chunk of one channel.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seismark.functions.tables import materialised, small

CHANNEL = ["stationId", "channel"]


@dataclass(frozen=True)
class Preparation:
    """rate: of the output, on multiples of 1 / rate since the epoch.  high, low: the band in hertz (low 0: a low pass).

    crossings: half the kernel's width in zero crossings of its narrowest edge.  chunk: seconds.  taper: seconds at each end, and
    the share of the segment that it takes at most.  misaligned: samples that abutting grids may differ by.
    """

    rate: float = 100.0
    high: float = 40.0
    low: float = 0.0
    crossings: int = 16
    chunk: float = 600.0
    taper: float = 1.0
    share: float = 0.05
    least: float = 2.0
    misaligned: float = 0.01
    detrend: bool = True

    @property
    def reach(self) -> float:
        """Seconds to each side that an output sample depends on."""
        return self.crossings / (2 * min(self.high, self.low or self.high))


def ratio(rate: float, target: float, most_up: int = 100, tolerance: float = 1e-6) -> tuple[int, int]:
    """(down, up) in least terms with rate * up / down = target; another ratio, or a rate below the target, is an error."""
    exact = rate / target
    near = Fraction(exact).limit_denominator(most_up)
    if near < 1 or abs(float(near) - exact) > tolerance * exact:
        raise ValueError(f"{rate} Hz is not {target} Hz times M / L with M >= L and L <= {most_up}")
    return near.numerator, near.denominator


def kernel(t: np.ndarray, p: Preparation) -> np.ndarray:
    """The band pass at times t from its centre: windowed sincs, zero beyond p.reach."""
    window = np.where(np.abs(t) < p.reach, np.cos(np.pi * t / (2 * p.reach)) ** 2, 0.0)
    return window * (2 * p.high * np.sinc(2 * p.high * t) - 2 * p.low * np.sinc(2 * p.low * t))


def filtered(x: np.ndarray, first: int, phase: float, rate: float, m: np.ndarray, p: Preparation) -> np.ndarray:
    """Samples m of the output's grid from samples first, first + 1, ... of the input's; nothing is there beyond them."""
    down, up = ratio(rate, p.rate)
    half = int(np.ceil(p.reach * rate)) + 1
    # An output sample lies at m * down / up input samples; the places between two of them repeat: one row of taps for each.
    kinds, row = np.unique((m * down) % up, return_inverse=True)
    rest = kinds / up - phase
    base = (m * down) // up + np.floor(rest).astype(np.int64)[row]
    taps = np.arange(-half, half + 1)
    table = kernel((taps[None, :] - (rest - np.floor(rest))[:, None]) / rate, p)
    table = table / (rate if p.low else table.sum(axis=1, keepdims=True))  # without a lower edge a constant stays one
    wide = np.concatenate([np.zeros(2 * half + 2), x, np.zeros(2 * half + 2)])
    start = base - first + half + 2
    within = start.min(initial=0) >= 0 and start.max(initial=0) + 2 * half < len(wide)
    columns = np.ascontiguousarray(table.T)
    out = np.zeros(len(m))
    for j, column in enumerate(columns):
        out += column[row] * wide[start + j if within else np.clip(start + j, 0, len(wide) - 1)]
    return out


def with_runs(pieces: DataFrame, misaligned: float = 0.01) -> DataFrame:
    """pieces (stationId, channel, start in seconds, rate, samples) with i0, phase, n, run and skip.

    i0 numbers the first sample on the channel's grid since the epoch, phase is the rest in samples; run is the i0 that
    its segment starts with; the first `skip` samples stand in earlier pieces too.  Another rate on the same channel, or pieces
    that overlap on different grids, are errors.  The order of a channel's pieces is found without their samples.
    """
    x = F.col("start") * F.col("rate")
    p = pieces.withColumns({"i0": F.round(x).cast("long"), "phase": x - F.round(x), "n": F.size("samples").cast("long")}).where("n > 0")
    p = materialised(p.withColumn("_piece", F.monotonically_increasing_id()))
    order = Window.partitionBy(*CHANNEL).orderBy("i0", "n", "_piece")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    m = p.select("_piece", *CHANNEL, "i0", "n", "phase", "rate").withColumn("_end", F.max(F.col("i0") + F.col("n")).over(before))
    m = m.withColumns({"_off": F.abs(F.col("phase") - F.lag("phase").over(order)) > misaligned, "_rate": F.lag("rate").over(order)})
    wrong = F.when(F.col("_rate") != F.col("rate"), F.raise_error(F.lit("pieces of one channel at different rates")))
    wrong = wrong.when(F.col("_off") & (F.col("i0") < F.col("_end")), F.raise_error(F.lit("pieces overlap on different grids")))
    new = F.col("_end").isNull() | (F.col("i0") > F.col("_end")) | F.col("_off")
    m = m.withColumn("_new", F.coalesce(wrong.cast("boolean"), new))
    m = m.withColumn("run", F.last(F.when(F.col("_new"), F.col("i0")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.withColumn("skip", F.when(F.col("_new"), 0).otherwise(F.least("n", F.col("_end") - F.col("i0"))).cast("long"))
    return p.join(m.select("_piece", "run", "skip"), "_piece").drop("_piece")


def runs_of(pieces: DataFrame) -> DataFrame:
    """(stationId, channel, run, last, mean, slope): each segment's last sample and the line through its samples, by number from run on."""
    add = lambda value: F.aggregate(F.slice("samples", (F.col("skip") + 1).cast("int"), F.size("samples")), F.struct(F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("s")), lambda a, x: F.struct((a["i"] + 1).alias("i"), (a["s"] + value(a["i"], x)).alias("s")))["s"]
    from_run = (F.col("i0") + F.col("skip") - F.col("run")).cast("double")
    s = pieces.select(*CHANNEL, "run", (F.col("i0") + F.col("n") - 1).alias("last"), add(lambda i, x: x).alias("x"), (add(lambda i, x: x * i) + from_run * add(lambda i, x: x)).alias("ix"))
    s = s.groupBy(*CHANNEL, "run").agg(F.max("last").alias("last"), F.sum("x").alias("x"), F.sum("ix").alias("ix"))
    n = (F.col("last") - F.col("run") + 1).cast("double")
    slope = (F.col("ix") - F.col("x") * (n - 1) / 2) / (n * (n * n - 1) / 12)
    return s.select(*CHANNEL, "run", "last", (F.col("x") / n).alias("mean"), F.when(n > 1, slope).otherwise(0.0).alias("slope"))


def _prepared(p: Preparation):
    def of_chunk(key: tuple, rows: pa.Table) -> pa.Table:
        k, run = key[3].as_py(), key[2].as_py()
        rate, last, mean, slope = (rows[c][0].as_py() for c in ("rate", "last", "mean", "slope"))
        phase = min(rows["phase"].to_pylist(), key=lambda v: (abs(v), v))
        first = rows["from"].to_numpy()
        parts = [np.asarray(v.values, np.float64) for v in rows["part"]]
        low = int(first.min())
        x = np.full(max(int(f) + len(v) for f, v in zip(first, parts)) - low, np.nan)
        for f, v in zip(first - low, parts):
            there = x[f : f + len(v)]
            if (np.isfinite(there) & (there != v)).any():
                raise ValueError(f"{key[0].as_py()} {key[1].as_py()}: pieces hold different samples for the same time")
            x[f : f + len(v)] = v
        i = low + np.arange(len(x))
        if p.detrend:
            x = x - mean - slope * (i - run - (last - run) / 2)
        ramp = min(p.taper * rate, p.share * (last - run + 1))
        if ramp >= 1:
            x = x * np.sin(np.pi / 2 * np.clip(np.minimum(i - run, last - i) / ramp, 0, 1)) ** 2
        # The output's grid: multiples of 1 / rate in the chunk, within the segment.
        m0 = max(int(np.ceil(k * p.chunk * p.rate - 1e-6)), int(np.ceil((run + phase) / rate * p.rate - 1e-6)))
        m1 = min(int(np.ceil((k + 1) * p.chunk * p.rate - 1e-6)) - 1, int(np.floor((last + phase) / rate * p.rate + 1e-6)))
        m = np.arange(m0, m1 + 1)
        if not len(m):
            return pa.table({c: pa.array([], t) for c, t in (("stationId", rows["stationId"].type), ("channel", pa.string()), ("run", pa.int64()), ("chunk", pa.int64()), ("start", pa.float64()), ("samples", pa.list_(pa.float64())))})
        out = filtered(x, low, phase, rate, m, p)
        return pa.table({"stationId": pa.array([key[0].as_py()], rows["stationId"].type), "channel": [key[1].as_py()], "run": pa.array([run], pa.int64()), "chunk": pa.array([k], pa.int64()), "start": [m0 / p.rate], "samples": pa.array([out], pa.list_(pa.float64()))})

    return of_chunk


def prepared_chunks(pieces: DataFrame, p: Preparation) -> DataFrame:
    """(stationId, channel, run, chunk, start, samples): every segment at p.rate, a row for each chunk that it has samples in.

    Chunks of a segment follow one another without a gap or a common sample.  Segments shorter than p.least seconds are left
    out (short_runs names them).  Pieces that overlap must hold the same samples there.  Null or empty pieces are ignored.
    """
    of_pieces = materialised(with_runs(pieces, p.misaligned))
    runs = materialised(runs_of(of_pieces))
    joined = of_pieces.join(small(runs), [*CHANNEL, "run"]).where((F.col("last") - F.col("run") + 1) / F.col("rate") >= p.least)
    around = p.reach + 2 / p.rate
    begin, end = (F.col("i0") + F.col("phase")) / F.col("rate"), (F.col("i0") + F.col("n") - 1 + F.col("phase")) / F.col("rate")
    k = F.explode(F.sequence(F.floor((begin - around) / p.chunk), F.floor((end + around) / p.chunk)))
    d = joined.withColumn("chunk", k)
    low = F.greatest(F.lit(0), F.ceil((F.col("chunk") * p.chunk - around) * F.col("rate") - F.col("phase")) - F.col("i0"))
    high = F.least(F.col("n"), F.floor(((F.col("chunk") + 1) * p.chunk + around) * F.col("rate") - F.col("phase")) - F.col("i0") + 1)
    d = d.withColumns({"_low": low, "_high": high}).where("_high > _low")
    part = F.slice("samples", (F.col("_low") + 1).cast("int"), (F.col("_high") - F.col("_low")).cast("int")).cast("array<double>")
    d = d.select(*CHANNEL, "run", "chunk", "rate", "phase", "last", "mean", "slope", (F.col("i0") + F.col("_low")).alias("from"), part.alias("part"))
    station = pieces.schema["stationId"].dataType.simpleString()
    return d.groupBy(*CHANNEL, "run", "chunk").applyInArrow(_prepared(p), f"stationId {station}, channel string, run long, chunk long, start double, samples array<double>")


def short_runs(pieces: DataFrame, p: Preparation) -> DataFrame:
    """(stationId, channel, start, seconds) of the segments that prepared_chunks leaves out."""
    of_pieces = with_runs(pieces, p.misaligned)
    r = of_pieces.groupBy(*CHANNEL, "run").agg(F.max(F.col("i0") + F.col("n")).alias("end"), F.first("rate").alias("rate"))
    seconds = (F.col("end") - F.col("run")) / F.col("rate")
    return r.where(seconds < p.least).select(*CHANNEL, (F.col("run") / F.col("rate")).alias("start"), seconds.alias("seconds"))


#: Windows of as many buckets as hold about so many go through Python at once.
PART_WINDOWS = 100_000


def _next_windows(span: float):
    def of_buckets(rows: pa.Table) -> pa.Table:
        """For each window of each bucket the first later one, by order of start, that its group can't take in."""
        r = rows.sort_by([(c, "ascending") for c in ("key", "b", "own", "start", "stop", "id")]).combine_chunks()
        name, b, own = r["key"].combine_chunks().dictionary_encode().indices.to_numpy(), r["b"].to_numpy(), r["own"].to_numpy()
        edges = np.concatenate([[0], np.flatnonzero((np.diff(name) != 0) | (np.diff(b) != 0)) + 1, [len(b)]])
        first = np.repeat(edges[:-1], np.diff(edges))
        mine = own == b  # a bucket's own windows come before those of the next
        count = np.add.reduceat(mine.astype(np.int64), edges[:-1])
        pos = np.arange(len(b)) - first - np.where(mine, 0, np.repeat(count, np.diff(edges)))
        start, stop = r["start"].to_numpy().tolist(), r["stop"].to_numpy().tolist()
        reach = []
        for low, high, n in zip(edges[:-1].tolist(), edges[1:].tolist(), count.tolist()):
            j = low
            for i in range(low, low + n):  # the first that ends too late only moves on, as starts do
                end = start[i] + span
                j = max(j, i + 1)
                if stop[i] <= end:
                    while j < high and stop[j] <= end:
                        j += 1
                reach.append(j)
        reach, end = np.array(reach, np.int64), np.repeat(edges[1:], np.diff(edges))[mine]
        inside = reach < end
        at = np.where(inside, reach, end - 1)
        beyond = r["beyond"].combine_chunks().fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)[mine]
        to_b, to_p = np.where(inside, own[at], beyond), np.where(inside, pos[at], 0)
        null = to_b == -(1 << 62)
        return pa.table({"key": r["key"].filter(pa.array(mine)), "b": b[mine], "p": pos[mine], "toB": pa.array(to_b, mask=null), "toP": pa.array(to_p, mask=null)})

    return of_buckets


def read_groups(windows: DataFrame, span: float, key: str = "stationId") -> DataFrame:
    """windows (id, key, start, stop) with groupStart: greedy groups in order of start (then stop and id) that span at most `span`.

    A window that is longer by itself is a group of its own.  Windows are dealt out by buckets of `span` seconds; each
    points to the first one that its group couldn't take in, and the heads of groups are what the key's first window
    reaches over these pointers, found by doubling them: as many rounds as the logarithm of the number of groups.
    """
    w = materialised(windows.select("id", F.col(key).cast("string").alias("key"), F.col("start").cast("double").alias("start"), F.col("stop").cast("double").alias("stop"), F.floor(F.col("start") / span).alias("own")).where("start IS NOT NULL AND stop IS NOT NULL"))
    buckets = materialised(w.select("key", F.col("own").alias("b")).distinct())
    # The next bucket with windows beyond the one after this.
    far = F.min("b").over(Window.partitionBy("key").orderBy("b").rangeBetween(2, Window.unboundedFollowing))
    beyond = buckets.withColumn("beyond", far)
    twice = w.select("*", F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("b"))
    near = twice.join(small(beyond), ["key", "b"])
    parts = -(-2 * w.count() // PART_WINDOWS)  # a bucket's windows are few: a call for each would cost more than its work
    near = near.withColumn("_part", F.pmod(F.xxhash64("key", "b"), F.lit(max(1, parts))))
    jump = materialised(near.groupBy("_part").applyInArrow(_next_windows(span), "key string, b long, p long, toB long, toP long"))
    first = jump.groupBy("key").agg(F.min(F.struct("b", "p")).alias("x")).select("key", "x.b", "x.p")
    jumps = [jump]
    while not (last := jumps[-1].where("toB IS NOT NULL")).isEmpty():
        to = jumps[-1].select(F.col("key"), F.col("b").alias("toB"), F.col("p").alias("toP"), F.col("toB").alias("nextB"), F.col("toP").alias("nextP"))
        jumps.append(materialised(last.join(to, ["key", "toB", "toP"]).select("key", "b", "p", F.col("nextB").alias("toB"), F.col("nextP").alias("toP")).where("toB IS NOT NULL")))
    heads = materialised(first)
    for step in reversed(jumps):
        more = step.where("toB IS NOT NULL").join(heads, ["key", "b", "p"]).select("key", F.col("toB").alias("b"), F.col("toP").alias("p"))
        heads = materialised(heads.unionByName(more).distinct())

    # The bucket's windows in order, each with the start of the last head up to it.
    order = Window.partitionBy("key", "b").orderBy("start", "stop", "id")
    numbered = w.withColumnRenamed("own", "b").withColumn("p", F.row_number().over(order).cast("long") - 1)
    marked = numbered.join(heads.withColumn("_head", F.lit(True)), ["key", "b", "p"], "left")
    last_head = F.last(F.when(F.col("_head"), F.col("start")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = materialised(marked.select("id", "key", "start", "stop", last_head.alias("groupStart"), "b"))
    # A bucket's first windows may belong to the last group of the bucket before it: a group spans no more than one bucket's length.
    carried = placed.groupBy("key", (F.col("b") + 1).alias("b")).agg(F.max("groupStart").alias("carried"))
    return placed.join(small(carried), ["key", "b"], "left").select("id", F.col("key").alias(key), "start", "stop", F.coalesce("groupStart", "carried").alias("groupStart"))
