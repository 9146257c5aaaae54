"""Operators on sampled segments: array columns for what is relational, numpy per segment for recurrences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_stats(segments: DataFrame) -> DataFrame:
    """n, peak, the gain that makes the peak 1 (null for silence) and the mean of each segment."""
    peak = F.array_max(F.transform("samples", F.abs))
    mean = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size("samples"), F.lit(0))
    return segments.select("segmentId", F.size("samples").cast("long").alias("n"), F.round(peak, 6).alias("peak"), F.round(F.try_divide(F.lit(1.0), peak), 6).alias("gain"), F.round(mean, 6).alias("mean"))


def normalised(samples: Column, places: int = 3) -> Column:
    peak = F.array_max(F.transform(samples, F.abs))
    return F.transform(samples, lambda x: F.round(F.try_divide(x, peak), places))


def column_envelope(segments: DataFrame, rate: float, columns: int) -> DataFrame:
    """(segmentId, column, low, high): extremes of the samples in each of `columns` equal stretches; empty ones absent."""
    x = segments.select("segmentId", F.size("samples").alias("n"), F.posexplode("samples").alias("i", "v"))
    return x.groupBy("segmentId", F.floor(F.col("i") * columns / F.col("n")).alias("column")).agg(F.min("v").alias("low"), F.max("v").alias("high"))


def _sta_lta(rows: list[np.ndarray], short: int, long: int) -> list[np.ndarray]:
    """Recursive averages of squares of many segments, sample number by sample number; the first `long` values are 0."""
    sizes = np.array([len(x) for x in rows], np.int64)
    order = np.argsort(-sizes, kind="stable")
    power = np.zeros((int(sizes.max(initial=0)), len(rows)))
    for k, i in enumerate(order):
        power[: sizes[i], k] = rows[i] ** 2
    a, b = 1 / short, 1 / long
    sta, lta, ratio = np.zeros(len(rows)), np.full(len(rows), 1e-99), np.zeros_like(power)
    live = np.searchsorted(-sizes[order], -np.arange(len(power)), "left")  # segments longer than each sample number come first
    for i, n in enumerate(live):
        sta[:n] += a * (power[i, :n] - sta[:n])
        lta[:n] += b * (power[i, :n] - lta[:n])
        ratio[i, :n] = sta[:n] / lta[:n]
    ratio[:long] = 0
    out = [np.zeros(0)] * len(rows)
    for k, i in enumerate(order):
        out[i] = ratio[: sizes[i], k]
    return out


def characteristic_function(segments: DataFrame, short: int, long: int) -> DataFrame:
    """segments with `cf`, the recursive STA/LTA ratio; shorter ones than `long` are all 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(cf=[x.tolist() for x in _sta_lta([np.asarray(s, float) for s in f.samples], short, long)])

    from pyspark.sql.types import StructType

    return segments.mapInPandas(run, StructType([*segments.schema.fields, *StructType.fromDDL("cf array<double>").fields]))


def triggers(segments: DataFrame, on: float, off: float, value: str = "cf") -> DataFrame:
    """(segmentId, begin, end): on above `on`, off below `off`, as sample numbers; one that is still on ends with the segment."""
    step = lambda s, x: F.struct(
        (s["i"] + 1).alias("i"),
        F.when(~s["live"] & (x > on), True).when(s["live"] & (x < off), False).otherwise(s["live"]).alias("live"),
        F.when(~s["live"] & (x > on), F.concat(s["begins"], F.array(s["i"]))).otherwise(s["begins"]).alias("begins"),
        F.when(s["live"] & (x < off), F.concat(s["ends"], F.array(s["i"]))).otherwise(s["ends"]).alias("ends"),
    )
    none = F.expr("cast(array() as array<int>)")
    start = F.struct(F.lit(0).alias("i"), F.lit(False).alias("live"), none.alias("begins"), none.alias("ends"))
    s = segments.withColumn("_s", F.aggregate(value, start, step))
    ends = F.when(F.size("_s.begins") > F.size("_s.ends"), F.concat("_s.ends", F.array(F.size(value)))).otherwise(F.col("_s.ends"))
    return s.select("segmentId", F.explode(F.arrays_zip(F.col("_s.begins").alias("begin"), ends.alias("end"))).alias("x")).select("segmentId", "x.begin", "x.end")


def detrended(x: np.ndarray) -> np.ndarray:
    t = np.arange(len(x))
    return x - np.polyval(np.polyfit(t, x, 1), t) if len(x) > 1 else x - x


def tapered(x: np.ndarray, share: float = 0.05) -> np.ndarray:
    n = int(len(x) * share)
    w = np.ones(len(x))
    if n:
        ramp = 0.5 * (1 - np.cos(np.pi * np.arange(n) / n))
        w[:n], w[-n:] = ramp, ramp[::-1]
    return x * w


def bandpassed(x: np.ndarray, rate: float, low: float, high: float) -> np.ndarray:
    """Zero-phase band pass with cosine edges of a tenth of an octave, in the frequency domain."""
    f = np.fft.rfftfreq(len(x), 1 / rate)
    gain = np.clip((np.log2(np.maximum(f, 1e-12)) - np.log2(low)) * 10 + 1, 0, 1) * np.clip((np.log2(high) - np.log2(np.maximum(f, 1e-12))) * 10 + 1, 0, 1)
    return np.fft.irfft(np.fft.rfft(x) * (0.5 - 0.5 * np.cos(np.pi * gain)), len(x))


def prepared(segments: DataFrame, rate: float, low: float, high: float) -> DataFrame:
    """segments detrended, tapered and band-passed, one by one; gaps are never bridged."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(samples=[bandpassed(tapered(detrended(np.asarray(s, float))), rate, low, high).tolist() for s in f.samples])

    return segments.mapInPandas(run, segments.schema)


def look_ahead_envelope(x: np.ndarray, ahead: int, release: int) -> np.ndarray:
    """Largest magnitude of the next `ahead` samples, released exponentially, averaged over the last `ahead`."""
    a = np.abs(x)
    wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([a, np.zeros(ahead)]), ahead + 1) if len(a) else a[:, None]
    top = wide.max(axis=1)
    keep, level = np.exp(-1 / max(1, release)), 0.0
    for i, v in enumerate(top):
        level = max(v, level * keep)
        top[i] = level
    total = np.concatenate([[0.0], np.cumsum(top)])
    i = np.arange(len(top))
    first = np.maximum(0, i - ahead + 1)
    return (total[i + 1] - total[first]) / (i + 1 - first)
