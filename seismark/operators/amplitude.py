"""Amplitudes of waveform windows on a simulated torsion seismometer, and what each of them is worth.

Tasks turn counts into the instrument's motion, all windows alike in length, rate and response as one
matrix with one filter; columns afterwards decide what a peak means.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Instrument:
    """The seismometer whose traces are simulated, and the limits of the inversion; fixed by convention."""

    period: float = 0.8
    damping: float = 0.7
    gain: float = 2080.0
    water_db: float = 60.0
    band: tuple[float, float, float, float] = (0.5, 1.0, 20.0, 30.0)
    full_scale: float = 8388608.0
    clip_share: float = 0.9
    least_snr: float = 3.0
    pad: float = 2.0


class Alike(NamedTuple):
    """What windows must share to pass through the same filter."""

    n: int
    rate: float
    zeros: tuple[float, ...]
    poles: tuple[float, ...]
    gain: float
    integrations: int


class Filter(NamedTuple):
    gains: np.ndarray
    edges: np.ndarray
    wet: tuple[float, float] | None


#: Samples of one matrix, so that a batch of many long windows is filtered in parts.
MATRIX = 1 << 21


def _distances(s: np.ndarray, roots: tuple[float, ...]) -> np.ndarray:
    return np.prod(s[:, None] - np.reshape(roots, (-1, 2)) @ [1, 1j], axis=1)


def _raised(x: np.ndarray) -> np.ndarray:
    return np.sin(np.pi / 2 * np.clip(x, 0, 1)) ** 2


def trace_filter(a: Alike, w: Instrument) -> Filter:
    """From counts to the instrument's millimetres, over the frequencies of twice the window; nothing at 0 Hz.

    Where the response falls `water_db` below its largest value it is held there; `wet` are the lowest
    and highest such frequencies of the flat part of the band.
    """
    f = np.fft.rfftfreq(2 * a.n, 1 / a.rate)[1:]
    s, turn = 2j * np.pi * f, 2 * np.pi / w.period
    counts = a.gain * _distances(s, a.zeros) / _distances(s, a.poles)
    size = np.abs(counts)
    level = size.max() / 10 ** (w.water_db / 20)
    ground = np.exp(-1j * np.angle(counts)) / np.fmax(size, level)
    needle = w.gain * s ** (2 - a.integrations) / np.polyval([1, 2 * w.damping * turn, turn**2], s)
    low, from_, to, high = w.band
    gains = 1000 * ground * needle * _raised((f - low) / (from_ - low)) * _raised((high - f) / (high - to))
    under = f[(size < level) & (f >= from_) & (f <= to)]
    i, pad = np.arange(a.n), min(round(w.pad * a.rate), a.n // 2)
    edges = _raised(np.minimum(i, i[::-1]) / pad) if pad else np.ones(a.n)
    return Filter(np.append(0, gains), edges, (float(under[0]), float(under[-1])) if len(under) else None)


def simulated(rows: np.ndarray, to: Filter) -> np.ndarray:
    """The instrument's motion for counts along the last axis: line and mean taken out, ends faded, filtered."""
    n = rows.shape[-1]
    i = np.arange(n) - (n - 1) / 2
    flat = rows - rows.mean(-1, keepdims=True) - (rows @ i / (i @ i))[..., None] * i
    return np.fft.irfft(np.fft.rfft(flat * to.edges, 2 * n) * to.gains, 2 * n)[..., :n]


def _most(values: np.ndarray, inside: np.ndarray) -> np.ndarray:
    return np.where(inside.any(1), np.where(inside, values, -np.inf).max(1), np.nan)


def _peaks(f: pd.DataFrame, w: Instrument, filters: dict[Alike, Filter]) -> pd.DataFrame:
    sides = [[np.asarray([] if x is None else x, float) for x in f[c]] for c in ("h1", "h2")]
    out = f[["eventId", "stationId"]].assign(**dict.fromkeys(("counts", "signal", "noise", "wetLowHz", "wetHighHz"), np.nan))
    groups: dict[Alike, list[int]] = {}
    for i, (x, y) in enumerate(zip(*sides)):
        n = min(len(x), len(y))
        if n >= 4 and np.isfinite(x).all() and np.isfinite(y).all():
            row = f.iloc[i]
            groups.setdefault(Alike(n, float(row.rateHz), tuple(row.zeros), tuple(row.poles), float(row.gain), int(row.integrations)), []).append(i)
    for alike, members in groups.items():
        if alike not in filters:
            filters[alike] = trace_filter(alike, w)
        to, step = filters[alike], max(1, MATRIX // alike.n)
        for at in (members[k : k + step] for k in range(0, len(members), step)):
            counts = np.array([[side[i][: alike.n] for i in at] for side in sides])
            motion = np.hypot(*simulated(counts, to))
            t = f.start.to_numpy(float)[at][:, None] + np.arange(alike.n) / alike.rate
            bound = lambda c: f[c].to_numpy(float)[at][:, None]
            found = {"counts": np.abs(counts).max((0, 2))}
            for name in ("signal", "noise"):
                found[name] = _most(motion, (t >= bound(f"{name}Start")) & (t <= bound(f"{name}End")))
            if to.wet:
                found |= {"wetLowHz": to.wet[0], "wetHighHz": to.wet[1]}
            for name, values in found.items():
                out.iloc[at, out.columns.get_loc(name)] = values
    return out


def measure(windows: DataFrame, instrument: Instrument = Instrument()) -> DataFrame:
    """One row a window: status (ok, lowSnr, flat, clipped, gap) and the peak of both horizontals together.

    windows has eventId, stationId, h1, h2 (raw counts), start, rateHz, zeros, poles (pairs of real and
    imaginary parts, flat, radians a second), gain, integrations (to displacement), and the bounds of
    noise and signal.  Of sides of different lengths the common stretch counts.  A side that is null,
    has fewer than four samples or one that is null or no number, and bounds without a sample make a gap.
    wetLowHz and wetHighHz say where the flat band holds frequencies under the response's water level.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters: dict[Alike, Filter] = {}
        for f in frames:
            yield _peaks(f, instrument, filters)
            if len(filters) > 256:
                filters.clear()

    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    found = windows.mapInPandas(run, "eventId long, stationId long, counts double, signal double, noise double, wetLowHz double, wetHighHz double")
    found = found.select("eventId", "stationId", *map(number, ("counts", "signal", "noise", "wetLowHz", "wetHighHz")))
    ratio = F.when(F.col("noise") > 0, F.col("signal") / F.col("noise")).when(F.col("noise") == 0, F.lit(float("inf")))
    clipped = F.col("counts") >= instrument.clip_share * instrument.full_scale
    open_ = F.col("counts").isNull() | F.col("signal").isNull() | F.col("noise").isNull()
    status = F.when(clipped, "clipped").when(open_, "gap").when(F.col("signal") <= 0, "flat").when(ratio < instrument.least_snr, "lowSnr").otherwise("ok")
    told = found.withColumn("status", status)
    shown = ~F.col("status").isin("clipped", "gap")
    return told.select(
        "eventId", "stationId", "status", F.when(shown, F.col("signal")).alias("ampMm"), F.when(shown, F.col("noise")).alias("noiseMm"),
        F.when(shown & (F.col("status") != "flat"), ratio).alias("snr"), F.col("counts").alias("peakCounts"), "wetLowHz", "wetHighHz",
    )
