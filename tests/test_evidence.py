import json
import random

import numpy as np
import pytest

from seismark.operators import evidence
from seismark.operators.chunks import Preparation
from seismark.operators.evidence import Display
from tests.test_chunks import T0, _whole

D = Display(before=2.0, after=6.0, pad=3.0, least=2.0, signal=Preparation(rate=50.0, high=18.0, low=2.0))
PIECES = "stationId string, channel string, start double, rate double, samples array<double>"
ARRIVALS = "eventId long, stationId string, epiDistM double, predP double, probP double"


def _signals():
    """station -> channel -> (start, samples) stretches at 250 Hz; gaps between them."""
    rng = np.random.default_rng(7)
    make = lambda seconds: np.cumsum(rng.normal(0, 1, int(seconds * 250)))
    return {
        "A": {"HHZ": [(T0 + 3590.0, make(30)), (T0 + 3621.5, make(40))], "HHN": [(T0 + 3590.0, make(80))]},
        "B": {"HHE": [(T0 + 3600.0, make(60))], "HHX": [(T0 + 3600.0, make(60))]},
        "C": {"HHX": [(T0 + 3600.0, make(60))]},
        "D": {"HHZ": [(T0 + 3600.0, np.full(10_000, 3.0))]},
        "E": {"HHZ": [(T0 + 3612.0, make(1.0))]},
    }


def _files(signals):
    cut, rows = random.Random(3), []
    for station, channels in signals.items():
        for channel, stretches in channels.items():
            for start, x in stretches:
                i = 0
                while i < len(x):
                    n = cut.randint(200, 4000)
                    rows.append((station, channel, start + i / 250, 250.0, x[i : i + n].tolist()))
                    i += n
    cut.shuffle(rows)
    return rows


def _expected(signals, station, pred):
    """By hand: the channel, the longest stretch of the padded window, and its samples in the window."""
    low, high, w0, w1 = pred - 5.0, pred + 9.0, pred - 2.0, pred + 6.0
    for code in "ZNE":
        best = None
        for channel in sorted(c for c in signals.get(station, {}) if c.endswith(code)):
            cuts = []
            for start, x in signals[station][channel]:
                t = start + np.arange(len(x)) / 250
                inside = (t >= low - 1e-6) & (t <= high + 1e-6)
                if inside.any():
                    cuts.append((t[inside][0], x[inside]))
            if cuts:
                for first, x in cuts:
                    if len(x) < 2:
                        continue
                    at, y = _whole(x, first, 250.0, D.signal)
                    t = at + np.arange(len(y)) / 50
                    keep = (t >= w0 - 1e-6) & (t <= w1 + 1e-6)
                    if keep.sum() > 1 and (best is None or keep.sum() > len(best[1])):
                        best = t[keep][0], y[keep]
                if best is None:
                    return channel, "empty", None, None
                if len(best[1]) / 50 < 2.0:
                    return channel, "short", None, None
                return channel, "kept", best[0], best[1]
    return None, "no_data", None, None


def test_snippets_by_hand(spark):
    signals = _signals()
    arrivals = [(i, s, 100.0 * i, T0 + 3600.0 + dt, 0.5) for i, (s, dt) in enumerate([("A", 5.0), ("A", 19.0), ("A", 22.0), ("B", 10.0), ("C", 10.0), ("D", 10.0), ("E", 10.0), ("Z", 10.0), ("A", -11.0), ("B", 58.0)])]
    df = spark.createDataFrame([*arrivals, (90, "A", 1.0, None, None)], ARRIVALS)
    rows = {r.eventId: r for r in evidence.snippets(df, spark.createDataFrame(_files(signals), PIECES), D).collect()}
    assert len(rows) == 11 and rows[90].status == "no_data"
    seen = set()
    for i, s, _, pred, _ in arrivals:
        r = rows[i]
        channel, status, t0, y = _expected(signals, s, pred)
        if s == "D":
            status = "flat" if r.status == "flat" else status  # a constant less its line is nothing but rounding
        seen.add(r.status)
        assert (r.status, r.channel) == (status, channel)
        if r.status == "kept" and s != "D":
            got, want = np.array(r.samples), y / np.abs(y).max()
            assert r.t0 == pytest.approx(t0, abs=1e-6) and r.dt == 0.02 and len(got) == len(want)
            assert np.abs(got).max() == 1.0 and np.abs(got - want).max() < 3e-3
    assert {"kept", "no_data", "short"} <= seen


def test_files_keep_the_budget(spark):
    rows = [(e, f"S{i}", float((i * 7) % 10), [round(random.Random(i).random(), 3)] * (20 + i)) for e in (1, 2) for i in range(9)] + [(3, "é", 1.0, [0.5] * 500)]
    df = spark.createDataFrame(rows, "eventId long, stationId string, epiDistM double, samples array<double>")
    for most, size in ((5, 10_000), (20, 700), (20, 60)):
        got = {r.eventId: r for r in evidence.evidence_files(df, most, size, ["stationId", "epiDistM", "samples"]).collect()}
        for e in (1, 2, 3):
            traces = sorted(({"epiDistM": d, "samples": x, "stationId": s} for i, s, d, x in rows if i == e), key=lambda t: (t["epiDistM"], t["stationId"]))[:most]
            text = lambda t: json.dumps({"eventId": e, "traces": t}, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n"  # noqa: B023, E731
            while traces and len(text(traces).encode()) >= size:
                traces.pop()
            r = got[e]
            assert r.json == text(traces) and r.bytes == len(r.json.encode()) and r.nTraces == len(traces)
            assert r.nTraces + r.nDropped == sum(i == e for i, *_ in rows)
