import random

import numpy as np
import pytest

from seismark.operators import chunks
from seismark.operators.chunks import Preparation, prepared_chunks, read_groups

SCHEMA = "stationId string, channel string, start double, rate double, samples array<double>"
T0 = 1704067200.0


def _whole(x, start, rate, p):
    """The uncut segment by plain sums: line, taper, kernel at each place of the output's grid."""
    n = len(x)
    t = np.arange(n)
    line = np.polyfit(t, x, 1) if n > 1 else [0, x[0]]
    x = x - np.polyval(line, t)
    ramp = min(p.taper * rate, p.share * n)
    if ramp >= 1:
        x = x * np.sin(np.pi / 2 * np.clip(np.minimum(t, n - 1 - t) / ramp, 0, 1)) ** 2
    times = start + t / rate
    m = np.arange(np.ceil(start * p.rate - 1e-6), np.floor(times[-1] * p.rate + 1e-6) + 1)
    grid = np.arange(int(np.floor(-p.reach * rate)) - 1, int(np.ceil(p.reach * rate)) + 2)
    out = []
    for g in m / p.rate:
        near = slice(max(0, int((g - start - p.reach) * rate) - 2), int((g - start + p.reach) * rate) + 3)
        frac = (g - start) * rate
        norm = chunks.kernel((grid - (frac - np.floor(frac))) / rate, p).sum() if not p.low else rate
        out.append((x[near] * chunks.kernel(times[near] - g, p)).sum() / norm)
    return m[0] / p.rate, np.array(out)


def _together(rows):
    """Chunks of each segment put together; neighbours must touch."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.stationId, r.channel, r.run, r.chunk)):
        key = r.stationId, r.channel, r.run
        if key in out:
            start, x = out[key]
            assert abs(start + len(x) / 100 - r.start) < 1e-6
            out[key] = start, np.concatenate([x, r.samples])
        else:
            out[key] = r.start, np.array(r.samples)
    return out


@pytest.mark.parametrize(("rate", "low"), [(500.0, 0.0), (250.0, 2.0), (120.0, 0.0), (100.0, 0.0)])
def test_cut_anywhere(spark, rate, low):
    """Files cut at random, some of them overlapping with the same samples, give the samples of the uncut segments; gaps stay."""
    p = Preparation(low=low, chunk=7.0, least=1.0)
    rng = np.random.default_rng(int(rate))
    cut = random.Random(int(rate))
    pieces, want = [], {}
    for channel, offset in (("Z", 0.0), ("N", 0.3)):
        at = T0 + offset / rate
        for seconds in (23.0, 0.4, 31.7):
            x = np.cumsum(rng.normal(0, 1, int(seconds * rate))) + 500
            i = 0
            while i < len(x):
                n = cut.randint(1, int(6 * rate))
                back = min(i, cut.choice((0, 0, 5)))
                pieces.append(("A", channel, at + (i - back) / rate, rate, x[i - back : i + n].tolist()))
                i += n
            if seconds >= 1:
                want["A", channel, round(at * rate)] = _whole(x, at, rate, p)
            at += (len(x) + cut.randint(2, 300)) / rate
    cut.shuffle(pieces)
    df = spark.createDataFrame([*pieces, ("A", "Z", T0, rate, []), ("A", "Z", T0, rate, None)], SCHEMA)
    got = _together(prepared_chunks(df, p).collect())
    assert got.keys() == want.keys()
    for key, (start, x) in want.items():
        assert got[key][0] == pytest.approx(start, abs=1e-6) and len(got[key][1]) == len(x)
        assert np.abs(got[key][1] - x).max() < 2e-3 * np.abs(x).max()  # times since the epoch are known to a few 1e-7 s
    assert sorted((r.channel, round(r.seconds, 3)) for r in chunks.short_runs(df, p).collect()) == [("N", 0.4), ("Z", 0.4)]


def test_files_of_a_day_or_one(spark):
    """The same signal as one piece and as many: the same chunks to the last digits."""
    p = Preparation(chunk=5.0)
    x = np.random.default_rng(1).normal(0, 1, 20_000)
    rows = lambda edges: [("A", "Z", T0 + a / 500, 500.0, x[a:b].tolist()) for a, b in zip(edges, edges[1:])]
    one, many = (_together(prepared_chunks(spark.createDataFrame(rows(e), SCHEMA), p).collect()) for e in ([0, 20_000], [0, 1, 7000, 7001, 12_345, 20_000]))
    assert one.keys() == many.keys() and all(np.abs(one[k][1] - many[k][1]).max() < 1e-9 for k in one)
    sine = spark.createDataFrame([("A", "Z", T0, 500.0, np.sin(2 * np.pi * 10 * np.arange(10_000) / 500).tolist())], SCHEMA)
    start, y = next(iter(_together(prepared_chunks(sine, Preparation(chunk=3.0)).collect()).values()))
    t = start - T0 + np.arange(len(y)) / 100
    assert np.abs(y - np.sin(2 * np.pi * 10 * t))[200:-200].max() < 0.02


def test_errors(spark):
    a = ("A", "Z", T0, 100.0, [1.0] * 300)
    for other, says in ((("A", "Z", T0 + 1, 100.0, [2.0] * 300), "different samples"), (("A", "Z", T0 + 1.003, 100.0, [1.0] * 300), "different grids"), (("A", "Z", T0 + 9, 50.0, [1.0] * 300), "different rates")):
        with pytest.raises(Exception, match=says):
            prepared_chunks(spark.createDataFrame([a, other], SCHEMA), Preparation()).collect()
    with pytest.raises(ValueError):
        chunks.ratio(99.0, 100.0)
    with pytest.raises(ValueError):
        chunks.ratio(100.0 * np.pi, 100.0)
    assert chunks.ratio(250.0, 100.0) == (5, 2) and chunks.ratio(1000.0, 100.0) == (10, 1)


def _groups(windows, span):
    out, start, stop = {}, None, None
    for i, s, e in sorted(windows, key=lambda w: (w[1], w[2], w[0])):
        if start is None or max(stop, e) - start > span:
            start, stop = s, e
        else:
            stop = max(stop, e)
        out[i] = start
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_read_groups_by_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = []
    for station, wide in (("A", 40.0), ("B", 3.0), ("C", 2000.0)):
        for i in range(120):
            s = round(rng.uniform(0, wide * 20), 1)
            rows.append((len(rows), station, s, s + rng.choice((0.0, 1.0, 5.0, 30.0, 70.0))))
    rows += [(1000, "D", -5.0, -4.0), (1001, "A", 0.0, 60.0), (1002, "A", 0.0, 60.0)]
    got = {r.id: r.groupStart for r in read_groups(spark.createDataFrame(rows, "id long, stationId string, start double, stop double"), 60.0).collect()}
    want = {}
    for station in "ABCD":
        want |= _groups([(i, s, e) for i, x, s, e in rows if x == station], 60.0)
    assert got == want
