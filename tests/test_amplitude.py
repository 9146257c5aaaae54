"""Simulated amplitudes against the equations of motion, step by step."""

import numpy as np
import pytest

from seismark.operators import amplitude

WINDOWS = "eventId long, stationId long, h1 array<double>, h2 array<double>, start double, rateHz double, zeros array<double>, poles array<double>, gain double, integrations int, noiseStart double, noiseEnd double, signalStart double, signalEnd double"
RATE, FINE = 100.0, 20


def burst(t: np.ndarray) -> np.ndarray:
    """Ground velocity in m/s: a weak hum, and 5 Hz around the 20th second."""
    return 1e-6 * (np.exp(-(((t - 20) / 1.5) ** 2)) + 0.01) * np.sin(2 * np.pi * 5 * t)


def swung(force, n: int, a: float, b: float) -> tuple[np.ndarray, np.ndarray]:
    """x and its velocity at n samples, for x'' + a x' + b x = force(t), by Runge and Kutta's rule."""
    h = 1 / (RATE * FINE)
    deriv = lambda t, y: np.array([y[1], force(t) - a * y[1] - b * y[0]])
    y, out = np.zeros(2), []
    for k in range(n * FINE):
        if k % FINE == 0:
            out.append(y)
        t = k * h
        k1 = deriv(t, y)
        k2 = deriv(t + h / 2, y + h / 2 * k1)
        k3 = deriv(t + h / 2, y + h / 2 * k2)
        k4 = deriv(t + h, y + h * k3)
        y = y + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
    x = np.array(out)
    return x[:, 0], x[:, 1]


@pytest.fixture(scope="module")
def motion():
    """Velocity, what a 1 Hz geophone makes of it, and the simulated instrument's trace in mm."""
    n, w = 4000, amplitude.Instrument()
    v = burst(np.arange(n) / RATE)
    turn = 2 * np.pi
    x, dx = swung(burst, n, 2 * 0.7 * turn, turn**2)
    geophone = v - 2 * 0.7 * turn * dx - turn**2 * x  # s^2 / (s^2 + a s + b) of v
    needle = 2 * np.pi / w.period
    return v, geophone, w.gain * swung(burst, n, 2 * w.damping * needle, needle**2)[1] * 1000


def window(event, h1, h2, zeros=(), poles=(), gain=1e9, start=0.0, noise=(2.5, 12.0), signal=(17.0, 23.0)):
    return (event, 1, None if h1 is None else np.asarray(h1).tolist(), None if h2 is None else np.asarray(h2).tolist(), start, RATE, list(zeros), list(poles), gain, 1, *noise, *signal)


def test_equations_of_motion(spark, motion):
    """Flat response and a geophone's poles, alone and along both sides, at shifted starts, long and short."""
    v, geophone, needle = motion
    turn = 2 * np.pi
    root = turn * (-0.7 + 1j * np.sqrt(1 - 0.49))
    poles = [float(x) for x in (root.real, root.imag, root.real, -root.imag)]
    rows = [
        window(1, 1e9 * v, 0 * v), window(2, 1e9 * geophone, 0 * v, [0.0] * 4, poles), window(3, 3e8 * v, 4e8 * v), window(4, 1e9 * v, (1e9 * v)[:2600], start=500.0, noise=(502.5, 512.0), signal=(517.0, 523.0)),
        window(5, 1e9 * v + 7000 + np.arange(4000) * 0.5, 0 * v), window(6, 1e9 * v[1000:3000], 0 * v[1000:3000], noise=(2.0, 4.0), signal=(7.0, 13.0)),
    ]
    got = {r.eventId: r for r in amplitude.measure(spark.createDataFrame(rows, WINDOWS).repartition(2)).collect()}
    top = np.abs(needle[1700:2301]).max()
    for event, want in [(1, top), (2, top), (3, top / 2), (5, top), (6, top)]:
        assert got[event].status == "ok" and got[event].ampMm == pytest.approx(want, rel=0.01)
    assert got[4].ampMm == pytest.approx(top * np.sqrt(2), rel=0.01)
    assert got[1].noiseMm == pytest.approx(np.abs(needle[250:1201]).max(), rel=0.05) and got[1].snr == got[1].ampMm / got[1].noiseMm
    assert got[1].peakCounts == pytest.approx(np.abs(1e9 * v).max()) and got[1].wetLowHz is None


def test_many_together_as_alone(spark, motion, monkeypatch):
    """Matrices of any height give the same rows."""
    v = motion[0]
    rng = np.random.default_rng(0)
    rows = [window(i, 1e9 * v[: 3000 - i % 3] * rng.random(), 1e9 * v[: 3000 - i % 3] * rng.random(), gain=1e9 + i % 2) for i in range(17)]
    df = spark.createDataFrame(rows, WINDOWS)
    table = lambda: sorted((r.eventId, r.status, round(r.ampMm, 12), round(r.snr, 6)) for r in amplitude.measure(df).collect())
    together = table()
    monkeypatch.setattr(amplitude, "MATRIX", 1)
    assert table() == together and len(together) == 17


def test_verdicts(spark, motion):
    v = motion[0]
    hum = 1e9 * 1e-6 * np.sin(2 * np.pi * 5 * np.arange(4000) / RATE)
    gone, broken = (1e9 * v).tolist(), (1e9 * v).tolist()
    gone[5], broken[5] = None, float("nan")
    rows = [
        window(1, v * 1e14, v), window(2, None, v), window(3, 0 * v, 0 * v), window(4, hum, 0 * hum), window(5, [1.0, 2.0, 3.0], v), window(6, gone, v), window(7, broken, v),
        window(8, 1e9 * v, v, noise=(90.0, 95.0)), window(9, 1e9 * v, v, signal=(90.0, 95.0)), window(10, [], []), window(1, v * 1e14, v),
    ]
    got = sorted((r.eventId, r.status, r.ampMm is None) for r in amplitude.measure(spark.createDataFrame(rows, WINDOWS)).collect())
    assert got == sorted([(1, "clipped", True)] * 2 + [(3, "flat", False), (4, "lowSnr", False)] + [(i, "gap", True) for i in (2, 5, 6, 7, 8, 9, 10)])
    assert amplitude.measure(spark.createDataFrame([], WINDOWS)).count() == 0


def test_water_level():
    """A response that falls by four powers of ten below 10 Hz is held there, and the held part of the band is told."""
    a = amplitude.Alike(4000, RATE, (0.0, 0.0) * 6, (-2 * np.pi * 10, 0.0) * 6, 1e9, 1)
    low, high = amplitude.trace_filter(a, amplitude.Instrument()).wet
    f = np.fft.rfftfreq(8000, 1 / RATE)[1:]
    size = (f / np.hypot(f, 10)) ** 6
    held = f[(size < size.max() / 1000) & (f >= 1) & (f <= 20)]
    assert (low, high) == (held.min(), held.max()) and low == 1.0 and high < 5
