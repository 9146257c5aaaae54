import numpy as np
import pytest
from pyspark.sql import functions as F

from seismark.operators import amplitude, inventory


def test_elevation(spark):
    rows = [(1, 1700.0, 0.0, 1702.0), (2, 1700.0, 300.0, 1998.0), (3, 1700.0, 300.0, 1699.0), (4, 1700.0, 15.0, 1708.0), (5, 1700.0, 5.0, 1730.0), (6, 1700.0, 5.0, 1900.0), (7, 1700.0, 300.0, 2500.0)]
    df = spark.createDataFrame(rows, "i int, s double, d double, dem double")
    of = lambda **k: {r.i: r.x for r in df.select("i", inventory.elevation_decision(F.col("s"), F.col("d"), F.col("dem"), tolerance=10.0, shallow=50.0, **k).alias("x")).collect()}
    got = of()
    assert [(got[i].convention, got[i].basis, got[i].flagged) for i in range(1, 8)] == [
        ("surface", "both-match", False), ("sensor", "dem", False), ("surface", "dem", False), ("sensor", "both-match", True) if abs(1700 + 15 - 1708) < abs(1700 - 1708) else ("surface", "both-match", True),
        ("surface", "shallow", True), ("surface", "shallow", True), ("dem", "assumed", True)]
    assert got[2].surfaceElevM == 2000.0 and got[2].sensorElevM == 1700.0
    assert of(on_shallow="dem")[6].convention == "dem" and of(on_ambiguous="skip")[7] is None
    with pytest.raises(Exception, match="neither"):
        of(on_ambiguous="error")


def test_triplets(spark):
    c = [(s, loc, code, comp, rate, dep) for s, loc, code, rate, dep, comps in [
        ("A", "00", "HH", 200.0, 0.0, "ZNE"), ("A", "00", "EH", 100.0, 0.0, "ZNE"), ("A", "01", "HN", 200.0, 0.0, "ZNE"), ("B", "", "HN", 200.0, 0.0, "Z12"), ("C", "00", "HH", 200.0, 0.0, "ZN"), ("D", "00", "HH", 10.0, 0.0, "ZNE"), ("E", "00", "HH", 200.0, 0.0, "ZNE"), ("E", "01", "HH", 200.0, 300.0, "ZNE"), ("E", "02", "HH", 200.0, 0.5, "ZNE")] for comp in comps]
    t = inventory.triplets(spark.createDataFrame([(*x[:3], x[3], x[4], x[5]) for x in c], "site string, location string, code string, component string, rateHz double, depthM double"), 1.0)
    kinds = spark.createDataFrame([("HH", "velocity", 0), ("EH", "velocity", 1), ("HN", "accelerometer", 2)], "code string, family string, place int")
    v = inventory.choose_triplets(t, kinds, F.when(F.col("rateHz") >= 50, "fast"), 1.0, 50.0)
    got = {(r.site, r.location, r.code): r.verdict for r in v.collect()}
    assert got == {("A", "00", "HH"): "kept", ("A", "00", "EH"): "lower priority at its location", ("A", "01", "HN"): "the site has a velocity triplet", ("B", "", "HN"): "kept", ("D", "00", "HH"): "no profile for the rate",
                   ("E", "00", "HH"): "kept", ("E", "01", "HH"): "kept", ("E", "02", "HH"): "same kind and depth"}
    assert {r.id for r in inventory.station_ids(v.where("verdict = 'kept'")).collect()} == {"A", "B", "E.00", "E.01"}


def test_explanations(spark):
    st = spark.createDataFrame([(i, 1000.0 * i, 0.0, 1.75) for i in range(1, 8)] + [(9, 90_000.0, 0.0, 1.75)], "stationId long, e double, n double, vpvs double")
    rows = [(1, "P", 0.2, 20), (2, "P", 0.21, 20), (3, "P", 0.19, 20), (5, "P", -0.1, 20), (5, "S", -0.175, 20), (6, "P", 0.1, 2), (6, "S", 0.1, 2), (9, "P", -0.3, 20)]
    out = inventory.explain_terms(spark.createDataFrame(rows, "stationId long, phase string, term double, nEvents long"), st, flag=0.08, least=5, k=2, max_dist=2500.0, lateral=0.5, ratio_floor=0.05, band=1.2, far=50_000.0)
    got = {(r.stationId, r.phase): r.verdict for r in out.collect()}
    assert got[1, "P"] == "lateral" and got[5, "P"] == "path" and got[6, "S"] == "timing" and got[9, "P"] == "far"


def test_amplitudes(spark):
    """A sine of ground velocity gives the instrument's closed-form amplitude."""
    rate, f, v = 100.0, 5.0, 1e-6
    t = np.arange(3000) / rate
    live = (t > 15) & (t < 25)
    x = 1e9 * v * np.sin(2 * np.pi * f * t) * np.where(live, 1, 0.001)
    w = amplitude.Instrument()
    row = lambda e, h1, h2: (e, 1, h1, h2, 0.0, rate, [], [], 1e9, 1, 2.5, 12.0, 17.0, 23.0)
    rows = [row(1, x.tolist(), (x * 0).tolist()), row(2, (x * 1e5).tolist(), x.tolist()), row(3, None, x.tolist()), row(4, (x * 0).tolist(), (x * 0).tolist()), row(5, np.sin(2 * np.pi * f * t).tolist(), (x * 0).tolist())]
    df = spark.createDataFrame(rows, "eventId long, stationId long, h1 array<double>, h2 array<double>, start double, rateHz double, zeros array<double>, poles array<double>, gain double, integrations int, noiseStart double, noiseEnd double, signalStart double, signalEnd double")
    got = {r.eventId: r for r in amplitude.measure(df).collect()}
    s, w0 = 2j * np.pi * f, 2 * np.pi / w.period
    want = abs(w.gain * s**2 / (s**2 + 2 * w.damping * w0 * s + w0**2)) * v / (2 * np.pi * f) * 1000
    assert got[1].status == "ok" and got[1].ampMm == pytest.approx(want, rel=0.02)
    assert [got[i].status for i in (2, 3, 4, 5)] == ["clipped", "gap", "flat", "lowSnr"]
