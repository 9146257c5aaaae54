"""Synthetic recovery: every event, its nearest stations, P and S, with and without noise."""

import math

import numpy as np

from seismark.operators import iterative, location
from seismark.plans import adapters, registry
from tests.conftest import TINY

LAYERS = location.Layers((2000.0, 1500.0, 800.0, -500.0), (2500.0, 3500.0, 4800.0, 5800.0), (1400.0, 2000.0, 2800.0, 3350.0))


def test_arrivals(spark):
    rng = np.random.default_rng(8)
    net = [(i, *map(float, rng.uniform(-4000, 4000, 2)), float(rng.uniform(1600, 1900))) for i in range(30)]
    net.append((30, *net[3][1:]))  # at the same place: the lower id is nearer
    truth = iterative.synthetic_events(spark, 40, 3, 2000.0, 0.0, -1500.0)
    stations = spark.createDataFrame(net, "stationId long, e double, n double, elevM double")
    got = iterative.synthetic_arrivals(truth, stations, LAYERS, nearest=5, keep_s=0.5, sigma=(0.02, 0.04), seed=7).toPandas()
    rows = {(r.eventId, r.stationId, r.phase): r.t for r in got.itertuples()}
    want, off = set(), {"P": [], "S": []}
    for x in truth.collect():
        assert math.hypot(x.e, x.n) <= 2000 and -1500 <= x.z <= 0
        for s, e, n, elev in sorted(net, key=lambda s: (math.hypot(x.e - s[1], x.n - s[2]), s[0]))[:5]:
            for phase in "PS":
                if phase == "S" and (2 * x.eventId, s, "S") not in rows:
                    continue
                want |= {(2 * x.eventId, s, phase), (2 * x.eventId + 1, s, phase)}
                t = location.first_arrival(LAYERS, phase, math.hypot(x.e - e, x.n - n), x.z, elev)[0]
                assert abs(rows[2 * x.eventId, s, phase] - t) < 1e-9
                off[phase].append(rows[2 * x.eventId + 1, s, phase] - t)
    assert set(rows) == want and len(got) == len(want)
    assert 70 < len(off["S"]) < 130 and len(off["P"]) == 200
    assert 0.015 < np.std(off["P"]) < 0.025 and 0.03 < np.std(off["S"]) < 0.05


def test_every_located_event_is_recovered(spark):
    rows = {r.noisy: r for r in registry.queries()["q92_synthetic_recovery"](spark, TINY).collect()}
    n = adapters.located(spark, TINY).count()
    assert rows[False].n == rows[True].n == n
    assert rows[False].medianH < 50 and rows[False].medianH < rows[True].medianH
