"""The calibration against the same iteration over the dense system, run until it stands still."""

import numpy as np
import pytest

from seismark.operators import stats
from seismark.plans import adapters, registry
from tests.conftest import TINY


def dense(obs, ridge=1.0, least=3, scale=0.3):
    n = obs.groupby("stationId").size()
    names = sorted(n[n >= least].index)
    obs = obs[obs.stationId.isin(names)]
    a = np.zeros((len(obs), len(names) + 2))
    a[:, 0], a[:, 1] = obs.logR, 1
    a[np.arange(len(obs)), obs.stationId.map({s: i + 2 for i, s in enumerate(names)})] = 1
    d, x, damp = (obs.mag - obs.logA).to_numpy(), np.zeros(len(names) + 2), np.diag([0, 0] + [ridge] * len(names))
    for _ in range(500):
        w = 1 / np.sqrt(1 + ((d - a @ x) / scale) ** 2)
        new = np.linalg.solve(a.T @ (a * w[:, None]) + damp, a.T @ (w * d))
        if np.abs(new - x).max() < 1e-12:
            return names, new
        x = new
    raise AssertionError("not converged")


def test_query_has_converged(spark):
    names, x = dense(adapters.observations(spark, TINY).toPandas())
    got = {(r.kind, r.stationId): r.value for r in registry.queries()["q87_calibration"](spark, TINY).collect()}
    want = {("b", None): x[0], ("c", None): x[1]} | {("term", s): t for s, t in zip(names, x[2:])}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 5.1e-5 for k in want)


def test_limits(spark):
    obs = adapters.observations(spark, TINY)
    with pytest.raises(ArithmeticError):
        stats.fit_calibration(obs, rounds=5)
    assert stats.fit_calibration(obs.limit(0)) == ({"b": 0.0, "c": 0.0}, {})
