import numpy as np

from seismark.operators import evidence
from seismark.operators.chunks import Preparation

D = evidence.Display(before=2.0, after=6.0, pad=3.0, least=2.0, signal=Preparation(rate=50.0, high=18.0, low=2.0))


def test_arrivals_of_one_station_and_time_share_a_snippet(spark, monkeypatch):
    asked = []
    real = evidence.windows_and_pieces
    monkeypatch.setattr(evidence, "windows_and_pieces", lambda a, *more: asked.append(a.count()) or real(a, *more))
    x = np.cumsum(np.random.default_rng(1).normal(0, 1, 15_000)).tolist()
    pieces = spark.createDataFrame([("A", "HHZ", 3600.0, 250.0, x)], "stationId string, channel string, start double, rate double, samples array<double>")
    arrivals = spark.createDataFrame([(i, "A", 3625.0 + (i == 9)) for i in range(10)] + [(10, "B", 3625.0), (11, "A", None)], "eventId long, stationId string, predP double")
    rows = {r.eventId: r for r in evidence.snippets(arrivals, pieces, D).collect()}
    assert asked == [3] and len(rows) == 12
    assert all(rows[i].status == "kept" and rows[i].samples == rows[0].samples for i in range(9))
    assert rows[9].status == "kept" and rows[9].samples != rows[0].samples
    assert rows[10].status == rows[11].status == "no_data"
