"""A feed's rows are put in order without all of them in memory."""

import random
import tracemalloc
from datetime import datetime, timedelta, timezone

from pyspark.sql import Row

from seismark.streaming import serving


def test_rows_come_in_order_with_few_in_memory():
    rng = random.Random(2)
    rows = [(rng.randrange(500), rng.choice(("heartbeat", "window")), rng.choice("ab"), i, None, 0, None) for i in range(5000)]
    for held in (1, 7, 400, 5000, 5001):
        assert list(serving.in_order(iter(rows), held)) == sorted(rows, key=lambda r: r[:3])  # equal ones as they came
    assert list(serving.in_order(iter([]), 5)) == []


def test_memory_does_not_grow_with_a_feeds_rows():
    def peak(n):
        rng = random.Random(3)
        rows = ((rng.randrange(10**12), "window", str(i), str(i), "ok", 0, None) for i in range(n))
        tracemalloc.start()
        assert sum(1 for _ in serving.in_order(rows, 2000)) == n
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(80_000) < 2 * peak(10_000)


def test_a_served_feed_holds_few_rows(monkeypatch):
    from tests.test_serving_state import _State

    seen = []
    monkeypatch.setattr(serving, "HELD", 10)
    monkeypatch.setattr(serving, "_stored", lambda run, size, real=serving._stored: seen.append(len(run)) or real(run, size))

    class Handle:
        getValueState = getListState = lambda self, *_: _State([])
        registerTimer = lambda self, _: None

    at = [datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=k) for k in range(95)]
    rows = [Row(at=t, kind="window", outcome="ok", runId=str(k), windowEnd=t, startedAt=t, runtimeS=1.0, nEvents=1) for k, t in enumerate(at)]
    random.Random(1).shuffle(rows)
    p = serving.Serving()
    p.init(Handle())
    out = list(p.handleInputRows(("a",), iter(rows), None))
    assert [r.runId for r in out if r.why == "window"] == [str(k) for k in range(95)] and max(seen) == 10


def test_answers_are_handed_on_before_the_last_is_made(monkeypatch):
    """A feed of any length hands on frames of some rows; Spark's rows of a feed would all be put together first."""
    monkeypatch.setattr(serving, "HANDED", 10)
    made = []

    def rows():
        for k in range(95):
            made.append(k)
            yield Row(feed="a", at=datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=k), why="window", source="live", runId=None, nEvents=None, latencyS=None, slow=None, stale=True, attempts=k, failures=0, history=[])

    frames = serving._InFrames._frames(rows())
    assert len(next(frames)) == 10 and len(made) == 10
    assert [len(f) for f in frames] == [10] * 8 + [5]
