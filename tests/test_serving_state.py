from datetime import datetime, timedelta, timezone

from pyspark.sql import Row

from seismark.streaming.serving import Serving


class _State:
    """A value or a list of the state store, in memory, that counts how often it is asked or changed."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    put = update


def test_state_is_read_and_written_once_for_many_rows():
    calls = []

    class Handle:
        getValueState = getListState = lambda self, *_: _State(calls)
        registerTimer = lambda self, _: calls.append("timer")

    def row(k):
        at = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=k)
        return Row(at=at, kind="heartbeat" if k % 2 else "window", outcome="ok", runId=str(k), windowEnd=at, startedAt=at, runtimeS=1.0, nEvents=1)

    p = Serving()
    p.init(Handle())
    out = list(p.handleInputRows(("a",), iter([row(k) for k in range(100)]), None))
    assert len(out) == 100 and out[-1].attempts == 50 and out[-1].runId == "98"
    assert len(calls) <= 12
