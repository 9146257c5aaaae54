"""What a live service serves, as keyed state of a stream: last good window, history, staleness, and failover to a snapshot.

The input has a row for each attempt at a window and for each heartbeat of a feed.  State lives in Spark's state
store, so that a query restarted from its checkpoint serves what it served before.  Changes that time alone brings (a feed
falls silent, a window goes stale) take effect at their own instant in event time, by a timer or ahead of the next row, whichever comes first;
so how rows fall into batches changes nothing.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Outcomes whose window is served.
GOOD = ("ok", "empty")
ATTEMPTS = "feed string, kind string, at timestamp, outcome string, runId string, windowEnd timestamp, startedAt timestamp, runtimeS double, nEvents long"
SERVED = "feed string, at timestamp, why string, source string, runId string, nEvents long, latencyS double, slow boolean, stale boolean, attempts long, failures long, history array<string>"
_RUN = "runId string, nEvents long, at long"


def _ms(t: datetime | None) -> int | None:
    if t is None:
        return None
    t = t if t.tzinfo else t.astimezone(timezone.utc)
    return round(t.timestamp() * 1000)


#: Rows of a feed that are sorted in memory at once; more go to the task's own disk in sorted runs, which are merged.
HELD = 100_000


def _first(row: tuple) -> tuple:
    return row[:3]


def _stored(run: list[tuple], size: int):
    """A file of the run's rows in lists of `size`."""
    f = tempfile.TemporaryFile(prefix="feed-")  # in the executor's own folder, gone when it is closed
    for k in range(0, len(run), size):
        pickle.dump(run[k : k + size], f, pickle.HIGHEST_PROTOCOL)
    f.seek(0)
    return f


def _read_back(f) -> Iterator[tuple]:
    with f:
        while True:
            try:
                part = pickle.load(f)
            except EOFError:
                return
            yield from part


def in_order(rows: Iterable[tuple], held: int | None = None) -> Iterator[tuple]:
    """rows by their first three values, equal ones as they came; about `held` of them in memory, however many there are."""
    held, rows, runs = HELD if held is None else held, iter(rows), []
    while part := sorted(islice(rows, held), key=_first):
        if not runs and len(part) < held:
            return iter(part)
        runs.append(_stored(part, max(1, held // 100)))
        if len(runs) == 100:  # what is read of each run is a hundredth of what may be held
            runs = [_merged(runs, max(1, held // 100))]
    return heapq.merge(*map(_read_back, runs), key=_first)


def _merged(runs: list, size: int):
    """Sorted runs as one; the earlier run's rows come first of equal ones."""
    f, rows = tempfile.TemporaryFile(prefix="feed-"), heapq.merge(*map(_read_back, runs), key=_first)
    while part := list(islice(rows, size)):
        pickle.dump(part, f, pickle.HIGHEST_PROTOCOL)
    f.seek(0)
    return f


@dataclass
class _Feed:
    """A feed's state while its rows are handled; runs are (runId, nEvents, at), timers what was registered before."""

    alive: bool
    silent_at: int | None
    stale_at: int | None
    attempts: int
    failures: int
    latest: tuple
    snapshot: tuple
    past: list[str]
    timers: tuple


@dataclass
class Serving(StatefulProcessor):
    """history: newest attempts kept.  stale, silent, slow: seconds.  empty: whether windows without events become snapshots."""

    history: int = 20
    stale: float = 600.0
    silent: float = 60.0
    slow: float = 300.0
    empty: bool = False

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", _RUN)
        self.snapshot = handle.getValueState("snapshot", _RUN)
        self.past = handle.getListState("past", "line string")
        self.feed = handle.getValueState("feed", "alive boolean, silentAt long, staleAt long, attempts long, failures long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """Rows in order of time; for each the changes that time brought before it, and what is served from then on.

        State is read once and written once for all of a key's rows, of which about HELD are in memory.
        """
        yield from self.handled(key, ((_ms(r.at), r.kind, r.runId or "", r.runId, r.outcome, r.nEvents or 0, self._latency(r) if r.kind != "heartbeat" and r.outcome in GOOD else None) for r in rows))

    def handled(self, key, short: Iterable[tuple]) -> Iterator[Row]:
        """What is served after each of (at in ms, kind, runId or '', runId, outcome, nEvents, latency), in any order."""
        f = self._read()
        for at, kind, _, run_id, outcome, n, latency in in_order(short):
            yield from self._passed(f, key, at)
            slow = None
            if kind == "heartbeat":
                f.alive = outcome == "ok"
                f.silent_at = at + round(self.silent * 1000) + 1 if f.alive else None
            else:
                f.attempts += 1
                f.past = [f"{run_id}:{outcome}", *f.past][: self.history]
                if outcome in GOOD:
                    slow = latency > self.slow if latency is not None else None
                    f.latest = (run_id, n, at)
                    f.stale_at = at + round(self.stale * 1000) + 1
                    if n or self.empty:
                        f.snapshot = f.latest
                else:
                    f.failures += 1
            yield self._row(f, key, at, kind, latency, slow)
        self._write(f)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        f = self._read()
        yield from self._passed(f, key, expiredTimerInfo.getExpiryTimeInMs() + 1)
        self._write(f)

    def close(self) -> None:
        pass

    @staticmethod
    def _latency(r: Row) -> float | None:
        if r.runtimeS is None or r.startedAt is None or r.windowEnd is None:
            return None
        return r.runtimeS + (_ms(r.startedAt) - _ms(r.windowEnd)) / 1000

    def _read(self) -> _Feed:
        alive, silent_at, stale_at, attempts, failures = self.feed.get() if self.feed.exists() else (True, None, None, 0, 0)
        run = lambda state: tuple(state.get()) if state.exists() else (None, None, None)
        past = [x[0] for x in self.past.get()] if self.past.exists() else []
        return _Feed(alive, silent_at, stale_at, attempts, failures, run(self.latest), run(self.snapshot), past, (silent_at, stale_at))

    def _write(self, f: _Feed) -> None:
        self.feed.update((f.alive, f.silent_at, f.stale_at, f.attempts, f.failures))
        for state, run in ((self.latest, f.latest), (self.snapshot, f.snapshot)):
            if run[2] is not None:
                state.update(run)
        if f.past:
            self.past.put([(line,) for line in f.past])
        for old, new in zip(f.timers, (f.silent_at, f.stale_at)):
            if new is not None and new != old:
                self.handle.registerTimer(new)  # one that is no longer due finds nothing to change

    def _passed(self, f: _Feed, key, until: int) -> Iterator[Row]:
        """A silent feed and a stale window before an instant, each once and at its own time."""
        if (f.silent_at is None or f.silent_at >= until) and (f.stale_at is None or f.stale_at >= until):
            return
        for at, why in sorted((t, w) for t, w in ((f.silent_at, "silent"), (f.stale_at, "stale")) if t is not None and t < until):
            if why == "silent":
                f.alive, f.silent_at = False, None
            else:
                f.stale_at = None
            yield self._row(f, key, at, why, None, None)

    def _row(self, f: _Feed, key, at: int, why: str, latency, slow) -> Row:
        run = f.latest if f.alive else f.snapshot
        stale = run[2] is None or at - run[2] > self.stale * 1000
        return Row(feed=key[0], at=datetime.fromtimestamp(at / 1000, timezone.utc), why=why, source="live" if f.alive else "snapshot", runId=run[0], nEvents=run[1], latencyS=latency, slow=slow, stale=stale, attempts=f.attempts, failures=f.failures, history=list(f.past))


#: Rows that a feed hands on at once.
HANDED = 5_000
_TAKEN = ["feed", "at", "kind", "ms", "runId", "outcome", "nEvents", "latency"]


@dataclass
class _InFrames(StatefulProcessor):
    """A Serving whose rows come and go in frames: of a feed's answers, too, only some are in memory."""

    serving: Serving

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.serving.init(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._frames(self.serving.handled(key, (r for frame in rows for r in self._short(frame))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._frames(self.serving.handleExpiredTimer(key, timerValues, expiredTimerInfo))

    def close(self) -> None:
        pass

    @staticmethod
    def _short(frame: pd.DataFrame) -> Iterator[tuple]:
        run_ids, outcomes = (frame[c].astype(object).where(frame[c].notna(), None).tolist() for c in ("runId", "outcome"))
        latencies = frame["latency"].astype(object).where(frame["latency"].notna(), None).tolist()
        for at, kind, run_id, outcome, n, latency in zip(frame["ms"].tolist(), frame["kind"].tolist(), run_ids, outcomes, frame["nEvents"].tolist(), latencies):
            yield at, kind, run_id or "", run_id, outcome, n, latency if kind != "heartbeat" and outcome in GOOD else None

    @staticmethod
    def _frames(rows: Iterator[Row]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SERVED.split(", ")]
        while part := list(islice(rows, HANDED)):
            frame = pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(names, zip(*part))})
            frame["at"] = pd.to_datetime(frame["at"], utc=True)
            yield frame


def _millis(c: str) -> Column:
    return F.bround(F.unix_micros(c) / 1000.0).cast("long")


def served(attempts: DataFrame, serving: Serving, late: str = "10 seconds") -> DataFrame:
    """A stream of ATTEMPTS (kind 'window' or 'heartbeat') as a stream of SERVED, a row for each of them and for each change by time.

    `window`: latencyS is the run's time plus how far its data's end trailed its start.  A failed window changes history and counts
    alone.  A failed heartbeat, or none for `silent` seconds after a good one, turns to the newest snapshot; a good one
    turns back.  Rows later than `late` are left out.  Rows without a time, and of other kinds, are ignored.
    The session's state store must be RocksDB's (ROCKSDB).
    """
    rows = attempts.where("at IS NOT NULL AND kind IN ('window', 'heartbeat')").withWatermark("at", late)
    latency = F.col("runtimeS") + (_millis("startedAt") - _millis("windowEnd")) / 1000.0
    rows = rows.withColumns({"ms": _millis("at"), "latency": latency, "nEvents": F.coalesce("nEvents", F.lit(0).cast("long"))}).select(*_TAKEN)
    return rows.groupBy("feed").transformWithStateInPandas(_InFrames(serving), SERVED, "Append", "EventTime")
