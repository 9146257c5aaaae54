from datetime import datetime, timedelta, timezone

import pytest

from seismark.streaming.serving import ATTEMPTS, ROCKSDB, Serving, served

BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return None if seconds is None else BEGIN + timedelta(seconds=seconds)


def window(seconds, outcome, run, n=3, feed="A", took=20.0, lag=40.0):
    return (feed, "window", at(seconds), outcome, run, at(seconds - took - lag), at(seconds - took), took, n)


def beat(seconds, ok=True, feed="A"):
    return (feed, "heartbeat", at(seconds), "ok" if ok else "failed", None, None, None, None, None)


class Stream:
    """Batches of rows through a file source; each run starts the query anew from its checkpoint."""

    def __init__(self, spark, folder, serving):
        self.spark, self.folder, self.serving, self.n = spark.newSession(), folder, serving, 0
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        self.spark.conf.set("spark.sql.shuffle.partitions", "2")

    def run(self, *batches):
        for rows in batches:
            self.n += 1
            self.spark.createDataFrame(rows, ATTEMPTS).coalesce(1).write.parquet(f"{self.folder}/in/{self.n}")
        source = self.spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{self.folder}/in")
        q = served(source, self.serving).writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        return self.rows()

    def rows(self, feed="A"):
        found = [r for r in self.spark.read.parquet(f"{self.folder}/out").collect() if r.feed == feed]
        seconds = lambda r: r.at.astimezone(timezone.utc).timestamp() - BEGIN.timestamp()
        return sorted((seconds(r), r.why, r) for r in found)


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    s = Stream(spark, str(tmp_path_factory.mktemp("stream")), Serving(history=3, stale=100.0, silent=30.0, slow=50.0))
    s.run([beat(0), window(1, "ok", "r1")], [beat(20), window(40, "failed", "r2"), window(41, "ok", "b1", feed="B")])
    return s, s.run([beat(45, ok=False), beat(50), window(60, "empty", "r3", n=0, took=5.0)], [beat(300)])


def test_last_good_survives_failures_and_a_restart(run):
    _, rows = run
    by = {(t, why): r for t, why, r in rows}
    assert by[1.0, "window"].runId == "r1" and by[1.0, "window"].latencyS == 60.0 and by[1.0, "window"].slow
    failed = by[40.0, "window"]
    assert (failed.runId, failed.attempts, failed.failures, failed.latencyS) == ("r1", 2, 1, None)
    # The second run of the query starts from the checkpoint: history goes on, newest first.
    assert by[60.0, "window"].history == ["r3:empty", "r2:failed", "r1:ok"] and not by[60.0, "window"].slow
    assert (by[60.0, "window"].runId, by[60.0, "window"].nEvents) == ("r3", 0)


def test_failover_and_return_by_heartbeat(run):
    _, rows = run
    by = {(t, why): r for t, why, r in rows}
    assert by[45.0, "heartbeat"].source == "snapshot" and by[45.0, "heartbeat"].runId == "r1"
    assert by[50.0, "heartbeat"].source == "live"
    # Silent 30 s after the heartbeat of 50: the newest snapshot is r1, as r3 was empty; then the last window goes stale.
    silent = next(r for t, why, r in rows if why == "silent" and t > 50)
    assert (silent.source, silent.runId) == ("snapshot", "r1")
    assert [round(t, 2) for t, why, _ in rows if why == "silent"] == [80.0]
    assert [round(t, 2) for t, why, _ in rows if why == "stale"] == [160.0]
    assert by[300.0, "heartbeat"].source == "live" and by[300.0, "heartbeat"].stale


def test_history_is_a_ring_and_feeds_are_apart(run):
    s, rows = run
    assert max(len(r.history) for _, _, r in rows) == 3
    assert [(r.runId, r.attempts) for _, why, r in s.rows("B") if why == "window"] == [("b1", 1)]


def test_batches_change_nothing(spark, tmp_path):
    """The same rows one by one and all at once give the same rows; the timer fires where no row comes."""
    rows = [beat(0), window(1, "ok", "r1"), window(35, "ok", "r2"), beat(36), window(80, "failed", "r3"), beat(200, ok=False), window(210, "ok", "r4"), beat(1000)]
    out = []
    for name, batches in (("one", [rows]), ("many", [[r] for r in rows])):
        got = Stream(spark, str(tmp_path / name), Serving(history=2, stale=100.0, silent=30.0)).run(*batches)
        out.append([(round(t, 3), why, r.source, r.runId, r.stale, r.attempts, r.failures, tuple(r.history)) for t, why, r in got])
    assert out[0] == out[1]
    assert [why for _, why, *_ in out[0]].count("silent") == 2
