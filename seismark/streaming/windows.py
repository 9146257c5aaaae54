"""Sliding windows over picks, in batch and as a stream, and the last good window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seismark.functions.tables import materialised


def sliding_counts(picks: DataFrame, length: int, every: int) -> DataFrame:
    """(start, phase, n): picks in each window [start, start + length) that begins at a multiple of `every`."""
    starts = F.transform(F.sequence(F.lit(0), F.lit(length // every - 1)), lambda k: ((F.floor(F.col("t") / every) - k) * every).cast("long"))
    return picks.withColumn("start", F.explode(starts)).groupBy("start", "phase").agg(F.count(F.lit(1)).alias("n"))


def stream_counts(picks: DataFrame, time: str, length: str, every: str, late: str) -> DataFrame:
    """The same over a stream with an event-time column; picks later than `late` are left out."""
    w = F.window(time, length, every)
    return picks.withWatermark(time, late).groupBy(w.alias("w"), "phase").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "phase", "n")


def window_bounds(now: Column, lag: float, length: float) -> Column:
    """[floor(now - lag) - length, floor(now - lag)] in whole seconds."""
    stop = F.floor(now - lag)
    return F.struct((stop - length).alias("start"), stop.alias("stop"))


class LastGood:
    """Serves the newest window whose run succeeded; keeps the newest `history` attempts.

    process() is a foreachBatch function.  A batch that fails, or takes longer than `most` seconds,
    leaves the served table alone; an attempt is recorded either way, once its outcome is known.
    """

    def __init__(self, run: Callable[[DataFrame], DataFrame], history: int, most: float, clock: Callable[[], float]):
        self.run, self.history, self.most, self.clock = run, history, most, clock
        self.served: DataFrame | None = None
        self.served_at: float | None = None
        self.attempts: list[dict] = []

    def process(self, batch: DataFrame, batch_id: int) -> None:
        began, error, made = self.clock(), None, None
        try:
            made = materialised(self.run(batch))
        except Exception as e:  # the window failed: what is served stays
            error = str(e)
        took = self.clock() - began
        if made is not None:
            self.served, self.served_at = made, self.clock()
        record = {"batch": batch_id, "outcome": "ok" if error is None else "failed", "runtimeS": took, "slow": took > self.most, "error": error}
        self.attempts = [*self.attempts, record][-self.history :]

    def stale(self, after: float) -> bool:
        return self.served_at is None or self.clock() - self.served_at > after
