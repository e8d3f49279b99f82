"""Committing offsets that finish out of order: a window a partition, flushed by a timer and when the consumer stops.

A partition's state, in Spark's state store, is its last commit and the runs of finished offsets beyond it; it grows with the
gaps, not with the records.  The part without a gap is committed when ``window`` offsets are finished, when the
partition has waited ``patience`` for that, or by whoever stops the query, from the state that its checkpoint holds.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .consume import PARTITION

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "waiting"
_COMMITS = "topic string, partition int, commit long, why string"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started, and states read, within this keep their state in RocksDB, as timers need it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _commit_window(window: int, patience_ms: int | None) -> StatefulProcessor:
    """State of one partition: commits the gap-free part of what is finished.

    The class is made here so that it goes by value to Spark's own Python process on the driver, which can't import this package."""

    def merged(runs: np.ndarray) -> np.ndarray:
        runs = runs[np.argsort(runs[:, 0], kind="stable")]
        to = np.maximum.accumulate(runs[:, 1])
        first = np.flatnonzero(np.append(True, runs[1:, 0] > to[:-1]))
        return np.column_stack([runs[first, 0], to[np.append(first[1:], len(runs)) - 1]])

    class CommitWindow(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("waiting", "at long, lo array<long>, hi array<long>")

        def commit(self, key: tuple, runs: np.ndarray, why: str) -> pd.DataFrame:
            at, runs = int(runs[0, 1]), runs[1:]
            self.state.update((at, runs[:, 0].tolist(), runs[:, 1].tolist()))
            return pd.DataFrame({"topic": [key[0]], "partition": [key[1]], "commit": [at], "why": [why]})

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            parts = list(rows)
            at, runs = int(parts[0]["start"].iloc[0]), np.zeros((0, 2), dtype=np.int64)
            if self.state.exists():
                at, lo, hi = self.state.get()
                runs = np.array([lo, hi], dtype=np.int64).reshape(2, -1).T
            for part in parts:
                new = part["offset"].to_numpy(dtype=np.int64)
                runs = np.concatenate([runs, np.column_stack([new, new + 1])[new >= at]])
            runs = merged(runs) if len(runs) else runs
            timers = [] if patience_ms is None else list(self.handle.listTimers())
            if len(runs) and runs[0, 0] == at and (runs[:, 1] - runs[:, 0]).sum() >= window:
                for timer in timers:
                    self.handle.deleteTimer(timer)
                yield self.commit(key, runs, "window")
                return
            self.state.update((at, runs[:, 0].tolist(), runs[:, 1].tolist()))
            if patience_ms is not None and len(runs) and not timers:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + patience_ms)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            at, lo, hi = self.state.get()
            if len(lo) and lo[0] == at:
                yield self.commit(key, np.array([lo, hi], dtype=np.int64).T, "timer")
            elif len(lo):  # a gap right after the commit: wait on
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + patience_ms)

        def close(self) -> None:
            pass

    return CommitWindow()


def windowed_commits(finished: DataFrame, starts: DataFrame, window: int = 0, patience_ms: int | None = None) -> DataFrame:
    """(topic, partition, commit, why) of a stream (topic, partition, offset), in update mode; why: window or timer.

    ``starts``: (topic, partition, start); partitions without one are left out.  With ``patience_ms`` batches go on without
    new records, so such a query has to be stopped (``stopped``)."""
    rows = finished.select("topic", F.col("partition").cast("int").alias("partition"), F.col("offset").cast("long").alias("offset")).where("offset is not null")
    rows = rows.join(starts.select("topic", F.col("partition").cast("int").alias("partition"), F.col("start").cast("long").alias("start")), PARTITION)
    mode = "none" if patience_ms is None else "processingTime"
    return rows.groupBy(*PARTITION).transformWithStateInPandas(_commit_window(window, patience_ms), _COMMITS, "update", mode)


def waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(topic, partition, at, lo, hi) of a stopped query: last commits and the runs of finished offsets beyond them."""
    with state_store(spark):
        state = spark.read.format("statestore").option("stateVarName", STATE).load(checkpoint)
        return state.select("key.topic", "key.partition", "value.at", "value.lo", "value.hi")


def flushed(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(topic, partition, commit): what a stopped query may still commit, from the state in its checkpoint.

    The state stays as it is: a query that starts again from the checkpoint commits from there on, never less."""
    first = F.get("lo", F.lit(0)) == F.col("at")
    return waiting(spark, checkpoint).where(first).select("topic", "partition", F.get("hi", F.lit(0)).alias("commit"))


class Settled:
    """Tells when a query of ``windowed_commits`` with patience has committed all that its records allow.

    That is so once ``rows`` records are read and a batch is done that began when the timers of the last batch with records were due:
    not a matter of how long the batches take.  The query's handler has to be the one of ``handler``."""

    def __init__(self, rows: int, patience_ms: int):
        self.rows, self.patience = rows, patience_ms / 1000 + 0.1
        self.called: dict[int, float] = {}
        self.ended: dict[int, float] = {}
        self.read: dict[int, int] = {}

    def handler(self, inner: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        def go(batch: DataFrame, number: int) -> None:
            self.called[number] = time.monotonic()
            inner(batch, number)
            self.ended[number] = time.monotonic()

        return go

    def __call__(self, progress: list) -> bool:
        """``progress``: the latest reports of the query; Spark keeps a hundred, so this is asked again and again."""
        for p in progress:
            self.read[p["batchId"]] = max(self.read.get(p["batchId"], 0), p["numInputRows"])
        if sum(self.read.values()) < self.rows:
            return False
        last = max((number for number, n in self.read.items() if n), default=None)
        if last is None:
            return True
        due = self.called[last] + self.patience  # a batch's timers count from its own time, which is before its handler
        return any(number > last and self.ended.get(number - 1, 0.0) >= due for number in list(self.ended))


def stopped(query: StreamingQuery, when: Callable[[], bool], within: float = 120.0, grace: float = 5.0) -> bool:
    """Stop a running query once ``when`` holds, or after so many seconds without a report of a further batch, between two batches if
    there is such a moment within the grace; its error, if it had one, is raised.  Did ``when`` hold?"""
    until, batch, held = time.monotonic() + within, None, False
    while query.isActive and not (held := when()) and time.monotonic() < until:
        time.sleep(0.2)
        report = query.lastProgress
        if report is not None and report["batchId"] != batch:
            batch, until = report["batchId"], time.monotonic() + within
    if query.exception() is not None:
        raise query.exception()
    until = time.monotonic() + grace
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
        time.sleep(0.02)
    query.stop()
    return held
