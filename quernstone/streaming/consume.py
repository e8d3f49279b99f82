"""Consuming record logs: counters, commit policies, routing to handlers.

A commit policy is a function from a table of finished records to (topic, partition, commit)
rows; a handler is a function of a micro-batch and its number.  Streaming state is Spark's own
checkpoint; sinks are made exactly-once by the batch number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.hashing import stable_hash

Handler = Callable[[DataFrame, int], None]
CommitPolicy = Callable[[DataFrame], DataFrame]
PARTITION = ["topic", "partition"]


def counters(log: DataFrame, *by: str) -> DataFrame:
    """Records and bytes of values, in all or by columns; batch or streaming."""
    return log.groupBy(*by).agg(F.count("*").alias("records"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes"))


def counters_since(log: DataFrame, reset: Column, *by: str) -> DataFrame:
    """Counters of what came at or after a reset."""
    return counters(log.where(F.col("timestamp") >= reset), *by)


def max_offsets(log: DataFrame) -> DataFrame:
    """The offset to commit after the last record of each partition."""
    return log.groupBy(*PARTITION).agg((F.max("offset") + 1).alias("commit"))


def pending_offsets(pushed: DataFrame) -> DataFrame:
    """Of offsets pushed in order of ``seq``, the last of each partition."""
    return pushed.groupBy(*PARTITION).agg(F.max_by("offset", "seq").alias("offset"))


def _numbered(log: DataFrame, by: list[str], *order: str) -> DataFrame:
    """``nth``: each record's place (from 1) by offset within ``by``, counted in blocks of offsets so that no
    task has to sort a whole topic."""
    rows = log.withColumn("block", F.floor(F.col("offset") / F.lit(1 << 16)))
    sizes = rows.groupBy(*by, "block").count()
    before = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*by, "block").orderBy("offset", *order)
    rows = rows.withColumn("nth", F.row_number().over(inside)).join(sizes, [*by, "block"])
    return rows.withColumn("nth", F.col("nth") + F.col("before")).drop("block", "before")


def contiguous_commit(finished: DataFrame, starts: DataFrame, window: int = 0, flush: bool = False) -> DataFrame:
    """How far each partition may be committed: its finished offsets from its start on without a gap.

    ``starts``: (topic, partition, start).  Partitions whose start isn't finished have no row, nor have those with
    fewer than ``window`` finished records from there on, unless a consumer that stops asks to ``flush``.
    Offsets less their rank are constant along a run without gaps, and only the first run's is the start itself."""
    todo = finished.select(*PARTITION, "offset").distinct().join(starts, PARTITION).where("offset >= start")
    runs = _numbered(todo, PARTITION).withColumn("lag", F.col("offset") - F.col("nth"))
    out = runs.groupBy(*PARTITION, "start").agg(F.count("*").alias("n"), (F.max(F.when(F.col("lag") == F.col("start") - 1, F.col("offset"))) + 1).alias("commit"))
    return out.where((F.col("n") >= (0 if flush else window)) & F.col("commit").isNotNull()).select(*PARTITION, "commit")


def fixed_rate_commits(log: DataFrame, rate: int = 100) -> DataFrame:
    """After every ``rate``-th record of a topic: where its partition then stands."""
    rows = _numbered(log, ["topic"], "partition").where(F.col("nth") % rate == 0)
    return rows.select("topic", "partition", (F.col("offset") + 1).alias("commit"), "nth")


def commits_by_topic(log: DataFrame, policies: dict[str, CommitPolicy], default: CommitPolicy = fixed_rate_commits) -> DataFrame:
    """Each topic's commits by its own policy, all other topics' by the default."""
    rest = log.where(~F.col("topic").isin(*policies)) if policies else log
    out = default(rest).select(*PARTITION, "commit")
    for topic, policy in policies.items():
        out = out.unionByName(policy(log.where(F.col("topic") == topic)).select(*PARTITION, "commit"))
    return out


def worker_of(key: Column, n: int) -> Column:
    """Which of n workers a record goes to (those without a key to the first)."""
    return F.pmod(F.coalesce(stable_hash(key.cast("string")), F.lit(0)), F.lit(n)).cast("int")


def router(handlers: dict[str, Handler], default: Handler | None = None) -> Handler:
    """A handler for ``foreachBatch``: each topic's records to its handler, all others to the default.

    An exception fails the query; the batch is run again from the checkpoint."""

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for topic, handler in handlers.items():
                handler(batch.where(F.col("topic") == topic), number)
            if default is not None:
                default(batch.where(~F.col("topic").isin(*handlers)) if handlers else batch, number)
        finally:
            batch.unpersist()

    return handle


def once_per_batch(path: str, result: Callable[[DataFrame], DataFrame]) -> Handler:
    """A handler that writes a batch's result in one overwritten partition, so a batch that is run again replaces itself.

    While it is replaced a reader may miss it; ``publish.exactly_once`` makes a batch visible in one step."""

    def handle(batch: DataFrame, number: int) -> None:
        result(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


def _merged(runs: np.ndarray) -> np.ndarray:
    """Rows of (from, to): the runs put in order, those that touch or overlap made one."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    to = np.maximum.accumulate(runs[:, 1])
    first = np.flatnonzero(np.append(True, runs[1:, 0] > to[:-1]))
    return np.column_stack([runs[first, 0], to[np.append(first[1:], len(runs)) - 1]])


def commit_as_finished(finished: DataFrame, starts: DataFrame, window: int = 0) -> DataFrame:
    """``contiguous_commit`` of a stream: (topic, partition, commit) whenever a partition's commit moves (update mode).

    The state of a partition is its last commit and the runs of finished offsets that wait for a gap, kept by Spark;
    it grows with the gaps, not with the records.  ``window``: as many offsets must be finished beyond the commit."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        at, runs = int(parts[0]["start"].iloc[0]), np.zeros((0, 2), dtype=np.int64)
        if state.exists:
            at, lo, hi = state.get
            runs = np.array([lo, hi], dtype=np.int64).T
        for part in parts:
            new = part["offset"].to_numpy(dtype=np.int64)
            runs = np.concatenate([runs, np.column_stack([new, new + 1])[new >= at]])
        runs = _merged(runs) if len(runs) else runs
        moved = len(runs) and runs[0, 0] == at and (runs[:, 1] - runs[:, 0]).sum() >= window
        if moved:
            at, runs = int(runs[0, 1]), runs[1:]
        state.update((at, runs[:, 0].tolist(), runs[:, 1].tolist()))
        if moved:
            yield pd.DataFrame({"topic": [key[0]], "partition": [key[1]], "commit": [at]})

    rows = finished.select("topic", F.col("partition").cast("int").alias("partition"), F.col("offset").cast("long").alias("offset")).where("offset is not null")
    rows = rows.join(starts.select("topic", F.col("partition").cast("int").alias("partition"), F.col("start").cast("long").alias("start")), PARTITION)
    return rows.groupBy(*PARTITION).applyInPandasWithState(
        step, "topic string, partition int, commit long", "at long, lo array<long>, hi array<long>", "update", GroupStateTimeout.NoTimeout
    )


class IdleAlarm(StreamingQueryListener):
    """Calls back after ``n`` polls in a row without records."""

    def __init__(self, alarm: Callable[[int], None], n: int = 5):
        self.alarm, self.n, self.idle = alarm, n, 0

    def _count(self, rows: int) -> None:
        self.idle = 0 if rows else self.idle + 1
        if self.idle and self.idle % self.n == 0:
            self.alarm(self.idle)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.idle = 0

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self._count(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self._count(0)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def metrics(query) -> dict:
    """Batches, records and rate of a running query, from its last progress."""
    p = query.lastProgress or {}
    return {"batch": p.get("batchId", -1), "records": p.get("numInputRows", 0), "records_a_second": p.get("processedRowsPerSecond", 0.0)}
