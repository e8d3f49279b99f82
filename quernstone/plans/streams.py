"""Queries over streams of several batches, with stops and crashes between them.

The events' log is written in turns, a few files each, and a stream reads a turn's files in a batch; offsets finish mostly in
order, with stragglers in later turns and gaps that never close.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import bulkload
from ..sources import tables
from ..streaming import consume, lifecycle, publish, window
from .catalog import _LOG, _ORDERS, _finished, _shown, query
from .session import new_path, ship_package
from .tables import dense_log, order_cells

TURNS, FILES = 5, 2
_LINE = "topic string, partition int, offset long, value string"
_TURN = """least(4, greatest(0, "offset" // 10 + "offset" % 3 - 1))"""
#: How far each partition may be committed after each batch.
_AFTER = f"""f AS (SELECT topic, "partition", "offset", CASE WHEN event_id % 97 <> 0 THEN {_TURN} END AS turn FROM dense),
k AS (SELECT topic, "partition", b AS batch, coalesce(min(CASE WHEN turn IS NULL OR turn > b THEN "offset" END), max("offset") + 1) AS "commit" FROM f, range({TURNS}) AS r(b) GROUP BY ALL)"""


def _write(rows, folder, turns):
    """Each turn's rows as FILES files, later turns later."""
    turn = F.expr("least(4, greatest(0, offset div 10 + offset % 3 - 1))")
    rows = rows.select("topic", "partition", "offset", "value", turn.alias("turn"))
    for t in turns:
        rows.where(F.col("turn") == t).drop("turn").repartition(FILES).write.parquet(f"{folder}/turn={t}")


def _read(spark, folder):
    return spark.readStream.schema(_LINE).option("maxFilesPerTrigger", FILES).parquet(f"{folder}/*")


def _run(stream, handler, checkpoint, mode="append", **trigger):
    writer = stream.writeStream.outputMode(mode).foreachBatch(handler).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _kept(path):
    """A handler that keeps each batch's rows with its number."""
    return lambda batch, number: batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/number={number}")


@query("stream_commits_by_batch", f"""WITH {_LOG}, {_AFTER}
SELECT topic, "partition", batch, "commit" FROM (SELECT *, lag("commit", 1, 0) OVER (PARTITION BY topic, "partition" ORDER BY batch) AS before FROM k) WHERE "commit" > before""")
def _(spark, d):
    """Offsets that finish out of order over five batches: a row for each batch that moves a partition's commit."""
    ship_package(spark)
    finished, starts = _finished(spark, d)
    folder, path = new_path(spark, "finished"), new_path(spark, "commits")
    _write(finished, folder, range(TURNS))
    with window.state_store(spark):
        q = _run(window.windowed_commits(_read(spark, folder), starts), _kept(path), new_path(spark, "progress"), "update")
        q.awaitTermination()
    with_rows = sum(p["numInputRows"] > 0 for p in q.recentProgress)
    if with_rows != TURNS:
        raise RuntimeError(f"{with_rows} batches instead of {TURNS}")
    return spark.read.parquet(path).select("topic", "partition", "batch", "commit")


@query("stream_commit_timed_flush", f"""WITH {_LOG}, {_AFTER} SELECT topic, "partition", "commit", true AS by_timer, CAST(0 AS BIGINT) AS left_over FROM k WHERE batch = {TURNS - 1} AND "commit" > 0""")
def _(spark, d):
    """No window is ever full; each partition commits when it has waited long enough."""
    ship_package(spark)
    finished, starts = _finished(spark, d)
    folder, path, checkpoint, patience = new_path(spark, "finished"), new_path(spark, "commits"), new_path(spark, "progress"), 1500
    _write(finished, folder, range(TURNS))
    settled = window.Settled(finished.count(), patience)
    with window.state_store(spark):
        commits = window.windowed_commits(_read(spark, folder), starts, window=1 << 40, patience_ms=patience)
        q = _run(commits, settled.handler(_kept(path)), checkpoint, "update", processingTime="2 seconds")
        if not window.stopped(q, lambda: settled(q.recentProgress)):
            raise RuntimeError("the query made no batch for two minutes before its timers were through")
    left = window.flushed(spark, checkpoint).agg(F.count("*").alias("n"))
    done = spark.read.parquet(path).groupBy("topic", "partition").agg(F.max("commit").alias("commit"), F.bool_and(F.col("why") == "timer").alias("by_timer"))
    return done.withColumn("left_over", left.scalar())


@query("stream_stop_flush", f"""WITH {_LOG}, {_AFTER} SELECT topic, "partition", CASE batch WHEN 0 THEN 1 ELSE 2 END AS stop, "commit" FROM k WHERE batch IN (0, {TURNS - 1}) AND "commit" > 0""")
def _(spark, d):
    """A consumer stopped after its first batch and again at the end: what each stop commits from the state in the checkpoint."""
    ship_package(spark)
    finished, starts = _finished(spark, d)
    folder, path, checkpoint = new_path(spark, "finished"), new_path(spark, "flushed"), new_path(spark, "progress")
    for stop, turns in ((1, range(1)), (2, range(1, TURNS))):
        _write(finished, folder, turns)
        with window.state_store(spark):
            commits = window.windowed_commits(_read(spark, folder), starts, window=1 << 40)
            q = _run(commits, lambda batch, number: batch.write.format("noop").mode("overwrite").save(), checkpoint, "update", processingTime="0 seconds")
            q.processAllAvailable()
            window.stopped(q, lambda: True)
        window.flushed(spark, checkpoint).withColumn("stop", F.lit(stop)).write.parquet(f"{path}/at={stop}")
    return spark.read.parquet(path).select("topic", "partition", "stop", "commit")


class Crash(RuntimeError):
    """What a consumer dies of here."""


@query("stream_crash_exactly_once", f"""WITH {_LOG}, p AS (SELECT topic, "partition", max("offset") + 1 AS stands FROM dense GROUP BY ALL),
s AS (SELECT topic, CAST(sum(stands) AS BIGINT) AS stands FROM p GROUP BY topic)
SELECT topic, count(*) AS records, CAST(sum(strlen(value)) AS BIGINT) AS bytes, any_value(stands) AS stands, '0' AS after_first_crash, '0,1,2' AS after_second_crash FROM dense JOIN s USING (topic) GROUP BY topic""")
def _(spark, d):
    """A consumer that dies in batch 1 before its result is published, and again in batch 2 after that, but before Spark
    notes the batch as done.  Totals, the log's position, and the batches that a reader saw after each crash."""
    folder, checkpoint, name = new_path(spark, "log"), new_path(spark, "progress"), f"published_{uuid.uuid4().hex}"
    _write(dense_log(spark, d), folder, range(TURNS))
    publish.create(spark, name, "topic string, records long, bytes long")
    counted = lambda batch: consume.counters(batch, "topic")

    def dies_before(number):
        if number == 1:
            raise Crash("before publishing")

    def dies_after(batch, number):
        publish.exactly_once(name, counted)(batch, number)
        if number == 2:
            raise Crash("after publishing")

    seen = []
    for handler in (publish.exactly_once(name, counted, before_publish=dies_before), dies_after):
        q = _run(_read(spark, folder), handler, checkpoint)
        try:
            q.awaitTermination()
        except Exception as e:
            if "publishing" not in str(e):
                raise
        seen.append(",".join(map(str, publish.batches(spark, name))))
    _run(_read(spark, folder), publish.exactly_once(name, counted), checkpoint).awaitTermination()
    stands = publish.positions(spark, name).groupBy("topic").agg(F.sum("commit").alias("stands"))
    totals = publish.results(spark, name).groupBy("topic").agg(F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))
    return totals.join(stands, "topic").select("*", F.lit(seen[0]).alias("after_first_crash"), F.lit(seen[1]).alias("after_second_crash"))


@query("bulk_load_crashed", f"WITH {_ORDERS} SELECT oc.*, CAST(0 AS BIGINT) AS after_crash, true AS first, false AS again FROM oc")
def _(spark, d):
    """A load that dies half-way shows none of its cells; tried again it shows all, and once more changes nothing."""
    name = f"loaded_{uuid.uuid4().hex}"
    tables.create(spark, name, ["d", "m"], by_load=True)
    cells = order_cells(spark, d)
    splits = bulkload.compute_splits(cells, "row_key", 8)
    dying = cells.withColumn("value", F.when((F.col("row_key") > splits[len(splits) // 2]) & (F.col("family") == "m"), F.raise_error(F.lit("died half-way"))).otherwise(F.col("value")))
    try:
        bulkload.load_table(dying, name, "monday", splits, ["d", "m"], 2)
    except Exception as e:
        if "died half-way" not in str(e):
            raise
    seen = spark.table(name).count()
    first, again = (bulkload.load_table(cells, name, "monday", splits, ["d", "m"], 2) for _ in range(2))
    return _shown(spark.table(name)).select("*", F.lit(seen).cast("long").alias("after_crash"), F.lit(first).alias("first"), F.lit(again).alias("again"))


@query("stream_handler_life", f"""WITH {_LOG}, f AS (SELECT {_TURN} AS turn FROM dense) SELECT turn AS epoch, true AS all_closed, false AS failed, count(*) AS records FROM f GROUP BY turn""")
def _(spark, d):
    """Handlers opened and closed for each partition of every batch, and the records they were given."""
    folder, notes = new_path(spark, "log"), new_path(spark, "notes")
    _write(dense_log(spark, d), folder, range(TURNS))
    writer = lifecycle.handled(_read(spark, folder), lambda: lifecycle.Counting(notes), new_path(spark, "progress"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return lifecycle.notes(spark, notes).groupBy("epoch").agg(
        (F.sum("opened") == F.sum("closed")).alias("all_closed"), F.bool_or(F.col("error").isNotNull()).alias("failed"), F.sum("records").alias("records")
    )
