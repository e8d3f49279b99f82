"""Record logs, commit policies, streams and counters."""

from __future__ import annotations

import uuid

import numpy as np
import pytest

from quernstone.operators import replay
from quernstone.streaming import consume, lifecycle, publish, records, window


def log_of(spark, rows):
    return spark.createDataFrame(rows, "topic string, partition int, offset long, key string, value string")


def test_start_offsets():
    assert records.parse_starts("a:0:5, b:1:0,c:2:-1,") == [("a", 0, 5)]
    assert records.starting_offsets("a:0:5,a:1:6") == '{"a": {"0": 5, "1": 6}}'
    assert records.parse_starts("b:1:0") == []


def test_contiguous_commit(spark):
    done = spark.createDataFrame([("t", 0, o) for o in (5, 6, 8, 9)] + [("t", 1, 4)] + [("u", 0, 0), ("u", 0, 0), ("u", 0, 1)], "topic string, partition int, offset long")
    starts = spark.createDataFrame([("t", 0, 5), ("t", 1, 3), ("u", 0, 0)], "topic string, partition int, start long")
    got = sorted(map(tuple, consume.contiguous_commit(done, starts).collect()))
    assert got == [("t", 0, 7), ("u", 0, 2)]
    assert sorted(map(tuple, consume.contiguous_commit(done, starts, window=3).collect())) == [("t", 0, 7)]


def test_write_records_with_observation(spark, tmp_path):
    seen = []
    rows = spark.createDataFrame([(i, str(i)) for i in range(1, 8)], "k int, v string")
    out = records.records(rows, "test", rows.v)
    records.write(out, {"path": f"file://{tmp_path}/sink"}, fmt="parquet", observe=seen.append)
    assert seen == [{"records": 7, "bytes": 7}]
    assert spark.read.parquet(f"file://{tmp_path}/sink").where("key is null and topic = 'test'").count() == 7


def test_stream_routes_and_commits(spark, tmp_path):
    schema = "topic string, partition int, offset long, key string, value string"
    for i, offsets in enumerate([(0, 1, 3), (2, 5), (4,)]):
        log_of(spark, [("a", 0, o, "k", "v") for o in offsets] + [("b", 0, i, "k", "v")]).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{i}")
    counted = {}

    def count(name):
        return lambda df, n: counted.__setitem__(name, counted.get(name, 0) + df.count())

    handler = consume.router({"a": count("a")}, count("rest"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    q = stream().writeStream.foreachBatch(handler).option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert counted == {"a": 6, "rest": 3} and consume.metrics(q)["batch"] >= 0
    starts = spark.createDataFrame([("a", 0, 0), ("b", 0, 0)], "topic string, partition int, start long")
    path = f"file://{tmp_path}/commits"
    writer = consume.commit_as_finished(stream(), starts).writeStream.outputMode("update").foreachBatch(consume.once_per_batch(path, lambda df: df))
    writer.option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(path).groupBy("topic").max("commit").collect()
    assert dict(map(tuple, last)) == {"a": 6, "b": 3}


def test_merged_runs():
    r = np.random.default_rng(5)
    for _ in range(200):
        lo = r.integers(0, 40, r.integers(1, 12))
        runs = np.column_stack([lo, lo + r.integers(1, 6, len(lo))])
        got = consume._merged(runs)
        assert {x for a, b in got for x in range(a, b)} == {x for a, b in runs for x in range(a, b)}
        assert (got[1:, 0] > got[:-1, 1]).all()


def test_failing_handler_fails_the_query(spark, tmp_path):
    log_of(spark, [("a", 0, 0, "k", "v")]).write.parquet(f"file://{tmp_path}/in/0")

    def broken(df, n):
        raise ValueError("handler broke")

    q = spark.readStream.schema("topic string, partition int, offset long, key string, value string").parquet(f"file://{tmp_path}/in/*").writeStream.foreachBatch(consume.router({"a": broken})).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="handler broke"):
        q.awaitTermination()


def test_once_per_batch_replaces_itself(spark, tmp_path):
    handle = consume.once_per_batch(f"file://{tmp_path}/out", lambda df: df)
    df = log_of(spark, [("a", 0, 0, "k", "v")])
    handle(df, 0)
    handle(df, 0)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 1


def test_idle_alarm():
    calls = []
    alarm = consume.IdleAlarm(calls.append, 2)
    for rows in (0, 0, 5, 0, 0, 0, 0):
        alarm._count(rows)
    assert calls == [2, 2, 4]


def test_replay_from_any_snapshot_equals_full_replay(spark):
    ops = spark.createDataFrame([("a", i, 2 if i % 3 else 1, i) for i in range(20)] + [("b", i, 2, 1) for i in range(7)], "counter string, log_index long, op tinyint, delta long")
    want = sorted(map(tuple, replay.fold(ops).collect()))
    for at in (-1, 0, 9, 100):
        got = sorted((r.counter, r.value) for r in replay.replay(replay.snapshot(ops, at), ops).collect())
        assert got == [(c, v) for c, v, _ in want]
    run = replay.running(ops, block=4).collect()
    assert max(r.value for r in run if r.counter == "b") == 7 and len(run) == 27


def _turns(spark, tmp_path, turns):
    for i, offsets in enumerate(turns):
        spark.createDataFrame([("t", p, o) for p, o in offsets], "topic string, partition int, offset long").coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    stream = spark.readStream.schema("topic string, partition int, offset long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    return stream, spark.createDataFrame([("t", 0, 5), ("t", 1, 0)], "topic string, partition int, start long")


def test_windows_commit_over_batches_and_what_waits_is_flushed(spark, tmp_path):
    # partition 0 starts at 5: its gap at 6 closes in the last batch; repeats and offsets before the start change nothing
    stream, starts = _turns(spark, tmp_path, [[(0, 7), (0, 5), (0, 5), (1, 3)], [(0, 2), (0, 8), (1, 0)], [(0, 6), (1, 0), (1, 5)]])
    seen, checkpoint = {}, f"file://{tmp_path}/progress"

    def keep(batch, number):
        seen.setdefault(number, []).extend(sorted((r.partition, r.commit, r.why) for r in batch.collect()))

    with window.state_store(spark):
        q = window.windowed_commits(stream, starts, window=3).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    assert seen == {0: [], 1: [(0, 6, "window")], 2: [(0, 9, "window"), (1, 1, "window")]}
    assert sorted(tuple(r) for r in window.waiting(spark, checkpoint).select("partition", "at", "lo", "hi").collect()) == [(0, 9, [], []), (1, 1, [3, 5], [4, 6])]
    assert window.flushed(spark, checkpoint).collect() == []


def test_state_store_is_put_back(spark):
    before = spark.conf.get(window.PROVIDER)
    with window.state_store(spark):
        assert spark.conf.get(window.PROVIDER) == window.ROCKSDB
    assert spark.conf.get(window.PROVIDER) == before


def test_exactly_once_leaves_no_half_batch(spark):
    name = f"published_{uuid.uuid4().hex}"
    publish.create(spark, name, "topic string, records long")
    rows = log_of(spark, [("a", 0, 4, "k", "v"), ("a", 1, 9, "k", "v")])
    counted = lambda b: consume.counters(b, "topic")
    folders = []

    def dies(number):
        folders.append(number)
        raise ValueError("dies")

    with pytest.raises(ValueError, match="dies"):
        publish.exactly_once(name, counted, before_publish=dies)(rows, 0)
    assert publish.batches(spark, name) == [] and publish.results(spark, name).collect() == []
    handle = publish.exactly_once(name, counted)
    for number in (0, 0, 1):
        handle(rows, number)
    assert publish.batches(spark, name) == [0, 1] and sorted(map(tuple, publish.results(spark, name).collect())) == [(0, "a", 2), (1, "a", 2)]
    assert sorted(map(tuple, publish.positions(spark, name).collect())) == [("a", 0, 5), ("a", 1, 10)]


def test_handlers_live_and_fail_alone(spark, tmp_path):
    for i in range(3):
        log_of(spark, [("a", 0, o, "k", str(o)) for o in range(i * 10, i * 10 + 4)]).coalesce(1).write.parquet(f"file://{tmp_path}/in/{i}")
    stream = lambda: spark.readStream.schema("topic string, partition int, offset long, key string, value string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    start = lambda name, fails: lifecycle.handled(stream(), lambda: lifecycle.Counting(f"{tmp_path}/{name}", fails), f"file://{tmp_path}/progress-{name}").trigger(availableNow=True).start()
    good, bad = start("good", None), start("bad", lambda r: r.offset == 12)
    with pytest.raises(Exception, match="can't be handled"):
        bad.awaitTermination()
    good.awaitTermination()
    notes = lambda name: sorted(map(tuple, lifecycle.notes(spark, f"file://{tmp_path}/{name}").select("epoch", "opened", "records", "closed").collect()))
    assert notes("good") == [(0, 1, 4, 1), (1, 1, 4, 1), (2, 1, 4, 1)]
    # the failing record's handler was shut down with its error, and no later epoch began
    assert notes("bad") == [(0, 1, 4, 1), (1, 1, 2, 1)]
    assert "can't be handled" in lifecycle.notes(spark, f"file://{tmp_path}/bad").where("epoch = 1").first().error


def test_idle_alarm_of_a_query_without_records(spark, tmp_path):
    calls = []
    alarm = consume.IdleAlarm(calls.append, 2)
    log_of(spark, [("a", 0, 0, "k", "v")]).write.parquet(f"file://{tmp_path}/in/0")
    spark.streams.addListener(alarm)
    try:
        with_rows = spark.readStream.schema("topic string, partition int, offset long, key string, value string").parquet(f"file://{tmp_path}/in/*")
        q = with_rows.writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/progress").trigger(processingTime="200 milliseconds").start()
        spark.conf.set("spark.sql.streaming.noDataProgressEventInterval", "200")
        window.stopped(q, lambda: len(calls) > 0, within=40)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataProgressEventInterval")
        spark.streams.removeListener(alarm)
    assert calls and calls[0] == 2


def test_subscription_options(spark, monkeypatch):
    """There is no connector here, so what the reader is given."""
    seen = {}

    class Reader:
        def format(self, name):
            seen["format"] = name
            return self

        def options(self, **more):
            seen.update(more)
            return self

        def load(self):
            return spark.createDataFrame([(bytearray(b"k"), bytearray(b"v"), "a", 0, 5, None)], "key binary, value binary, topic string, partition int, offset long, timestamp timestamp")

    class Session:
        readStream = Reader()  # noqa: N815

    got = records.subscribe(Session(), "a,b", "host:1", starts="a:0:5,b:0:0", group="g", most_per_trigger=10, least_partitions=3).collect()
    assert [(r.topic, r.key, r.value) for r in got] == [("a", "k", "v")]
    assert seen == {
        "format": "kafka", "kafka.bootstrap.servers": "host:1", "subscribe": "a,b", "startingOffsets": '{"a": {"0": 5}}',
        "groupIdPrefix": "g", "maxOffsetsPerTrigger": "10", "minPartitions": "3",
    }
    seen.clear()
    records.subscribe(Session(), "a", "host:1", starts="a:0:0")
    assert "startingOffsets" not in seen and set(seen) == {"format", "kafka.bootstrap.servers", "subscribe"}


def test_settled_waits_for_timers_after_a_slow_batch(monkeypatch):
    """The last batch with records takes longer than any wait: its timers still have to be through."""
    now = [0.0]
    monkeypatch.setattr(window.time, "monotonic", lambda: now[0])
    settled = window.Settled(30, 1500)
    report = [{"batchId": 0, "numInputRows": 10}]

    def batch(number, seconds):
        settled.handler(lambda rows, n: now.__setitem__(0, now[0] + seconds))(None, number)

    batch(0, 1)
    assert not settled(report)
    batch(1, 60)
    report.append({"batchId": 1, "numInputRows": 20})
    assert not settled(report)
    batch(2, 1)
    assert settled(report)
    quick = window.Settled(5, 1500)
    for number, seconds in ((0, 0.5), (1, 0.5), (2, 1.0)):
        quick.handler(lambda rows, n, s=seconds: now.__setitem__(0, now[0] + s))(None, number)
        assert not quick([{"batchId": 0, "numInputRows": 5}])
    quick.handler(lambda rows, n: None)(None, 3)
    assert quick([{"batchId": 0, "numInputRows": 5}])
    assert window.Settled(0, 1500)([])
