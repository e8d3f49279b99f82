"""Queries whose way leads through files, catalog tables or streams: what was written is read back.

Everything is written under new names in the folder that the executors share, or in the warehouse.
"""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import codecs, composite
from ..operators import bulkload, mutate, predicates
from ..operators.cells import from_entities, from_headers, to_entities
from ..operators.scan import ScanSpec, scan
from ..sources import csv, tables
from ..streaming import consume, records
from .catalog import _EVENTS, _GONE, _LOG, _ORDERS, _finished, _keys, _shown, query
from .csvlines import _CSV, _LINE, _lines, _parsed
from .session import new_path, ship_package
from .tables import ORDER_FIELDS, event_cells, event_log, order_cells, order_entities, table

# --- CSV files


def _csv_files(spark, d, codec):
    path = new_path(spark, f"csv-{codec}")
    lines = _lines(spark, d).repartition("nation", "run").sortWithinPartitions("nation", "run", "c_custkey")
    lines.select("nation", "run", "value").write.partitionBy("nation", "run").option("compression", codec).text(path)
    return _parsed(csv.read(spark, path))


@query("csv_files", _CSV.format(line=_LINE, more="", entry=""))
def _(spark, d):
    return _csv_files(spark, d, "none")


@query("csv_files_gzip", _CSV.format(line=_LINE, more="", entry=""))
def _(spark, d):
    return _csv_files(spark, d, "gzip")


def _zipped(group: pd.DataFrame) -> pd.DataFrame:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for entry, rows in group.sort_values("c_custkey").groupby(group["c_custkey"] % 2):
            z.writestr(f"part-{entry}.csv", "\n".join(rows["value"]) + "\n")
    return pd.DataFrame({"path": [f"{group['nation'].iloc[0]}-{group['run'].iloc[0]}.zip"], "content": [out.getvalue()]})


@query("csv_zip_entries", _CSV.format(line=_LINE, more=", c_custkey % 2", entry=", 'part-' || CAST(c_custkey % 2 AS VARCHAR) || '.csv' AS entry"))
def _(spark, d):
    """Archives of two entries each, made and unpacked in tasks."""
    zips = _lines(spark, d).groupBy("nation", "run").applyInPandas(_zipped, "path string, content binary")
    return _parsed(csv.unzipped(zips), "entry")


# --- bulk loads


def _loaded(spark, cells, *loads):
    path = new_path(spark, "table")
    splits = bulkload.compute_splits(cells, "row_key", 8)
    for families in loads:
        bulkload.bulk_load(cells, path, splits, families, files_per_region=2)
    return _shown(spark.read.parquet(path))


@query("bulk_load_entities", f"WITH {_ORDERS} SELECT * FROM oc")
def _(spark, d):
    """Both families of the entities' cells in one load."""
    return _loaded(spark, order_cells(spark, d), ["d", "m"])


@query("bulk_load_twice", f"WITH {_ORDERS} SELECT * FROM oc")
def _(spark, d):
    """A family a load, the second beside the first; cells of families that the table hasn't stay out."""
    return _loaded(spark, order_cells(spark, d), ["d"], ["m", "none"])


@query("bulk_load_family", f"WITH {_EVENTS} SELECT * FROM ec")
def _(spark, d):
    return _loaded(spark, event_cells(spark, d), ["e"])


@query("bulk_load_headers", f"WITH {_ORDERS} SELECT row_key, 'h' AS family, qualifier, CAST(7 AS BIGINT) AS ts, value FROM oc WHERE family = 'd'")
def _(spark, d):
    rows = order_entities(spark, d).select("row_key", F.array("status", "priority").alias("values"))
    return _loaded(spark, from_headers(rows, "h", ["status", "priority"], ts=7), ["h"])


# --- table administration


@query("table_snapshot", f"WITH {_ORDERS} SELECT oc.*, 'd,m' AS families, '0000000100' AS splits, true AS known, CAST(0 AS BIGINT) AS left_after_truncate, false AS there_after_drop FROM oc")
def _(spark, d):
    """A table created, filled, checked, copied, emptied and dropped; the copy keeps the cells."""
    name = f"cells_{uuid.uuid4().hex}"
    tables.create(spark, name, ["d", "m"], ["0000000100"])
    cells = order_cells(spark, d).select("row_key", "qualifier", "ts", "value", "family")
    cells.write.insertInto(name)
    known = tables.check(spark, name, ["d", "m"])
    families, splits = ",".join(tables.families(spark, name)), ",".join(tables.splits(spark, name))
    copy = tables.snapshot(spark, name, f"{name}_copy")
    tables.truncate(spark, name)
    left = spark.table(name).count()
    tables.drop(spark, name)
    out = _shown(spark.table(copy))
    return out.select(
        "*", F.lit(families).alias("families"), F.lit(splits).alias("splits"), F.lit(known).alias("known"),
        F.lit(left).cast("long").alias("left_after_truncate"), F.lit(tables.exists(spark, name)).alias("there_after_drop"),
    )


# --- entities: deletes and hooks


@query("delete_entities", f"WITH {_ORDERS} SELECT * FROM oc WHERE row_key NOT IN (SELECT row_key FROM o WHERE status = 'F' AND custkey NOT LIKE '%5')")
def _(spark, d):
    """Entities without a key delete nothing."""
    gone = order_entities(spark, d).where("status = 'F'").withColumn("id", F.when(~F.col("custkey").endswith("5"), F.col("row_key")))
    return _shown(mutate.delete_entities(order_cells(spark, d), gone, "id"))


@query("delete_family_column_sets", f"WITH {_ORDERS}, {_GONE} SELECT * FROM oc WHERE NOT (qualifier = 'price' AND row_key IN (SELECT row_key FROM gone))")
def _(spark, d):
    """Each row's own set of qualifiers in one family; those of another family stay."""
    sets = _keys(spark, d).select("row_key", F.array(F.lit("price"), F.lit("status")).alias("qualifiers"))
    return _shown(mutate.delete_column_sets(order_cells(spark, d), sets, family="m"))


@query("delete_empty_sets", f"WITH {_ORDERS}, {_GONE} SELECT * FROM oc WHERE NOT (qualifier = 'price' AND row_key IN (SELECT row_key FROM gone WHERE CAST(row_key AS BIGINT) % 2 = 0))")
def _(spark, d):
    """Instructions of which every other one has an empty set: those delete nothing."""
    even = F.col("row_key").cast("long") % 2 == 0
    sets = _keys(spark, d).select("row_key", F.when(even, F.array(F.lit("price"))).otherwise(F.array().cast("array<string>")).alias("qualifiers"))
    return _shown(mutate.delete_column_sets(order_cells(spark, d), sets, family="m"))


@query("entity_hooks", f"WITH {_ORDERS} SELECT row_key, status, lower(priority) AS priority, price, custkey, status || ':' || lower(priority) AS label FROM o")
def _(spark, d):
    """Entities changed before they are written, and given one more column after they are read."""
    lowered = lambda e: e.withColumn("priority", F.lower("priority"))
    labelled = lambda e: e.withColumn("label", F.concat_ws(":", "status", "priority"))
    cells = from_entities(order_entities(spark, d), ORDER_FIELDS, "row_key", F.col("ts"), hook=lowered)
    return to_entities(cells, ORDER_FIELDS, hook=labelled)


@query("filter_own", f"WITH {_ORDERS} SELECT * FROM oc WHERE length(value) = (SELECT max(length(value)) FROM oc)")
def _(spark, d):
    """A filter of one's own: the cells with the longest values of the table."""

    def longest(cells):
        most = cells.agg(F.max(F.length("value")).alias("most"))
        return cells.where(F.length("value") == most.scalar())

    return _shown(scan(order_cells(spark, d), ScanSpec(filters=(predicates.TableFilter(longest),))))


# --- values


@query("texts_of_columns", "SELECT p_partkey, '[' || p_brand || ', ' || p_type || ', x]' AS texts, true AS same, CAST(0 AS INTEGER) AS cleared FROM part")
def _(spark, d):
    a = composite.from_texts(F.col("p_brand"), F.col("p_type"), "x")
    again = F.split(F.concat_ws("\t", "p_brand", "p_type", F.lit("x")), "\t")
    left = F.size(composite.cleared_map(F.create_map("p_brand", "p_type")))
    return table(spark, d, "part").select("p_partkey", composite.text(a).alias("texts"), (composite.fingerprint(a) == composite.fingerprint(again)).alias("same"), left.alias("cleared"))


@query("codec_own", "SELECT p_partkey, p_brand AS raw, p_type AS own FROM part")
def _(spark, d):
    """Bytes as they are, and a codec of one's own: text in base 64."""
    codecs.register(codecs.Codec("base64", "string", lambda c: F.encode(F.base64(F.encode(c, "UTF-8")), "UTF-8"), lambda b: F.decode(F.unbase64(F.decode(b, "UTF-8")), "UTF-8")))
    there = lambda name, c: codecs.decode(name, codecs.encode(name, c))
    return table(spark, d, "part").select("p_partkey", F.decode(there("bytes", F.encode("p_brand", "UTF-8")), "UTF-8").alias("raw"), there("base64", F.col("p_type")).alias("own"))


# --- records


@query("counters_since_reset", f"WITH {_LOG} SELECT topic, count(*) AS records, CAST(sum(strlen(value)) AS BIGINT) AS bytes FROM log WHERE \"timestamp\" >= (SELECT min(\"timestamp\") FROM log) + INTERVAL 1 DAY GROUP BY topic")
def _(spark, d):
    log = event_log(spark, d)
    reset = log.agg((F.min("timestamp") + F.expr("INTERVAL '1' DAY")).alias("reset"))
    return consume.counters_since(log, reset.scalar(), "topic")


@query("record_envelope", f"WITH {_LOG} SELECT topic, \"partition\", \"offset\", key, value, \"timestamp\" FROM log")
def _(spark, d):
    """Records as a broker gives them, keys and values in bytes."""
    raw = event_log(spark, d).withColumn("key", F.encode("key", "UTF-8")).withColumn("value", F.encode("value", "UTF-8")).withColumn("timestampType", F.lit(0))
    return records.envelope(raw)


@query("records_delivered", f"WITH {_LOG} SELECT topic, key, value, count(*) OVER () AS records FROM log")
def _(spark, d):
    """Records written, with the number that the delivery reports."""
    path, seen = new_path(spark, "records"), []
    records.write(records.records(event_log(spark, d), F.col("topic"), F.col("value"), F.col("key")), {"path": path}, fmt="parquet", observe=seen.append)
    return spark.read.parquet(path).select("topic", "key", "value", F.lit(seen[0]["records"]).cast("long").alias("records"))


def _stream(spark, d):
    """The events as a stream of log records; a file or a folder of files, by one pattern."""
    events = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")
    return events.select(F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"))


def _consumed(spark, stream, handler, mode="append"):
    writer = stream.writeStream.outputMode(mode).foreachBatch(handler).option("checkpointLocation", new_path(spark, "progress"))
    writer.trigger(availableNow=True).start().awaitTermination()


@query("stream_once_per_batch", f"WITH {_LOG} SELECT topic, count(*) AS records, CAST(sum(strlen(value)) AS BIGINT) AS bytes FROM log GROUP BY topic")
def _(spark, d):
    """Counters of every batch, each batch handled twice: the second time replaces the first."""
    path = new_path(spark, "batches")
    once = consume.once_per_batch(path, lambda batch: consume.counters(batch, "topic"))

    def twice(batch, number):
        once(batch, number)
        once(batch, number)

    _consumed(spark, _stream(spark, d), twice)
    return spark.read.parquet(path).groupBy("topic").agg(F.sum("records").alias("records"), F.sum("bytes").alias("bytes"))


@query("stream_routed", f"WITH {_LOG} SELECT topic, \"partition\", \"offset\", CASE WHEN topic = 'click' THEN 'clicks' ELSE 'rest' END AS handler FROM log")
def _(spark, d):
    """One topic to its own handler, all others to the default."""
    path = new_path(spark, "routed")
    to = lambda name: lambda batch, number: batch.select("topic", "partition", "offset").write.mode("overwrite").parquet(f"{path}/handler={name}/batch={number}")
    _consumed(spark, _stream(spark, d), consume.router({"click": to("clicks")}, to("rest")))
    return spark.read.parquet(path).select("topic", "partition", "offset", "handler")


@query("stream_to_topic", f"WITH {_LOG} SELECT topic, key, value FROM log")
def _(spark, d):
    """A record stream written on, its progress kept in a checkpoint."""
    path = new_path(spark, "topic")
    out = records.records(_stream(spark, d), F.col("topic"), F.col("value"), F.col("key"))
    records.write_stream(out, {"path": path}, new_path(spark, "progress"), fmt="parquet").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


@query("windowed_commit_flushed", f"""WITH {_LOG}, f AS (SELECT * FROM dense WHERE event_id % 97 <> 0),
g AS (SELECT *, "offset" - row_number() OVER (PARTITION BY topic, "partition" ORDER BY "offset") AS lag FROM f)
SELECT topic, "partition", max("offset") + 1 AS "commit" FROM g WHERE lag = -1 GROUP BY topic, "partition\"""")
def _(spark, d):
    """A stopping consumer commits what is finished though no window is full."""
    return consume.contiguous_commit(*_finished(spark, d), window=1 << 40, flush=True)


@query("stream_commit_as_finished", f"""WITH {_LOG}, f AS (SELECT * FROM dense WHERE event_id % 97 <> 0),
g AS (SELECT *, "offset" - row_number() OVER (PARTITION BY topic, "partition" ORDER BY "offset") AS lag FROM f)
SELECT topic, "partition", max("offset") + 1 AS "commit" FROM g WHERE lag = -1 GROUP BY topic, "partition\"""")
def _(spark, d):
    """Offsets that finish in three batches, out of order: the last commit of each partition."""
    ship_package(spark)
    finished, starts = _finished(spark, d)
    offsets, path = new_path(spark, "finished"), new_path(spark, "commits")
    # two files a batch, whose turn is their time of writing
    for turn in (2, 0, 1):
        finished.select("topic", "partition", "offset").where(F.col("offset") % 3 == turn).repartition(2).write.parquet(f"{offsets}/turn={turn}")
    stream = spark.readStream.schema("topic string, partition int, offset long").option("maxFilesPerTrigger", 2).parquet(f"{offsets}/*")
    _consumed(spark, consume.commit_as_finished(stream, starts), consume.once_per_batch(path, lambda batch: batch), "update")
    return spark.read.parquet(path).groupBy("topic", "partition").agg(F.max("commit").alias("commit"))
