"""Queries over Python data sources: CSV by ranges and zip entries, and a record log with delivery reports."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import functions as F

from ..sources import csv, csvfiles
from ..streaming import delivery, records
from .catalog import _LOG, query
from .csvlines import _CSV, _LINE, _lines, _parsed
from .session import new_path
from .tables import event_log, table


def _local(path: str) -> str:
    """A path of the shared folder as a URI."""
    return path if "://" in path else "file://" + path.removeprefix("file:")


@query("csv_ranges", _CSV.format(line=_LINE, more="", entry=""))
def _(spark, d):
    """Plain files read by ranges of 2,000 bytes."""
    path = _local(new_path(spark, "csv"))
    lines = _lines(spark, d).repartition("nation", "run").sortWithinPartitions("nation", "run", "c_custkey")
    lines.select("nation", "run", "value").write.partitionBy("nation", "run").text(path)
    return _parsed(csvfiles.read(spark, path, 2000))


class _Stream:
    """A stream that is only written on; zip files find out that they can't go back in it."""

    def __init__(self, file):
        self.write, self.flush = file.write, file.flush


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str, list[str]]]:
    """(run, archive, entry, values) of the rows of a batch that stand together."""
    for batch in batches:
        run, archive, entry = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        cut = (run[1:] != run[:-1]) | (archive[1:] != archive[:-1]) | (entry[1:] != entry[:-1])
        ends = [*(np.flatnonzero(cut) + 1), len(run)] if len(run) else []
        for first, end in zip([0, *ends], ends, strict=False):
            yield run[first], archive[first], entry[first], batch.column(3).slice(first, end - first).to_pylist()


def _archives(folder: str):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Archive files of rows (run, archive, entry, value) in this order, line by line: no archive is held."""
        system, at = arrow_fs.FileSystem.from_uri(folder)
        system.create_dir(at, recursive=True)
        for (run, archive), lines in groupby(_stretches(batches), key=lambda r: r[:2]):
            n = 0
            with system.open_output_stream(f"{at}/{run}-{archive}.zip") as file, zipfile.ZipFile(_Stream(file), "w", zipfile.ZIP_DEFLATED) as z:
                for entry, part in groupby(lines, key=lambda r: r[2]):
                    with z.open(entry, "w", force_zip64=True) as out:
                        for *_, values in part:
                            out.write(("\r\n".join(values) + "\r\n").encode())
                            n += len(values)
            yield pa.RecordBatch.from_pydict({"lines": [n]})

    return go


@query("csv_zip_files", """WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag, '"' || l_orderkey || '","' || l_linenumber || '","say ""' || l_returnflag || '""' || '"' AS line,
  l_orderkey // 1048576 || '-' || l_orderkey % 3 || '.zip' AS archive, CASE WHEN l_orderkey % 8 = 0 THEN 'small.csv' ELSE 'more/large.csv' END AS entry FROM lineitem)
SELECT archive, entry, l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS linenumber, 'say "' || l_returnflag || '"' AS quoted, 3 AS n,
  CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY archive, entry ORDER BY l_orderkey, l_linenumber, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM l""")
def _(spark, d):
    """Zip files of two entries, one of many batches, read by path entry by entry."""
    path = _local(new_path(spark, "zips"))
    values = F.array(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.concat(F.lit('say "'), "l_returnflag", F.lit('"')))
    lines = table(spark, d, "lineitem").select(
        F.floor(F.col("l_orderkey") / (1 << 20)).alias("run"), (F.col("l_orderkey") % 3).alias("archive"),
        F.when(F.col("l_orderkey") % 8 == 0, "small.csv").otherwise("more/large.csv").alias("entry"),
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("number"), csv.to_line(values).alias("value"),
    )
    # a partition for each archive
    most = lines.agg(F.max("run")).first()[0] or 0
    archives = min(3 * (most + 1), 1 << 12)
    lines = lines.repartitionById(archives, F.pmod(3 * F.col("run") + F.col("archive"), F.lit(archives)).cast("int"))
    lines = lines.sortWithinPartitions("run", "archive", F.desc("entry"), "key", "number", "value").select("run", "archive", "entry", "value")
    lines.mapInArrow(_archives(path), "lines long").write.format("noop").mode("overwrite").save()
    f = lambda i: F.get("fields", F.lit(i))
    return csvfiles.read(spark, path).select(
        F.element_at(F.split("file", "/"), -1).alias("archive"), "entry", f(0).cast("long").alias("orderkey"), f(1).cast("long").alias("linenumber"),
        f(2).alias("quoted"), F.size("fields").alias("n"), F.col("pos").cast("long").alias("pos"),
    )


@query("delivery_reports", f"WITH {_LOG} SELECT CAST(CAST(key AS BIGINT) % 8 AS INTEGER) AS part, topic, count(*) AS records, CAST(sum(strlen(value)) AS BIGINT) AS bytes FROM log GROUP BY ALL")
def _(spark, d):
    """What each partition of a write reported: a partition for each eighth of the keys."""
    log = event_log(spark, d)
    rows = records.records(log, F.col("topic"), F.col("value"), F.col("key")).repartitionById(8, (F.col("key").cast("long") % 8).cast("int"))
    return delivery.deliver(rows, _local(new_path(spark, "log"))).select("part", "topic", "records", "bytes")


@query("delivered_records", f"WITH {_LOG} SELECT topic, key, value FROM log UNION ALL SELECT topic, key, 'again' FROM log WHERE topic = 'click'")
def _(spark, d):
    """The records of two deliveries; those of a third, which fails in one of its partitions, are not there."""
    path, log = _local(new_path(spark, "log")), event_log(spark, d)
    delivery.deliver(records.records(log, F.col("topic"), F.col("value"), F.col("key")), path)
    delivery.deliver(records.records(log.where("topic = 'click'"), F.col("topic"), F.lit("again"), F.col("key")), path)
    dying = records.records(log, F.col("topic"), F.when(F.col("offset") % 1000 == 7, F.raise_error(F.lit("no delivery"))).otherwise(F.col("value")), F.col("key"))
    try:
        delivery.deliver(dying.repartition(4), path)
    except Exception as e:
        if "no delivery" not in str(e):
            raise
    return delivery.delivered(spark, path)
