"""A log of records as a Spark data source that reports what each partition delivered.

Every task writes one Parquet file and sends Spark a message: the file, and records and bytes by topic.  When all tasks are done
the messages are written as the delivery's report, in one file, and that makes the delivery visible; readers take the files
that reports name.  When a task fails for good, the files of those that were done are removed and nothing is reported.

Works wherever Arrow's file systems do (local, HDFS, object stores).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

NAME = "record_log"
REPORT = "delivery string, part int, topic string, records long, bytes long, file string"
_REPORT = pa.schema([("delivery", pa.string()), ("part", pa.int32()), ("topic", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("file", pa.string())])


@dataclass
class Delivered(WriterCommitMessage):
    """What one task wrote: records and bytes of values by topic."""

    part: int
    file: str
    topics: dict[str | None, tuple[int, int]]


def _place(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return (arrow_fs.LocalFileSystem(), uri.removeprefix("file://")) if uri.startswith("file://") else arrow_fs.FileSystem.from_uri(uri)


class LogWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.delivery = options["path"].rstrip("/"), options["delivery"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Delivered:
        """One file of a task's records; none if there are none."""
        part, file = TaskContext.get().partitionId(), f"{self.path}/part-{uuid.uuid4().hex}.parquet"
        system, at = _place(file)
        topics: dict[str | None, tuple[int, int]] = {}
        out = None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = pq.ParquetWriter(at, batch.schema, filesystem=system)
                out.write_batch(batch)
                size = pc.fill_null(pc.binary_length(batch.column("value").cast(pa.binary())), 0)
                made = pa.table({"topic": batch.column("topic"), "size": size}).group_by("topic").aggregate([("size", "count"), ("size", "sum")])
                for row in made.to_pylist():
                    n, total = topics.get(row["topic"], (0, 0))
                    topics[row["topic"]] = (n + row["size_count"], total + row["size_sum"])
        finally:
            if out is not None:
                out.close()
        return Delivered(part, file if out is not None else "", topics)

    def commit(self, messages: list[Delivered | None]) -> None:
        """Write the report; all records become visible with it."""
        rows = [
            {"delivery": self.delivery, "part": m.part, "topic": t, "records": n, "bytes": b, "file": m.file}
            for m in messages if m is not None for t, (n, b) in sorted(m.topics.items(), key=str)
        ]
        system, at = _place(f"{self.path}/_reports")
        system.create_dir(at, recursive=True)
        pq.write_table(pa.Table.from_pylist(rows, schema=_REPORT), f"{at}/.{self.delivery}", filesystem=system)
        system.move(f"{at}/.{self.delivery}", f"{at}/{self.delivery}.parquet")

    def abort(self, messages: list[Delivered | None]) -> None:
        """Remove what the tasks that were done wrote."""
        for m in messages:
            if m is not None and m.file:
                system, at = _place(m.file)
                system.delete_file(at)


class RecordLog(DataSource):
    """``df.write.format("record_log")``: options path and delivery, the delivery's name."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "topic string, key string, value string"

    def writer(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(self.options)


def deliver(records: DataFrame, path: str, delivery: str | None = None) -> DataFrame:
    """Append records (topic, key, value) to the log at ``path``; the report of what each partition delivered."""
    spark, delivery = records.sparkSession, delivery or uuid.uuid4().hex
    spark.dataSource.register(RecordLog)
    records.select("topic", "key", "value").write.format(NAME).options(path=path, delivery=delivery).mode("append").save()
    return reports(spark, path).where(F.col("delivery") == delivery)


def reports(spark: SparkSession, path: str) -> DataFrame:
    """(delivery, part, topic, records, bytes, file) of all deliveries to a log that has at least one."""
    return spark.read.schema(REPORT).parquet(f"{path.rstrip('/')}/_reports/*.parquet")


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """The records of a log: those of the files that reports name."""
    files = [r.file for r in reports(spark, path).select("file").distinct().collect()]
    schema = "topic string, key string, value string"
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
