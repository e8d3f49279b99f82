"""Handlers with a life: set up for each partition of a batch, given its records, shut down whatever happened.

``DataStreamWriter.foreach`` calls open, process and close in the task that has the partition.  A handler's error reaches its own
shutdown, fails the task and with it, after Spark's retries, that query and no other.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import DataStreamWriter


class RecordHandler:
    """What a handler does; all methods run in tasks."""

    def setup(self, partition: int, epoch: int) -> None:
        """Before the partition's first record."""

    def handle(self, record: Row) -> None:
        """For each record."""

    def shutdown(self, error: Exception | None) -> None:
        """After the last record, or after the one that failed."""


class _Writer:
    """A handler as foreach wants it."""

    def __init__(self, make: Callable[[], RecordHandler]):
        self.make, self.handler = make, None

    def open(self, partition_id: int, epoch_id: int) -> bool:
        self.handler = self.make()
        self.handler.setup(partition_id, epoch_id)
        return True

    def process(self, row: Row) -> None:
        self.handler.handle(row)

    def close(self, error: Exception | None) -> None:
        handler, self.handler = self.handler, None
        if handler is not None:  # else its setup failed
            handler.shutdown(error)


def handled(stream: DataFrame, make: Callable[[], RecordHandler], checkpoint: str) -> DataStreamWriter:
    """A writer that gives the stream's records to handlers, to be started; ``make`` makes one for each partition and epoch."""
    return stream.writeStream.foreach(_Writer(make)).option("checkpointLocation", checkpoint)


class Counting(RecordHandler):
    """Counts a partition's records and leaves a note of its life in a shared folder when it is shut down.

    ``fails``: an error for the records it holds for."""

    def __init__(self, folder: str, fails: Callable[[Row], bool] | None = None):
        self.folder, self.fails = folder, fails

    def setup(self, partition: int, epoch: int) -> None:
        self.note = {"epoch": epoch, "partition": partition, "opened": 1, "records": 0}

    def handle(self, record: Row) -> None:
        if self.fails is not None and self.fails(record):
            raise ValueError(f"record {record} can't be handled")
        self.note["records"] += 1

    def shutdown(self, error: Exception | None) -> None:
        uri = self.folder if "://" in self.folder else "file://" + self.folder.removeprefix("file:")
        system, at = arrow_fs.FileSystem.from_uri(uri)
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(self.note | {"closed": 1, "error": error and str(error)}).encode())


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """(epoch, partition, opened, records, closed, error) that counting handlers left."""
    return spark.read.schema("epoch long, partition int, opened int, records long, closed int, error string").json(folder)
