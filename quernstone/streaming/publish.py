"""Exactly once into a catalog table: what a batch made and where the log then stood become visible in one step.

A batch is written to a folder of its own attempt, which nobody reads.  One statement to the catalog then adds it as the
batch's partition; a batch whose partition is there was published before, and is skipped when it is run again.  An
attempt that fails before that step removes its folder; one whose driver is lost leaves it, named by no partition.  The
catalog has to outlive the driver, as a metastore does, and a table takes the batches of one checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.session import new_path, remove_path
from ..sources import tables
from .consume import Handler, max_offsets

POSITION = "topic string, partition int, commit long"


def create(spark: SparkSession, name: str, schema: str | StructType) -> None:
    """A table for batches whose results have this schema; no-op if it exists."""
    fields = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    struct = StructType.fromDDL(fields).simpleString()
    position = StructType.fromDDL(POSITION).simpleString()
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (result {struct}, position {position}, batch BIGINT) USING parquet PARTITIONED BY (batch)")


def results(spark: SparkSession, name: str) -> DataFrame:
    """The published batches' results, with the batch's number."""
    return spark.table(name).where("result is not null").select("batch", "result.*")


def positions(spark: SparkSession, name: str) -> DataFrame:
    """(topic, partition, commit): where the log stood after the last published batch that moved it."""
    rows = spark.table(name).where("position is not null").select("batch", "position.*")
    return rows.groupBy("topic", "partition").agg(F.max("commit").alias("commit"))


def batches(spark: SparkSession, name: str) -> list[int]:
    """Numbers of the published batches."""
    return sorted(int(p["batch"]) for p in tables.partitions(spark, name))


def exactly_once(name: str, result: Callable[[DataFrame], DataFrame], offsets: Callable[[DataFrame], DataFrame] = max_offsets, before_publish: Callable[[int], None] | None = None) -> Handler:
    """A handler that publishes ``result`` of each batch with the ``offsets`` to go on from.

    ``before_publish`` is called with the batch's number once its files are written."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if tables.partitions(spark, name, {"batch": number}):
            return
        batch = batch.persist()
        try:
            schema = spark.table(name).schema
            made = result(batch).select(F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema["result"].dataType)).alias("result"))
            stand = offsets(batch).select(F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema["position"].dataType)).alias("position"))
            folder = new_path(spark, f"batch-{number}")
            try:
                made.unionByName(stand, allowMissingColumns=True).write.parquet(folder)
                if before_publish is not None:
                    before_publish(number)
                tables.add_partitions(spark, name, [({"batch": number}, folder)])
            except BaseException:
                remove_path(spark, folder)
                raise
        finally:
            batch.unpersist()

    return handle
