"""Record streams: building, writing and reading (topic, key, value) records.

Works with Spark's Kafka connector where it is on the class path, and with any other format
(parquet, memory) given by name.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def records(df: DataFrame, topic: Column | str, value: Column, key: Column | None = None, partition: Column | None = None) -> DataFrame:
    """(topic, key, value[, partition]) of every row; a key may be null."""
    out = [F.lit(topic).alias("topic") if isinstance(topic, str) else topic.alias("topic"), (F.lit(None) if key is None else key).cast("string").alias("key"), value.cast("string").alias("value")]
    return df.select(*out, *([partition.cast("int").alias("partition")] if partition is not None else []))


def write(df: DataFrame, options: dict[str, str], fmt: str = "kafka", mode: str = "append", observe: Callable[[dict], None] | None = None) -> None:
    """Write records; ``observe`` gets the number of records and bytes once they are delivered."""
    if observe is not None:
        from pyspark.sql import Observation

        seen = Observation()
        df = df.observe(seen, F.count("*").alias("records"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("bytes"))
    df.write.format(fmt).options(**options).mode(mode).save()
    if observe is not None:
        observe(seen.get)


def write_stream(df: DataFrame, options: dict[str, str], checkpoint: str, fmt: str = "kafka") -> DataStreamWriter:
    """A writer of a record stream, to be started; its offsets are kept in the checkpoint."""
    return df.writeStream.format(fmt).options(**options).option("checkpointLocation", checkpoint).outputMode("append")


def subscribe(spark: SparkSession, topics: str, servers: str, starts: str | None = None, group: str | None = None, most_per_trigger: int | None = None, least_partitions: int | None = None) -> DataFrame:
    """A stream of the comma-separated topics' records, from the start offsets where given."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topics}
    if starts and parse_starts(starts):
        options["startingOffsets"] = starting_offsets(starts)
    if group:
        options["groupIdPrefix"] = group
    if most_per_trigger:
        options["maxOffsetsPerTrigger"] = str(most_per_trigger)
    if least_partitions:
        options["minPartitions"] = str(least_partitions)
    return envelope(spark.readStream.format("kafka").options(**options).load())


def envelope(df: DataFrame) -> DataFrame:
    """Records with text key and value and where and when they came."""
    return df.select("topic", "partition", "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "timestamp")


def parse_starts(text: str) -> list[tuple[str, int, int]]:
    """``topic:partition:offset,...``; entries whose offset isn't over 0 are left out."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        topic, partition, offset = part.rsplit(":", 2)
        if int(offset) > 0:
            out.append((topic, int(partition), int(offset)))
    return out


def starting_offsets(text: str) -> str:
    """The Kafka source's JSON of the start offsets."""
    found: dict[str, dict[str, int]] = {}
    for topic, partition, offset in parse_starts(text):
        found.setdefault(topic, {})[str(partition)] = offset
    return json.dumps(found, sort_keys=True)


def from_starts(log: DataFrame, starts: str) -> DataFrame:
    """A batch log from its start offsets on; partitions without one from their beginning."""
    test = F.lit(True)
    for topic, partition, offset in parse_starts(starts):
        test = test & ~((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") < offset))
    return log.where(test)


def partition_list(df: DataFrame) -> DataFrame:
    """``topic-partition,...`` of all partitions of a log, one row."""
    parts = df.select("topic", "partition").distinct()
    return parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("topic", "partition"))), lambda p: F.concat_ws("-", p["topic"], p["partition"])), ",").alias("partitions"))


def offset_report(offsets: DataFrame) -> DataFrame:
    """``topic-partition(offset), ...`` of an offsets table, one row."""
    items = F.sort_array(F.collect_list(F.struct("topic", "partition", "offset")))
    return offsets.agg(F.array_join(F.transform(items, lambda p: F.format_string("%s-%d(%d)", p["topic"], p["partition"], p["offset"])), ", ").alias("report"))


def detail() -> Column:
    """``key >>> value(topic-partition)`` of a record."""
    return F.format_string("%s >>> %s(%s-%d)", F.col("key"), F.col("value"), F.col("topic"), F.col("partition"))
