"""The standard tables in the shapes of this package: cells, logs and counter logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cells import Field, from_entities, from_map

ORDER_FIELDS = [Field("status", "d"), Field("priority", "d"), Field("price", "m"), Field("custkey", "m")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c):
    return c.cast("decimal(18,2)").cast("string")


def micros(c):
    """Microseconds since the epoch of a timestamp without zone, as in UTC."""
    day = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    clock = F.hour(c).cast("long") * 3600 + F.minute(c).cast("long") * 60
    return (day * 86_400 + clock) * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def order_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("row_key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
        money(F.col("o_totalprice")).alias("price"), F.col("o_custkey").cast("string").alias("custkey"), micros(F.col("o_orderdate")).alias("ts"),
    )


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: families d (status, priority) and m (price, custkey)."""
    return from_entities(order_entities(spark, sf_dir), ORDER_FIELDS, "row_key", F.col("ts"))


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many versions: one row per user, family e, a column per event type."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("row_key"), micros(F.col("ts")).alias("ts"), F.create_map("event_type", money(F.col("value"))).alias("data"))
    return from_map(rows, "e", ts=F.col("ts"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record log: topic by event type, four partitions by user; an event's offset is its id, so offsets have gaps."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"),
        F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), F.col("ts").alias("timestamp"),
    )


def dense_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with offsets 0, 1, 2 ... in each partition."""
    from pyspark.sql import Window

    order = Window.partitionBy("topic", "partition").orderBy("offset")
    return event_log(spark, sf_dir).withColumn("event_id", F.col("offset")).withColumn("offset", (F.row_number().over(order) - 1).cast("long"))


def counter_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter per event type; every fifth entry only reads."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("counter"), F.col("event_id").alias("log_index"),
        F.when(F.col("event_id") % 5 == 0, 1).otherwise(2).cast("tinyint").alias("op"), (F.col("user_id") % 7 + 1).alias("delta"),
    )
