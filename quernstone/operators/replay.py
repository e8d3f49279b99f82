"""Counter logs: (counter, log_index, op, delta) folded from the start or from a snapshot.

op 1 reads the counter, op 2 adds delta.  Running values over a long log are summed in blocks of
log indices: within a block by a window, plus the sum of all blocks before it, so one much-used
counter doesn't end in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GET, INCREMENT = 1, 2
BLOCK = 1 << 16


def _change():
    return F.when(F.col("op") == INCREMENT, F.col("delta")).otherwise(F.lit(0)).cast("long")


def fold(ops: DataFrame) -> DataFrame:
    """(counter, value, log_index): each counter's value after its last entry."""
    return ops.groupBy("counter").agg(F.sum(_change()).alias("value"), F.max("log_index").alias("log_index"))


def running(ops: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every entry with the counter's value after it."""
    rows = ops.withColumn("block", F.floor(F.col("log_index") / block))
    sums = rows.groupBy("counter", "block").agg(F.sum(_change()).alias("sum"))
    before = Window.partitionBy("counter").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("counter", "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("counter", "block").orderBy("log_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("within", F.sum(_change()).over(inside)).join(sums, ["counter", "block"])
    return out.select(*ops.columns, (F.col("before") + F.col("within")).alias("value"))


def snapshot(ops: DataFrame, log_index: int) -> DataFrame:
    """The state after all entries up to an index."""
    return fold(ops.where(F.col("log_index") <= log_index))


def replay(state: DataFrame, ops: DataFrame) -> DataFrame:
    """A snapshot with the later entries applied; counters that only the log has start from 0."""
    at = state.select("counter", "value", F.col("log_index").alias("upto"))
    later = ops.join(at.select("counter", "upto"), "counter", "left").where("upto is null or log_index > upto")
    changes = later.groupBy("counter").agg(F.sum(_change()).alias("change"), F.max("log_index").alias("last"))
    out = at.join(changes, "counter", "full")
    return out.select("counter", (F.coalesce("value", F.lit(0)) + F.coalesce("change", F.lit(0))).alias("value"), F.coalesce("last", "upto").alias("log_index"))
