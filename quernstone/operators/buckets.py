"""Cell tables bucketed and sorted by row key: upserts and compaction without a shuffle of the table.

A store is a view over its current generation, a catalog table of ``buckets`` buckets by row key.  Changes are placed
alike (only they are shuffled) and merged bucket by bucket into the next generation; one statement then lets the view name
it, so readers see the store before or after a merge and never in between.  The generation before is dropped by the merge after
next, when readers that began with it should be done.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cells import CELL_KEY, COLUMNS
from .mutate import compact

_KEYS = [*CELL_KEY, "ts"]
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def _row_key_is_enough(spark: SparkSession) -> Iterator[None]:
    """Joins by more columns may use that both sides are bucketed by row key."""
    before = spark.conf.get(_ALL_KEYS)
    spark.conf.set(_ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(_ALL_KEYS, before)


def _table(name: str, kind: str) -> str:
    return f"{name}_{kind}_{uuid.uuid4().hex}"


def _save(cells: DataFrame, table: str, buckets: int) -> str:
    cells.select(*COLUMNS).write.bucketBy(buckets, "row_key").sortBy("row_key").format("parquet").saveAsTable(table)
    return table


def generation(spark: SparkSession, name: str) -> tuple[str, str | None]:
    """The store's current generation and the one before."""
    found = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    return found["cells.generation"], found.get("cells.before")


def buckets(spark: SparkSession, name: str) -> int:
    return int(next(r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect() if r.key == "cells.buckets"))


def _point(spark: SparkSession, name: str, table: str, n: int, before: str | None) -> None:
    more = f", 'cells.before' = '{before}'" if before else ""
    spark.sql(f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('cells.generation' = '{table}', 'cells.buckets' = '{n}'{more}) AS SELECT * FROM {table}")


def create(cells: DataFrame, name: str, n: int) -> None:
    """A store of these cells in n buckets; choose them so that a bucket is a few hundred MB."""
    spark = cells.sparkSession
    _point(spark, name, _save(cells.repartition(n, "row_key"), _table(name, "g"), n), n, None)


def staged(changes: DataFrame, name: str) -> str:
    """Changes in a table of their own, placed as the store is; of changes of one version the greatest value counts."""
    spark, n = changes.sparkSession, buckets(changes.sparkSession, name)
    once = changes.repartition(n, "row_key").groupBy(*_KEYS).agg(F.max("value").alias("value"))
    return _save(once, _table(name, "changes"), n)


def merged(spark: SparkSession, name: str, changes: str) -> DataFrame:
    """The store with staged changes: versions of both, of a version of both the change."""
    old, new = spark.table(name), spark.table(changes).select(*_KEYS, F.col("value").alias("changed"), F.lit(True).alias("there"))
    rows = old.join(new.hint("merge"), _KEYS, "full_outer")
    return rows.select(*_KEYS, F.when(F.col("there"), F.col("changed")).otherwise(F.col("value")).alias("value"))


def _replace(spark: SparkSession, name: str, cells: DataFrame) -> None:
    n, (now, before) = buckets(spark, name), generation(spark, name)
    table = _save(cells, _table(name, "g"), n)
    _point(spark, name, table, n, now)
    if before:
        spark.sql(f"DROP TABLE IF EXISTS {before}")


def upsert(changes: DataFrame, name: str) -> None:
    """Merge changes into the store."""
    spark = changes.sparkSession
    table = staged(changes, name)
    with _row_key_is_enough(spark):
        _replace(spark, name, merged(spark, name, table))
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def compact_store(spark: SparkSession, name: str, versions: int = 1) -> None:
    """Keep the newest versions of every cell of the store."""
    _replace(spark, name, compact(spark.table(name), versions))


def drop(spark: SparkSession, name: str) -> None:
    now, before = generation(spark, name)
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    for table in filter(None, (now, before)):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
