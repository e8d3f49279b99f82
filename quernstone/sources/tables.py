"""Cell tables in the Spark catalog: families and split keys are table properties."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import SparkSession


class MissingFamily(ValueError):
    """The table has no such family."""


def create(spark: SparkSession, name: str, families: list[str], splits: list[str] = (), by_load: bool = False) -> None:
    """Create the table unless it exists; ``by_load``: with a partition for each family and load (``bulkload.load_table``)."""
    quoted = lambda x: json.dumps(list(x)).replace("'", "\\'")
    more, by = (", load STRING", ", load") if by_load else ("", "")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (row_key STRING, qualifier STRING, ts BIGINT, value BINARY, family STRING{more}) USING parquet "
        f"PARTITIONED BY (family{by}) TBLPROPERTIES ('cells.families' = '{quoted(families)}', 'cells.splits' = '{quoted(splits)}')"
    )


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def _property(spark: SparkSession, name: str, key: str) -> list[str]:
    found = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    return json.loads(found.get(key, "[]"))


def families(spark: SparkSession, name: str) -> list[str]:
    return _property(spark, name, "cells.families")


def splits(spark: SparkSession, name: str) -> list[str]:
    return _property(spark, name, "cells.splits")


def check(spark: SparkSession, name: str, wanted: list[str]) -> bool:
    """Does the table exist; an error names a family that it hasn't."""
    if not exists(spark, name):
        return False
    for f in wanted:
        if f not in families(spark, name):
            raise MissingFamily(f"table {name} has no family {f}")
    return True


def _spec(values: Mapping[str, object]) -> str:
    quoted = lambda v: str(v) if isinstance(v, int) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "PARTITION (" + ", ".join(f"`{k}` = {quoted(v)}" for k, v in values.items()) + ")"


def partitions(spark: SparkSession, name: str, values: Mapping[str, object] | None = None) -> list[dict[str, str]]:
    """The table's partitions that have these values."""
    rows = spark.sql(f"SHOW PARTITIONS {name} {_spec(values) if values else ''}").collect()
    return [{k: unquote(v) for k, v in (part.split("=", 1) for part in r.partition.split("/"))} for r in rows]


def add_partitions(spark: SparkSession, name: str, parts: list[tuple[Mapping[str, object], str]]) -> None:
    """Make folders the table's partitions of these values, all in one statement to the catalog; it fails if one is there."""
    if parts:
        at = " ".join(f"{_spec(values)} LOCATION '{folder}'" for values, folder in parts)
        spark.sql(f"ALTER TABLE {name} ADD {at}")


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def truncate(spark: SparkSession, name: str, keep_splits: bool = True) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")
    if not keep_splits:
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('cells.splits' = '[]')")


def snapshot(spark: SparkSession, name: str, snapshot_name: str | None = None) -> str:
    """Copy the table; the name is given or the table's with the time."""
    to = snapshot_name or f"{name}_{datetime.now():%Y%m%d%H%M%S}"
    spark.sql(f"CREATE TABLE {to} USING parquet PARTITIONED BY (family) AS SELECT row_key, qualifier, ts, value, family FROM {name}")
    return to
