"""The customers as lines of CSV files: a file (or zip entry) holds those of a nation, at most 2**20 keys of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import csv
from .tables import table

_LINE = """'"' || CAST(c_custkey AS VARCHAR) || '","' || c_name || '","say ""' || c_mktsegment || '"", \\\\ ok"'"""
_CSV = """SELECT c_custkey, c_name AS name, 'say "' || c_mktsegment || '", \\ ok' AS quoted, 3 AS n,
  CAST(coalesce(sum(length({line}) + 1) OVER (PARTITION BY c_nationkey, c_custkey // 1048576{more} ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos{entry}
FROM customer"""


def _lines(spark, d):
    values = F.array(F.col("c_custkey").cast("string"), "c_name", F.concat(F.lit('say "'), "c_mktsegment", F.lit('", \\ ok')))
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.floor(F.col("c_custkey") / (1 << 20)).alias("run"), "c_custkey", csv.to_line(values).alias("value"))


def _parsed(rows, *more):
    f = lambda i: F.get("fields", F.lit(i))
    return rows.select(f(0).cast("long").alias("c_custkey"), f(1).alias("name"), f(2).alias("quoted"), F.size("fields").alias("n"), F.col("pos").cast("long").alias("pos"), *more)
