"""Intermediate tables in the folder that all executors share.

The folder is the one the session names in ``spark.checkpoint.dir``; only a local session
without that setting (tests) uses a temporary one, any other is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.session import new_path

__all__ = ["new_path", "stored"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no more than the tasks that read the files.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
