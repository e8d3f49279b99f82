"""A hash of text that any other system can compute, too."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(text: Column) -> Column:
    """The first 32 bits of the text's MD5, as a whole number from 0 on; null for null."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
