"""CSV as rows of text fields with a position: plain, compressed, or all entries of zip files.

One record is one line; fields are separated by commas, may stand in double quotes, and inside
quotes a doubled quote or a backslash before a quote or backslash stands for the character.  There is no header,
lines may differ in their number of fields, and a blank line is one empty field.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FIELD = r',("(?:[^"\\]|\\.|"")*"|[^,]*)'


def fields(line: Column) -> Column:
    """array<string>: the fields of one line."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1))
    inner = lambda x: F.substr(x, F.lit(2), F.length(x) - 2)
    plain = lambda x: F.regexp_replace(F.replace(inner(x), F.lit('""'), F.lit('"')), r'\\(["\\])', "$1")
    quoted = lambda x: (F.length(x) >= 2) & F.startswith(x, F.lit('"')) & F.endswith(x, F.lit('"'))
    return F.transform(raw, lambda x: F.when(quoted(x), plain(x)).otherwise(x))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, entry, pos, fields) of plain or compressed files; the codec goes by the file's extension.

    pos is the number of characters before the record in its file, a line end counting as one: a
    running sum in each block that Spark reads, plus the sums of the blocks before it."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"),
    )
    chars = (F.length("line") + 1).cast("long")
    in_block = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("upto", F.coalesce(F.sum(chars).over(in_block), F.lit(0)))
    blocks = lines.groupBy("file", "block").agg(F.sum(chars).alias("chars"))
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("chars").over(in_file), F.lit(0)).alias("before"))
    rows = rows.join(blocks, ["file", "block"])
    return rows.select("file", F.lit(None).cast("string").alias("entry"), (F.col("before") + F.col("upto")).alias("pos"), fields(F.col("line")).alias("fields"))


def _unzipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for entry in z.infolist():
                    if entry.is_dir():
                        continue
                    pos, rows = 0, []
                    with io.TextIOWrapper(z.open(entry), encoding="utf-8", newline=None) as text:
                        for line in text:
                            line = line.removesuffix("\n")
                            rows.append((path, entry.filename, pos, line))
                            pos += len(line) + 1
                            if len(rows) == 10_000:
                                yield pd.DataFrame(rows, columns=["file", "entry", "pos", "line"])
                                rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=["file", "entry", "pos", "line"])


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """(file, entry, pos, fields) of every entry of zip files, one file in a task, line by line."""
    return unzipped(spark.read.format("binaryFile").load(path))


def unzipped(files: DataFrame) -> DataFrame:
    """The same of zip files at hand: (path, content)."""
    files = files.select("path", "content")
    lines = files.mapInPandas(_unzipped, "file string, entry string, pos long, line string")
    return lines.select("file", "entry", "pos", fields(F.col("line")).alias("fields"))


def to_line(values: Column) -> Column:
    """One CSV line of an array of texts: all in quotes, quotes doubled."""
    return F.array_join(F.transform(values, lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('""')), F.lit('"'))), ",")
