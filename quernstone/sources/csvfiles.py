"""CSV files as a Spark data source of lines: plain files by ranges of bytes, entries of zip files one by one.

- A plain file is cut into ranges of ``rangebytes``; a line belongs to the range its first byte is in, and is read from there
  on to its end.  A task has one range, or as many small ones, of one or several files, as make up TASK_BYTES.
- A zip file's central directory, at its end, says where its entries are; each entry is a task that reads its own
  bytes and unpacks them as it goes, so neither the archive nor an entry has to fit in memory.
- A file compressed as a whole (.gz, .bz2) is one task.

Lines end with \\n or \\r\\n.  Rows carry the position of a line in its range, in characters, a line end counting as one; ``lines`` adds
what stands before the range, from a pass that counts the characters of ranges without cutting lines.

Files are opened by URI through Arrow's file systems (local, HDFS, object stores), in tasks; the driver only lists them.
"""

from __future__ import annotations

import bz2
import gzip
import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .csv import fields

NAME = "csv_lines"
SCHEMA = "file string, entry string, first long, pos long, line string"
COUNTS = "file string, first long, chars long"
RANGE_BYTES = 64 << 20
TASK_BYTES = 1 << 20
BATCH_LINES = 8192
CHUNK = 1 << 20


@dataclass
class Part(InputPartition):
    """A range of a plain file (entry None), an entry of a zip file, or a whole compressed file."""

    file: str
    entry: int | None
    first: int
    end: int


@dataclass
class Task(InputPartition):
    """What a task reads: one part, or ranges that follow each other, which are put together in parts of several ranges."""

    parts: list[Part]


def _place(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    return (arrow_fs.LocalFileSystem(), uri.removeprefix("file://")) if uri.startswith("file://") else arrow_fs.FileSystem.from_uri(uri)


def _opened(file: str):
    system, path = _place(file)
    return system.open_input_file(path)


def _listed(path: str) -> list[tuple[str, int]]:
    """(URI, bytes) of a file or of all files of a folder but hidden ones."""
    uri = path if "://" in path else "file://" + path.removeprefix("file:")
    system, at = _place(uri)
    scheme = uri[: len(uri) - len(at)] if uri.endswith(at) else uri.split("://")[0] + "://"
    info = system.get_file_info(at)
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(arrow_fs.FileSelector(at, recursive=True))
    shown = lambda i: i.is_file and not any(p.startswith(("_", ".")) for p in i.path[len(at) :].split("/"))
    return sorted((scheme + i.path, i.size) for i in found if i is info or shown(i))


def _parts(path: str, range_bytes: int) -> Iterator[Part]:
    for file, size in _listed(path):
        if file.endswith(".zip"):
            with _opened(file) as f, zipfile.ZipFile(f) as z:
                yield from (Part(file, i, 0, e.file_size) for i, e in enumerate(z.infolist()) if not e.is_dir())
        elif file.endswith((".gz", ".bz2")):
            yield Part(file, None, 0, -1)
        else:
            yield from (Part(file, None, at, min(at + range_bytes, size)) for at in range(0, size, range_bytes))


def _tasks(parts: Iterator[Part], task_bytes: int = TASK_BYTES) -> Iterator[Task]:
    """Small ranges put together; entries and compressed files are tasks of their own."""
    held, size = [], 0
    for p in parts:
        if p.entry is not None or p.end < 0:
            yield Task([p])
            continue
        if held and size + p.end - p.first > task_bytes:
            yield Task(held)
            held, size = [], 0
        if held and held[-1].file == p.file and held[-1].end == p.first:
            held[-1] = Part(p.file, None, held[-1].first, p.end)
        else:
            held.append(p)
        size += p.end - p.first
    if held:
        yield Task(held)


def _range_lines(f, first: int, end: int) -> Iterator[bytes]:
    """Lines of a file whose first byte is in the range."""
    at, most = first, min(CHUNK, max(1 << 10, end - first))  # no more than the range needs
    if first:  # the line that runs into the range belongs to the one before
        f.seek(first - 1)
        at = first - 1
        while chunk := f.read(most):
            cut = chunk.find(b"\n")
            if cut >= 0:
                at += cut + 1
                break
            at += len(chunk)
        else:
            return
    f.seek(at)
    rest = b""
    while at < end:
        chunk = f.read(most)
        lines = (rest + chunk).split(b"\n")
        rest = lines.pop() if chunk else b""
        for line in lines:
            if at >= end or (not chunk and not line):
                return
            at += len(line) + 1
            yield line
        if not chunk:
            return


def _stream_lines(f) -> Iterator[bytes]:
    for line in io.BufferedReader(f, CHUNK) if not isinstance(f, io.BufferedReader) else f:
        yield line[:-1] if line.endswith(b"\n") else line


def _lines_of(part: Part, range_bytes: int) -> Iterator[tuple[str | None, int, Iterator[bytes]]]:
    """(entry, first byte, lines) of each range of a part, or of all of an entry or a compressed file."""
    with _opened(part.file) as f:
        if part.entry is not None:
            with zipfile.ZipFile(f) as z:
                entry = z.infolist()[part.entry]
                yield entry.filename, 0, _stream_lines(z.open(entry))
        elif part.file.endswith(".gz"):
            yield None, 0, _stream_lines(gzip.open(f))
        elif part.file.endswith(".bz2"):
            yield None, 0, _stream_lines(bz2.open(f))
        else:
            for first in range(part.first, part.end, range_bytes):
                yield None, first, _range_lines(f, first, min(first + range_bytes, part.end))


class LineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.range_bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.counting = options.get("counts", "false") == "true"

    def partitions(self) -> list[Task]:
        parts = _parts(self.path, self.range_bytes)
        return list(_tasks(p for p in parts if not self.counting or p.entry is None and p.end >= 0))

    def read(self, partition: Task | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark makes of no partitions
            return
        schema, rows = _COUNTS if self.counting else _LINES, []
        for part in partition.parts:
            for entry, first, lines in _lines_of(part, self.range_bytes):
                pos = 0
                for line in lines:
                    text = line.removesuffix(b"\r").decode("utf-8", "replace")
                    if not self.counting:
                        rows.append((part.file, entry, first, pos, text))
                    pos += len(text) + 1
                    if len(rows) == BATCH_LINES:
                        yield _batch(rows, schema)
                        rows = []
                if self.counting:
                    rows.append((part.file, first, pos))
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_LINES = pa.schema([("file", pa.string()), ("entry", pa.string()), ("first", pa.int64()), ("pos", pa.int64()), ("line", pa.string())])
_COUNTS = pa.schema([("file", pa.string()), ("first", pa.int64()), ("chars", pa.int64())])


class CsvLines(DataSource):
    """``spark.read.format("csv_lines")``: options path, rangebytes, counts (characters of ranges instead of lines)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return COUNTS if self.options.get("counts", "false") == "true" else SCHEMA

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)


def lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, entry, pos, line) of the file or of all files of the folder; pos counts from the start of the file or entry."""
    spark.dataSource.register(CsvLines)
    source = lambda **more: spark.read.format(NAME).options(path=path, rangebytes=range_bytes, **more).load()
    before = Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    counts = source(counts="true").select("file", "first", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("before"))
    rows = source().join(counts, ["file", "first"], "left")
    return rows.select("file", "entry", (F.coalesce("before", F.lit(0)) + F.col("pos")).alias("pos"), "line")


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, entry, pos, fields): records of CSV files, by path."""
    return lines(spark, path, range_bytes).select("file", "entry", "pos", fields(F.col("line")).alias("fields"))
