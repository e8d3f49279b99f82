"""Scans of the cell table.

The order of what a scan does: projection, row range, time ranges, version limit, filters, then
limit and offset of cells in each family.  Ranges and projections are plain predicates and reach
the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import CELL_KEY, Field, has_column, to_entities
from .predicates import Filter, filtered
from .ranks import keys_at


@dataclass(frozen=True)
class ScanSpec:
    """What to read.  ``start`` is inclusive, ``stop`` exclusive unless ``include_stop``; time ranges are [from, to)."""

    start: str | None = None
    stop: str | None = None
    include_stop: bool = False
    columns: Mapping[str, list[str] | None] | None = None
    time_range: tuple[int, int] | None = None
    family_time_ranges: Mapping[str, tuple[int, int]] = field(default_factory=dict)
    timestamp: int | None = None
    max_versions: int | None = None
    family_limit: int | None = None
    family_offset: int = 0
    filters: tuple[Filter, ...] = ()


def scan(cells: DataFrame, spec: ScanSpec) -> DataFrame:
    """The cells that a scan reads."""
    out = cells
    if spec.columns is not None:
        out = out.where(has_column(spec.columns))
    if spec.start is not None:
        out = out.where(F.col("row_key") >= spec.start)
    if spec.stop is not None:
        out = out.where(F.col("row_key") <= spec.stop if spec.include_stop else F.col("row_key") < spec.stop)
    if spec.timestamp is not None:
        out = out.where(F.col("ts") == spec.timestamp)
    if spec.time_range is not None:
        out = out.where((F.col("ts") >= spec.time_range[0]) & (F.col("ts") < spec.time_range[1]))
    for family, (lo, hi) in spec.family_time_ranges.items():
        out = out.where((F.col("family") != family) | ((F.col("ts") >= lo) & (F.col("ts") < hi)))
    if spec.max_versions is not None:
        newest = Window.partitionBy(*CELL_KEY).orderBy(F.desc("ts"), F.desc("value"))
        out = out.withColumn("version", F.row_number().over(newest)).where(F.col("version") <= spec.max_versions).drop("version")
    if spec.filters:
        out = filtered(out, list(spec.filters))
    if spec.family_limit is not None or spec.family_offset:
        order = Window.partitionBy("row_key", "family").orderBy("qualifier", F.desc("ts"), F.desc("value"))
        out = out.withColumn("nth", F.row_number().over(order)).where(F.col("nth") > spec.family_offset)
        if spec.family_limit is not None:
            out = out.where(F.col("nth") <= spec.family_offset + spec.family_limit)
        out = out.drop("nth")
    return out


def entities(cells: DataFrame, spec: ScanSpec, fields: list[Field], key: str = "row_key") -> DataFrame:
    """A scan's rows as typed entities."""
    return to_entities(scan(cells, spec), fields, key)


def row_page(cells: DataFrame, page_size: int, page_no: int) -> DataFrame:
    """The cells of one page of rows by key; pages count from 1.

    The page's first and last key are found by rank, at any depth (jobs that run at once); the page is a range of keys."""
    first, last = keys_at(cells, "row_key", [(page_no - 1) * page_size + 1, page_no * page_size])
    if first is None or page_size < 1:
        return cells.where("false")
    return cells.where((F.col("row_key") >= first) & (F.lit(True) if last is None else F.col("row_key") <= last))


def point_get(cells: DataFrame, row_key: str, fields: list[Field], columns: Mapping[str, list[str] | None] | None = None, filters: tuple[Filter, ...] = (), key: str = "row_key") -> DataFrame:
    """One row as an entity (no row if it has none of the cells)."""
    spec = ScanSpec(start=row_key, stop=row_key, include_stop=True, columns=columns, filters=filters)
    return entities(cells, spec, fields, key)


def pulled(df: DataFrame, n: int) -> Iterator[list]:
    """Rows to the caller, n at a time, one partition in memory at once."""
    some = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        some.append(row)
        if len(some) == n:
            yield some
            some = []
    if some:
        yield some


def count_rows(cells: DataFrame) -> DataFrame:
    """The number of distinct row keys."""
    return cells.agg(F.count_distinct("row_key").alias("n_rows"))
