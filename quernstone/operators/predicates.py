"""Filters on cells.

All filters given together hold together.  There are two kinds: *value* filters test the newest
version of one column and keep or drop whole rows (rows without the column go); *cell* filters
keep or drop single cells.  Values compare as bytes of their string form, so '10' < '9'.

All value filters of a call are one aggregation over just the tested columns (their predicate
reaches the scan) and one left-semi join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_hash
from .ranks import keys_at


@dataclass(frozen=True)
class ValueFilter:
    """Keeps the rows whose newest value of a column passes ``test`` (bytes to boolean)."""

    family: str
    qualifier: str
    test: Callable[[Column], Column]


@dataclass(frozen=True)
class CellFilter:
    """Keeps the cells for which the column that ``test`` makes is true."""

    test: Callable[[], Column]


@dataclass(frozen=True)
class TableFilter:
    """Any function of the cell table."""

    apply: Callable[[DataFrame], DataFrame]


Filter = ValueFilter | CellFilter | TableFilter


def _bytes(value: str) -> Column:
    return F.encode(F.lit(value), "UTF-8")


def _text(b: Column) -> Column:
    return F.decode(b, "UTF-8")


def eq(family: str, qualifier: str, value: str) -> ValueFilter:
    return ValueFilter(family, qualifier, lambda b: b == _bytes(value))


def neq(family: str, qualifier: str, value: str) -> ValueFilter:
    return ValueFilter(family, qualifier, lambda b: b != _bytes(value))


def gt(family: str, qualifier: str, value: str) -> ValueFilter:
    return ValueFilter(family, qualifier, lambda b: b > _bytes(value))


def ge(family: str, qualifier: str, value: str) -> ValueFilter:
    return ValueFilter(family, qualifier, lambda b: b >= _bytes(value))


def lt(family: str, qualifier: str, value: str) -> ValueFilter:
    return ValueFilter(family, qualifier, lambda b: b < _bytes(value))


def le(family: str, qualifier: str, value: str) -> ValueFilter:
    return ValueFilter(family, qualifier, lambda b: b <= _bytes(value))


def regex(family: str, qualifier: str, pattern: str, negate: bool = False) -> ValueFilter:
    """The pattern is found anywhere (or nowhere) in the value."""
    return ValueFilter(family, qualifier, lambda b: _text(b).rlike(pattern) != F.lit(negate))


def substring(family: str, qualifier: str, part: str, negate: bool = False) -> ValueFilter:
    """The value contains the part, whatever the case."""
    return ValueFilter(family, qualifier, lambda b: F.contains(F.lower(_text(b)), F.lit(part.lower())) != F.lit(negate))


def family_is(family: str, negate: bool = False) -> CellFilter:
    return CellFilter(lambda: (F.col("family") == family) != F.lit(negate))


def qualifier_is(qualifier: str, negate: bool = False) -> CellFilter:
    return CellFilter(lambda: (F.col("qualifier") == qualifier) != F.lit(negate))


def qualifier_prefix(*prefixes: str) -> CellFilter:
    def test() -> Column:
        out = F.lit(False)
        for p in prefixes:
            out = out | F.startswith(F.col("qualifier"), F.lit(p))
        return out

    return CellFilter(test)


def qualifier_range(start: str | None, include_start: bool, stop: str | None, include_stop: bool) -> CellFilter:
    def test() -> Column:
        q, out = F.encode(F.col("qualifier"), "UTF-8"), F.lit(True)
        if start is not None:
            out = out & ((q >= _bytes(start)) if include_start else (q > _bytes(start)))
        if stop is not None:
            out = out & ((q <= _bytes(stop)) if include_stop else (q < _bytes(stop)))
        return out

    return CellFilter(test)


def row_is(key: str, negate: bool = False) -> CellFilter:
    return CellFilter(lambda: F.col("row_key") != key if negate else F.col("row_key") == key)


def row_prefix(prefix: str) -> CellFilter:
    return CellFilter(lambda: F.startswith(F.col("row_key"), F.lit(prefix)))


def same_version_as(family: str, qualifier: str) -> TableFilter:
    """Cells whose version is one of the named column's in the same row."""

    def apply(cells: DataFrame) -> DataFrame:
        versions = cells.where((F.col("family") == family) & (F.col("qualifier") == qualifier)).select("row_key", "ts").distinct()
        return cells.join(versions, ["row_key", "ts"], "left_semi").select(*cells.columns)

    return TableFilter(apply)


def page(n: int) -> TableFilter:
    """The first n rows by key: those up to the n-th key, which is found by rank (jobs that run at once)."""

    def apply(cells: DataFrame) -> DataFrame:
        (last,) = keys_at(cells, "row_key", [n])
        return cells.where("false") if n < 1 else cells if last is None else cells.where(F.col("row_key") <= last)

    return TableFilter(apply)


def _in_row(cells: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    order = Window.partitionBy("row_key").orderBy("family", "qualifier", F.desc("ts"))
    return cells.withColumn("nth", F.row_number().over(order)).where(keep(F.col("nth"))).drop("nth")


def first_key_only() -> TableFilter:
    """The first cell of each row."""
    return TableFilter(lambda cells: _in_row(cells, lambda nth: nth == 1))


def column_page(limit: int, offset: int) -> TableFilter:
    """At most ``limit`` cells of each row, after ``offset``."""
    return TableFilter(lambda cells: _in_row(cells, lambda nth: (nth > offset) & (nth <= offset + limit)))


def key_only() -> TableFilter:
    """Values blanked."""
    return TableFilter(lambda cells: cells.withColumn("value", F.lit(b"")))


def random_rows(fraction: float, seed: int = 0) -> CellFilter:
    """A share of all rows, by a hash of the key: a row stays or goes as a whole."""
    return CellFilter(lambda: stable_hash(F.concat_ws(":", "row_key", F.lit(seed))) < int(fraction * (1 << 32)))


def without_tested(test: ValueFilter) -> TableFilter:
    """As the value filter, and the tested column is left out."""
    tested = lambda: (F.col("family") == test.family) & (F.col("qualifier") == test.qualifier)
    return TableFilter(lambda cells: filtered(cells, [test]).where(~tested()))


def filtered(cells: DataFrame, filters: list[Filter]) -> DataFrame:
    """Cell filters that are plain predicates first, then table filters, then all value filters at once.

    Value filters see the cells given: a column that a projection left out drops its rows."""
    out = cells
    for f in filters:
        if isinstance(f, CellFilter):
            out = out.where(f.test())
    tests = [f for f in filters if isinstance(f, ValueFilter)]
    if tests:
        columns = list(dict.fromkeys((f.family, f.qualifier) for f in tests))
        here = {c: (F.col("family") == c[0]) & (F.col("qualifier") == c[1]) for c in columns}
        wanted = F.lit(False)
        for c in columns:
            wanted = wanted | here[c]
        newest = [F.max(F.when(here[c], F.struct("ts", "value"))).alias(f"c{i}") for i, c in enumerate(columns)]
        rows = cells.where(wanted).groupBy("row_key").agg(*newest)
        for f in tests:
            rows = rows.where(f.test(F.col(f"c{columns.index((f.family, f.qualifier))}.value")))
        out = out.join(rows.select("row_key"), "row_key", "left_semi")
    for f in filters:
        if isinstance(f, TableFilter):
            out = f.apply(out)
    return out

