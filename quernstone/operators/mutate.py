"""Upserts and deletes: the cell table is immutable, so both give the table that is left.

Deletes are left-anti joins by the narrowest key that says what goes; Spark broadcasts a small
delete set by its measured size and shuffles a large one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import CELL_KEY, COLUMNS, has_column


def upsert(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """Both sets of versions, less exact repeats of a version, of which the change counts."""
    ranked = cells.select(*COLUMNS, F.lit(0).alias("rank")).union(changes.select(*COLUMNS, F.lit(1).alias("rank")))
    return ranked.groupBy(*CELL_KEY, "ts").agg(F.max(F.struct("rank", "value")).alias("v")).select(*CELL_KEY, "ts", "v.value")


def compact(cells: DataFrame, versions: int = 1) -> DataFrame:
    """The newest versions of every cell."""
    from .scan import ScanSpec, scan

    return scan(cells, ScanSpec(max_versions=versions))


def _without(cells: DataFrame, what: DataFrame, by: list[str]) -> DataFrame:
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in by))
    return cells.join(what.select(*by).where(known).distinct(), by, "left_anti").select(*cells.columns)


def delete_rows(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is in ``keys`` (row_key); null keys are skipped."""
    return _without(cells, keys, ["row_key"])


def delete_families(cells: DataFrame, keys: DataFrame, families: list[str]) -> DataFrame:
    gone = keys.select("row_key", F.explode(F.array(*map(F.lit, families))).alias("family")) if families else None
    return cells if gone is None else _without(cells, gone, ["row_key", "family"])


def delete_columns(cells: DataFrame, keys: DataFrame, columns: dict[str, list[str]]) -> DataFrame:
    """All versions of the named columns of the rows; no columns named deletes nothing."""
    if not any(columns.values()):
        return cells
    named = has_column({f: q for f, q in columns.items() if q})
    return cells.where(~named).unionByName(_without(cells.where(named), keys, ["row_key"]))


def delete_column_sets(cells: DataFrame, instructions: DataFrame, family: str | None = None) -> DataFrame:
    """Per-row sets: (row_key, qualifiers array) in one family, or (row_key, columns map family -> array)."""
    if family is not None:
        gone = instructions.select("row_key", F.lit(family).alias("family"), F.explode("qualifiers").alias("qualifier"))
    else:
        gone = instructions.select("row_key", F.explode("columns").alias("family", "q")).select("row_key", "family", F.explode("q").alias("qualifier"))
    return _without(cells, gone, CELL_KEY)


def delete_versions(cells: DataFrame, versions: DataFrame) -> DataFrame:
    """Exact versions: (row_key, family, qualifier, ts)."""
    return _without(cells, versions, [*CELL_KEY, "ts"])


def delete_entities(cells: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Rows of the entities' keys; entities without a key are skipped."""
    return delete_rows(cells, entities.select(F.col(key).alias("row_key")))


def apply_tombstones(cells: DataFrame, deletes: DataFrame) -> DataFrame:
    """``deletes``: (row_key, family, qualifier, ts), null meaning all of what follows."""
    d = deletes.where("row_key is not null")
    out = delete_rows(cells, d.where("family is null"))
    out = _without(out, d.where("family is not null and qualifier is null"), ["row_key", "family"])
    out = _without(out, d.where("qualifier is not null and ts is null"), CELL_KEY)
    return delete_versions(out, d.where("ts is not null"))
