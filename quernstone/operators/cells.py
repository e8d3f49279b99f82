"""The cell table, (row_key, family, qualifier, ts, value), and the shapes that turn into it and out of it.

Reading nested rows first picks the newest versions (combined before they are shuffled) and then repartitions
those by row_key once, which serves both levels of nesting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import decode, encode

CELL_KEY = ["row_key", "family", "qualifier"]
COLUMNS = [*CELL_KEY, "ts", "value"]


@dataclass(frozen=True)
class Field:
    """A field of an entity and where its cell is; an empty qualifier is the field's name."""

    name: str
    family: str
    qualifier: str = ""
    codec: str = "string"

    @property
    def column(self) -> str:
        return self.qualifier or self.name


def _version(ts: Column | int | None) -> Column:
    """The one version of a write: a column of the rows written, or a number."""
    return (ts if isinstance(ts, Column) else F.lit(ts).cast("long")).alias("write_ts")


def _versioned(df: DataFrame, value: Column, codec: str, versioned: bool) -> DataFrame:
    at = value["ts"] if versioned else F.col("write_ts")
    raw = value["value"] if versioned else value
    return df.select("row_key", "family", "qualifier", at.alias("ts"), encode(codec, raw).alias("value"))


def from_map(df: DataFrame, family: str, data: str = "data", key: str = "row_key", ts: Column | int | None = None, codec: str = "string", versioned: bool = False) -> DataFrame:
    """Rows of (key, map qualifier -> value) to cells of one family; a row with an empty map gives none.

    ``versioned``: values are struct<value, ts>; otherwise ``ts`` is the one version of this write."""
    rows = df.select(F.col(key).alias("row_key"), _version(ts), F.lit(family).alias("family"), F.explode(data).alias("qualifier", "v"))
    return _versioned(rows, F.col("v"), codec, versioned)


def from_headers(df: DataFrame, family: str, headers: list[str], values: str = "values", key: str = "row_key", ts: Column | int | None = None, codec: str = "string", versioned: bool = False) -> DataFrame:
    """Rows of (key, values) with fixed headers; stops at the shorter of the two."""
    names = F.array(*map(F.lit, headers))
    n = F.least(F.size(values), F.size(names))
    pairs = F.slice(F.arrays_zip(names.alias("q"), F.col(values).alias("v")), F.lit(1), n)
    rows = df.where(F.col(values).isNotNull()).select(F.col(key).alias("row_key"), _version(ts), F.lit(family).alias("family"), F.explode(pairs).alias("pair"))
    rows = rows.select("row_key", "write_ts", "family", F.col("pair.q").alias("qualifier"), F.col("pair.v").alias("v"))
    return _versioned(rows, F.col("v"), codec, versioned)


def from_nested(df: DataFrame, data: str = "data", key: str = "row_key", ts: Column | int | None = None, codec: str = "string", versioned: bool = False, families: Iterable[str] | None = None) -> DataFrame:
    """Rows of (key, map family -> map qualifier -> value); ``families``: those the table has, others are left out."""
    rows = df.select(F.col(key).alias("row_key"), _version(ts), F.explode(data).alias("family", "inner"))
    if families is not None:
        rows = rows.where(F.col("family").isin(*families))
    rows = rows.select("row_key", "write_ts", "family", F.explode("inner").alias("qualifier", "v"))
    return _versioned(rows, F.col("v"), codec, versioned)


def from_entities(df: DataFrame, fields: list[Field], key: str, ts: Column | int | None = None, skip_blank: bool = False, hook: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Entity rows to cells, one for each field that isn't null (nor blank, if ``skip_blank``); ``hook`` is
    applied to the entities before."""
    df = hook(df) if hook is not None else df
    cells = F.array(*[F.struct(F.lit(f.family).alias("family"), F.lit(f.column).alias("qualifier"), encode(f.codec, F.col(f.name)).alias("value")) for f in fields])
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("row_key"), _version(ts).alias("ts"), F.explode(cells).alias("c"))
    rows = rows.select("row_key", "c.family", "c.qualifier", "ts", "c.value").where("value is not null")
    return rows.where(F.trim(F.decode("value", "UTF-8")) != "") if skip_blank else rows


def latest(cells: DataFrame) -> DataFrame:
    """The newest version of every cell (of equal versions, the greatest value)."""
    return cells.groupBy(*CELL_KEY).agg(F.max(F.struct("ts", "value")).alias("v")).select(*CELL_KEY, "v.ts", "v.value")


def has_column(columns: Mapping[str, Iterable[str] | None]) -> Column:
    """Predicate for the named columns; None stands for a whole family."""
    out = F.lit(False)
    for family, qualifiers in columns.items():
        here = F.col("family") == family
        out = out | (here if qualifiers is None else here & F.col("qualifier").isin(*qualifiers))
    return out


def nested(cells: DataFrame, columns: Mapping[str, Iterable[str]] | None = None, families: Iterable[str] | None = None, with_ts: bool = False, codec: str = "string") -> DataFrame:
    """(row_key, data map family -> map qualifier -> value): the newest versions.

    By ``columns``, every named family is there, if empty; by ``families``, only those with cells are."""
    wanted = has_column(columns) if columns is not None else has_column({f: None for f in families}) if families is not None else F.lit(True)
    rows = latest(cells.where(wanted)).repartition("row_key")
    value = decode(codec, F.col("value"))
    item = F.struct("qualifier", (F.struct(value.alias("value"), "ts") if with_ts else value).alias("value"))
    inner = rows.groupBy("row_key", "family").agg(F.map_from_entries(F.sort_array(F.collect_list(item))).alias("inner"))
    out = inner.groupBy("row_key").agg(F.map_from_entries(F.collect_list(F.struct("family", "inner"))).alias("data"))
    if columns is not None:
        full = F.create_map(*[x for f in columns for x in (F.lit(f), F.coalesce(F.try_element_at("data", F.lit(f)), F.map_filter(F.element_at(F.map_values("data"), 1), lambda k, v: F.lit(False))))])
        out = out.select("row_key", full.alias("data"))
    return out


def to_entities(cells: DataFrame, fields: list[Field], key: str = "row_key", hook: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per row key, one typed column per field, null where there is no cell; ``hook`` is applied to the entities read."""
    newest = []
    for f in fields:
        here = (F.col("family") == f.family) & (F.col("qualifier") == f.column)
        newest.append(F.max(F.when(here, F.struct("ts", "value"))).alias(f.name))
    wanted = has_column({family: [f.column for f in fields if f.family == family] for family in dict.fromkeys(f.family for f in fields)})
    rows = cells.where(wanted).groupBy("row_key").agg(*newest)
    out = rows.select(F.col("row_key").alias(key), *[decode(f.codec, F.col(f"{f.name}.value")).alias(f.name) for f in fields])
    return hook(out) if hook is not None else out
