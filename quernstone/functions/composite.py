"""Pairs, collections and maps as columns: their operations and their orders.

Order keys are columns to sort by: pairs by first then second, collections by size then
elements, maps by size then sorted keys (values don't count).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- pairs


def pair(first: Column, second: Column) -> Column:
    """A pair; both sides have to be there, else it is null."""
    return F.when(first.isNotNull() & second.isNotNull(), F.struct(first.alias("first"), second.alias("second")))


def pair_text(p: Column) -> Column:
    return F.format_string("(%s, %s)", p["first"], p["second"])


def pair_order(p: Column) -> list[Column]:
    return [p["first"], p["second"]]


def second_order(p: Column) -> list[Column]:
    return [p["second"]]


# --- collections


def from_texts(*texts: Column | str) -> Column:
    return F.array(*[t if isinstance(t, Column) else F.lit(t) for t in texts])


def size(a: Column) -> Column:
    return F.size(a)


def is_empty(a: Column) -> Column:
    return F.size(a) == 0


def contains(a: Column, x: Column) -> Column:
    return F.array_contains(a, x)


def add(a: Column, x: Column) -> Column:
    """With x at the end; a null isn't added."""
    return F.when(x.isNull(), a).otherwise(F.array_append(a, x))


def add_all(a: Column, b: Column) -> Column:
    return F.concat(a, F.filter(b, lambda x: x.isNotNull()))


def remove(a: Column, x: Column) -> Column:
    """Without the first element equal to x."""
    at = F.array_position(a, x).cast("int")
    rest = F.concat(F.slice(a, F.lit(1), at - 1), F.slice(a, at + 1, F.greatest(F.size(a) - at, F.lit(0))))
    return F.when(at > 0, rest).otherwise(a)


def remove_all(a: Column, b: Column) -> Column:
    """One occurrence of each element of b in turn, until one isn't there."""
    start = F.struct(a.alias("left"), F.lit(True).alias("going"))
    step = lambda acc, x: F.struct(
        F.when(acc["going"], remove(acc["left"], x)).otherwise(acc["left"]).alias("left"),
        (acc["going"] & F.array_contains(acc["left"], x)).alias("going"),
    )
    return F.aggregate(b, start, step, lambda acc: acc["left"])


def contains_all(a: Column, b: Column) -> Column:
    return F.forall(b, lambda x: F.array_contains(a, x))


def retain_all(a: Column, b: Column) -> Column:
    """Elements that b has, repeats kept."""
    return F.filter(a, lambda x: F.array_contains(b, x))


def cleared(a: Column) -> Column:
    return F.filter(a, lambda x: F.lit(False))


def text(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(a, ", "), F.lit("]"))


def fingerprint(a: Column) -> Column:
    return F.xxhash64(a)


def sorted_distinct(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def collection_order(a: Column) -> list[Column]:
    return [F.size(a), a]


# --- maps


def contains_key(m: Column, k: Column) -> Column:
    return F.array_contains(F.map_keys(m), k)


def contains_value(m: Column, v: Column) -> Column:
    return F.array_contains(F.map_values(m), v)


def get(m: Column, k: Column) -> Column:
    return F.try_element_at(m, k)


def get_or_default(m: Column, k: Column, default: Column) -> Column:
    return F.when(contains_key(m, k), F.try_element_at(m, k)).otherwise(default)


def put_all(m: Column, other: Column) -> Column:
    """Entries of both, those of ``other`` counting; its entries without a value aren't put."""
    other = F.map_filter(other, lambda k, v: v.isNotNull())
    keys = F.map_keys(other)
    return F.map_concat(F.map_filter(m, lambda k, v: ~F.array_contains(keys, k)), other)


def put(m: Column, k: Column, v: Column) -> Column:
    """With the entry; a null key or value isn't put."""
    return F.when(k.isNull() | v.isNull(), m).otherwise(F.map_concat(F.map_filter(m, lambda key, _: key != k), F.create_map(k, v)))


def put_if_absent(m: Column, k: Column, v: Column) -> tuple[Column, Column]:
    """The map, and the value if it was put, else null."""
    there = contains_key(m, k)
    return F.when(there, m).otherwise(put(m, k, v)), F.when(~there, v)


def remove_key(m: Column, k: Column) -> Column:
    return F.map_filter(m, lambda key, v: key != k)


def cleared_map(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: F.lit(False))


def sorted_entries(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(sorted_entries(m))


def maps_equal(a: Column, b: Column) -> Column:
    return sorted_entries(a) == sorted_entries(b)


def map_text(m: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(sorted_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", "), F.lit("}"))


def map_order(m: Column) -> list[Column]:
    return [F.size(m), F.array_sort(F.map_keys(m))]
