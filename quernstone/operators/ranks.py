"""Row numbers and tiles over a whole table without one task that sorts it all.

Keys are cut into ranges at sampled split keys; a row's number is its number within its range plus
the rows of all ranges before it.  The split keys and one count for each range are all that
passes through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 32
#: Rows that a task is to sort at a time.
ROWS = 1 << 18


def parts_for(rows: int, least: int = 1, each: int = ROWS) -> int:
    """Parts for a table of so many rows, so that a part stays as large as it is when the table grows."""
    return max(least, -(-rows // each))


def sampled_splits(df: DataFrame, key: str, parts: int) -> list:
    """Up to parts - 1 keys that cut the table into ranges of about equal size."""
    ranges = df.select(key).repartitionByRange(parts, key).groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("first"))
    firsts = sorted(r["first"] for r in ranges.collect() if r["first"] is not None)
    # neighbours are compared, as keys may be arrays
    return [key for before, key in zip(firsts, firsts[1:], strict=False) if key != before]


def range_of(key: Column, splits: list) -> Column:
    """Number of the range a key is in: how many split keys are at most the key (0 for a null key).

    Two steps of about the root of their number: among every ``step``-th split key, then among those up to the next."""
    if not splits:
        return F.lit(0)
    splits = sorted(splits)
    step = math.isqrt(len(splits) - 1) + 1
    at_most = lambda keys: F.size(F.filter(keys, lambda s: s <= key))
    before = F.greatest(at_most(F.array(*map(F.lit, splits[::step]))) - 1, F.lit(0)) * step
    return before + at_most(F.slice(F.array(*map(F.lit, splits)), before + 1, F.lit(step)))


def numbered(df: DataFrame, key: str, *more: Column | str, parts: int = PARTS, name: str = "number") -> tuple[DataFrame, int]:
    """The table with every row's number (from 1) in the order of ``key`` and ``more``, and the number of rows."""
    splits = sampled_splits(df, key, parts)
    rows = df.withColumn("range_no", range_of(F.col(key), splits))
    counts = {r.range_no: r["count"] for r in rows.groupBy("range_no").count().collect()}
    before, offsets = 0, []
    for i in sorted(counts):
        offsets += [F.lit(i), F.lit(before)]
        before += counts[i]
    if not offsets:
        return rows.withColumn(name, F.lit(None).cast("long")).drop("range_no"), 0
    within = F.row_number().over(Window.partitionBy("range_no").orderBy(key, *more))
    out = rows.withColumn(name, (within + F.create_map(*offsets)[F.col("range_no")]).cast("long"))
    return out.drop("range_no"), before


def tiles(df: DataFrame, key: str, n: int, parts: int = PARTS) -> DataFrame:
    """(key, tile): tiles 1..n whose sizes differ by one at most, the larger ones first."""
    rows, total = numbered(df.select(key), key, parts=parts)
    size, larger = divmod(total, n)
    at = F.col("number") - 1
    edge = larger * (size + 1)
    tile = F.when(at < edge, F.floor(at / F.lit(size + 1)) + 1).otherwise(F.lit(larger) + F.floor((at - edge) / F.lit(max(size, 1))) + 1)
    return rows.select(key, tile.cast("int").alias("tile"))


# --- one pass: sketches instead of sorts

#: Bytes of a key that a sketch sees, after those that all keys share; as a number they fit in a long.
SKETCHED = 7


def rank_error(k: int) -> float:
    """How far a quantile of a KLL sketch may be off, as a share of the rows (99 % sure; from the sketch's definition)."""
    return 2.296 / k**0.9723


def _shared(low: bytes, high: bytes) -> int:
    return next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))


def sketched_splits(df: DataFrame, key: str, parts: int, k: int = 1024) -> list[str]:
    """Up to parts - 1 texts that cut a table into ranges of about equal size, from one sketch.

    Every task sketches its rows and the sketches are merged, so no key is shuffled.  A sketch holds numbers: the first seven bytes
    after those that the least and the greatest key share.  A split is off by ``rank_error(k)`` of the rows, and by
    those that agree in these bytes.  The splits need not be keys of the table."""
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None or low == high:
        return []
    same = _shared(low.encode(), high.encode())
    part = F.rpad(F.substring(F.encode(F.col(key), "UTF-8"), same + 1, SKETCHED), SKETCHED, F.lit(b"\0"))
    number = F.conv(F.hex(part), 16, 10).cast("long")
    ranks = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    sketch = df.where(F.col(key).isNotNull()).agg(F.kll_sketch_agg_bigint(number, F.lit(k)).alias("sketch"))
    found = sketch.select(F.kll_sketch_get_quantile_bigint("sketch", ranks)).first()[0] if parts > 1 else []
    texts = ((low.encode()[:same] + x.to_bytes(SKETCHED, "big").rstrip(b"\0")).decode("utf-8", "ignore") for x in found)
    return sorted({t for t in texts if t > low})


def with_cuts(df: DataFrame, key: str, splits: list[str], rows: int) -> list[str]:
    """Split keys and those between them that leave about ROWS of a table's rows to a range (sketched)."""
    parts = parts_for(rows)
    return sorted({*splits, *(sketched_splits(df, key, parts) if parts > 1 else [])})


def keys_at(df: DataFrame, key: str, numbers: list[int], parts: int = 256, small: int = 1 << 16) -> list[str | None]:
    """The keys with these numbers (from 1) among the distinct keys in order; None beyond the last.

    Selection by rank: distinct keys are counted by sketched ranges, and only the range that a number falls in is looked at again,
    until it has at most ``small`` keys, which are put in order.  So a pass reads a ``parts``-th of the one before."""
    first: tuple[DataFrame, list[str], list[int]] | None = None

    def counted(rows: DataFrame) -> tuple[DataFrame, list[str], list[int]]:
        splits = sketched_splits(rows, key, parts)
        n = {r.at: r["count"] for r in rows.distinct().groupBy(range_of(F.col(key), splits).alias("at")).count().collect()}
        return rows, splits, [n.get(i, 0) for i in range(len(splits) + 1)]

    def search(nth: int) -> str | None:
        rows, splits, counts = first
        while True:
            at = 0
            while at < len(counts) and nth > counts[at]:
                nth -= counts[at]
                at += 1
            if at == len(counts):
                return None
            part = rows
            if at:
                part = part.where(F.col(key) >= splits[at - 1])
            if at < len(splits):
                part = part.where(F.col(key) < splits[at])
            if counts[at] <= small or counts[at] == sum(counts):
                return part.distinct().orderBy(key).offset(nth - 1).limit(1).first()[0]
            rows, splits, counts = counted(part)

    first = counted(df.select(key).where(F.col(key).isNotNull()))
    return [search(n) if n > 0 else None for n in numbers]


def filled_ranges(df: DataFrame, key: str, splits: DataFrame, parts: int = 256, salts: int = 8, name: str = "region") -> DataFrame:
    """The table with each row's range: how many of the distinct keys of ``splits`` (column split) are at most its key.

    A sorted merge for any number of splits: rows and splits are dealt out by the same coarse ranges (``parts``, sketched),
    put in order together, and each row takes the number of the last split before it.  Rows are salted, and splits go to
    every salt, so a key or a range with many rows is met by ``salts`` tasks."""
    coarse = sketched_splits(df, key, parts)
    cuts = splits.select(F.col("split").alias(key)).where(F.col(key).isNotNull()).distinct()
    cuts = cuts.withColumn("coarse", range_of(F.col(key), coarse))
    n = {r.coarse: r["count"] for r in cuts.groupBy("coarse").count().collect()}
    before, at = [], 0
    for i in range(len(coarse) + 1):
        before.append(at)
        at += n.get(i, 0)
    within = Window.partitionBy("coarse").orderBy(key)
    cuts = cuts.withColumn("filled", F.row_number().over(within)).withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))
    plain = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    rows = df.withColumns({"coarse": F.coalesce(range_of(F.col(key), coarse), F.lit(0)), "salt": F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"), "filled": F.lit(None).cast("int")})
    both = rows.withColumn("is_row", F.lit(1)).unionByName(cuts.withColumn("is_row", F.lit(0)), allowMissingColumns=True)
    # a number of its own: Spark would put parts together by their compressed bytes, which says little of the rows to sort
    both = both.repartition(min(parts * salts, parts_for(df.count() + salts * at, 16)), "coarse", "salt")
    so_far = Window.partitionBy("coarse", "salt").orderBy(F.col(key).asc_nulls_first(), "is_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.coalesce(F.last("filled", ignorenulls=True).over(so_far), F.lit(0)) + F.get(F.array(*map(F.lit, before)), F.col("coarse"))
    return both.withColumn(name, filled.cast("int")).where("is_row = 1").select(*df.columns, name)
