"""Bloom filters built and probed by DataFrame functions.

The filter is a table of 64-bit words.  Building is one map-side combined aggregation.  A filter of at
most ``BROADCAST_BITS`` goes to the probing tasks as a one-row map; a larger one is joined by word
instead, so its size is never a limit.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_ERROR = 0.03
BROADCAST_BITS = 1 << 25


@dataclass(frozen=True)
class BloomSpec:
    """Bits and number of hashes for n elements at an error rate."""

    n: int
    p: float = DEFAULT_ERROR

    @property
    def bits(self) -> int:
        return max(1, int(-self.n * math.log(self.p) / math.log(2) ** 2))

    @property
    def hashes(self) -> int:
        return max(1, round(self.bits / max(1, self.n) * math.log(2)))


def _as_text(c: Column) -> Column:
    return c.cast("string")


def indices(c: Column, spec: BloomSpec, mapper: Callable[[Column], Column] = _as_text) -> Column:
    """array<long>: the bits of an element, (h1 + i * h2) mod bits."""
    m = F.lit(spec.bits).cast("long")
    h1, h2 = F.pmod(F.xxhash64(mapper(c)), m), F.pmod(F.xxhash64(mapper(c), F.lit(1)), m)
    return F.transform(F.sequence(F.lit(0), F.lit(spec.hashes - 1)), lambda i: F.pmod(h1 + i * h2, m))


def build(df: DataFrame, column: str, spec: BloomSpec, mapper: Callable[[Column], Column] = _as_text) -> DataFrame:
    """(word_idx, word) of all non-null elements."""
    bits = df.where(F.col(column).isNotNull()).select(F.explode(indices(F.col(column), spec, mapper)).alias("i"))
    one = F.lit(1).cast("long")
    return bits.groupBy(F.expr("i div 64").alias("word_idx")).agg(F.bit_or(F.call_function("shiftleft", one, F.pmod("i", F.lit(64)).cast("int"))).alias("word"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The filter of the elements of both."""
    return a.union(b).groupBy("word_idx").agg(F.bit_or("word").alias("word"))


def _bit(word: Column, i: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, F.pmod(i, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def probe(df: DataFrame, column: str, bloom: DataFrame, spec: BloomSpec, mapper: Callable[[Column], Column] = _as_text, name: str = "maybe") -> DataFrame:
    """The rows with whether each may be in the filter (null elements are not)."""
    if spec.bits > BROADCAST_BITS:
        return _probe_joined(df, column, bloom, spec, mapper, name)
    n_words = (spec.bits + 63) // 64
    zeros = bloom.sparkSession.range(n_words).select(F.col("id").alias("word_idx"), F.lit(0).cast("long").alias("word"))
    words = merge(bloom, zeros).agg(F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]).alias("words"))
    joined = df.join(F.broadcast(words))  # one row of at most BROADCAST_BITS bits
    test = lambda i: _bit(F.get("words", F.floor(i / 64).cast("int")), i)
    return joined.withColumn(name, F.forall(indices(F.col(column), spec, mapper), test) & F.col(column).isNotNull()).drop("words")


def _probe_joined(df: DataFrame, column: str, bloom: DataFrame, spec: BloomSpec, mapper, name: str) -> DataFrame:
    keys = df.select(F.col(column).alias("element")).where("element is not null").distinct()
    bits = keys.select("element", F.explode(indices(F.col("element"), spec, mapper)).alias("i")).withColumn("word_idx", F.expr("i div 64"))
    hits = bits.join(bloom, "word_idx").where(_bit(F.col("word"), F.col("i")))
    found = hits.groupBy("element").agg(F.count("*").alias("n")).where(F.col("n") == spec.hashes).select(F.col("element").alias("found"))
    return df.join(found, F.col(column) == F.col("found"), "left").withColumn(name, F.col("found").isNotNull()).drop("found")
