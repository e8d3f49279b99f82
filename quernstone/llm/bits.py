"""Bloom filters that Spark builds and a task probes, and maps of the keys that have several owners.

A filter has about sixteen bits for each member, but never more than MOST bits (32 MB), so it may be
broadcast whatever the data; beyond that, probes pass more often.  Every use here follows a probe by an
exact comparison, so a full filter costs time, never a result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 1 << 20, 1 << 28
BUCKET = 1 << 15


class Bloom:
    """Two bits in a map for each member."""

    def __init__(self, members: DataFrame, column: str):
        """``members``: a long column of keys, read twice: counted first.  The map is put together by a grouped
        aggregation with a group for each 32768 bits and arrives as that many rows of 4 KB."""
        wanted = 16 * members.count()
        self.bits = min(MOST, max(LEAST, 1 << max(0, wanted - 1).bit_length()))
        key = F.col(column)
        first = F.pmod(key, F.lit(self.bits))
        second = F.pmod(F.shiftright(key, 32).bitwiseXOR(F.shiftright(key, 11)), F.lit(self.bits))
        place = members.select(F.explode(F.array(first, second)).alias("at")).select((F.col("at") + 1).alias("at"))
        rows = (
            place.groupBy(F.bitmap_bucket_number("at").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
            .collect()
        )
        self.map = np.zeros(self.bits // 8, dtype=np.uint8)
        for r in rows:
            at = (r.bucket - 1) * (BUCKET // 8)
            self.map[at : at + BUCKET // 8] = np.frombuffer(r.bits, dtype=np.uint8)

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Mask of the 64-bit keys that may be members."""
        k = keys.view(np.int64)
        first = k & (self.bits - 1)
        found = ((self.map[first >> 3] >> (first & 7).astype(np.uint8)) & 1).astype(bool)
        where = np.flatnonzero(found)
        k = k[where]
        second = ((k >> 32) ^ (k >> 11)) & (self.bits - 1)
        found[where] = ((self.map[second >> 3] >> (second & 7).astype(np.uint8)) & 1).astype(bool)
        return found


#: Bits of a map of owners at most (16 MB); a task holds two.
MOST_OWNED = 1 << 27
MARKS = "block int, once binary, twice binary"


def owned_bits(n: int) -> int:
    """How many bits a map for n keys (each owner's counted) has: at least four a key, as far as it may."""
    return min(MOST_OWNED, max(LEAST, 1 << max(0, 4 * n - 1).bit_length()))


class Marks:
    """The keys of one task by their owners: bits that were met, and those met again with another owner."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = (np.zeros(bits // 8, dtype=np.uint8) for _ in range(2))

    def add(self, keys: np.ndarray, owners: np.ndarray) -> None:
        """64-bit keys and the owner of each.  A bit met in an earlier call counts as another owner's."""
        at = keys.view(np.int64) & (self.bits - 1)
        order = np.argsort(at)
        at, owners = at[order], owners[order]
        head = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
        if not len(head):
            return
        several = np.minimum.reduceat(owners, head) < np.maximum.reduceat(owners, head)
        byte, bit = at[head] >> 3, np.uint8(1) << (at[head] & 7).astype(np.uint8)
        several |= self.once[byte] & bit > 0
        np.bitwise_or.at(self.twice, byte[several], bit[several])
        np.bitwise_or.at(self.once, byte, bit)

    def rows(self) -> pa.RecordBatch:
        """MARKS: a row for each 32768 bits of which any is set."""
        once, twice = (m.reshape(-1, BUCKET // 8) for m in (self.once, self.twice))
        some = np.flatnonzero(once.any(axis=1))
        columns = [pa.array(some.astype(np.int32)), *(pa.array([m[i].tobytes() for i in some], pa.binary()) for m in (once, twice))]
        return pa.RecordBatch.from_arrays(columns, ["block", "once", "twice"])


def _marks_of_all(group: pd.DataFrame) -> pd.DataFrame:
    once, twice = (np.zeros(BUCKET // 8, dtype=np.uint8) for _ in range(2))
    for a, b in zip(group["once"], group["twice"], strict=True):
        a = np.frombuffer(a, dtype=np.uint8)
        twice |= np.frombuffer(b, dtype=np.uint8) | once & a
        once |= a
    return pd.DataFrame({"block": [group["block"].iloc[0]], "twice": [twice.tobytes()]})


class Owned:
    """Which keys may have several owners.  Every key that has passes; one of a single owner if its bit has another's too, or it was
    met in several tasks."""

    def __init__(self, marks: DataFrame, bits: int):
        """``marks``: the rows of every task's ``Marks`` of so many bits; they are put together block by block."""
        self.bits = bits
        self.map = np.zeros(bits // 8, dtype=np.uint8)
        for r in marks.groupBy("block").applyInPandas(_marks_of_all, "block int, twice binary").collect():
            self.map[r.block * (BUCKET // 8) : (r.block + 1) * (BUCKET // 8)] = np.frombuffer(r.twice, dtype=np.uint8)

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Mask of the 64-bit keys that may have several owners."""
        at = keys.view(np.int64) & (self.bits - 1)
        return ((self.map[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
