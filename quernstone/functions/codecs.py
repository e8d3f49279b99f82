"""Codecs between typed columns and cell bytes, all big-endian.

Everything but float and double is a built-in expression; Spark has no built-in for IEEE
bytes, so those two go through Arrow in batches.  Bytes of the wrong length decode to null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Codec:
    """How a type is written to and read from bytes."""

    name: str
    spark_type: str
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]


def _whole_to_bytes(n: int) -> Callable[[Column], Column]:
    return lambda c: F.unhex(F.right(F.lpad(F.hex(c.cast("long")), 16, "0"), F.lit(2 * n)))


def _bytes_to_whole(n: int, kind: str) -> Callable[[Column], Column]:
    def decode(b: Column) -> Column:
        if n == 8:
            value = F.conv(F.hex(b), 16, -10).cast("long")
        else:
            unsigned = F.conv(F.hex(b), 16, 10).cast("long")
            value = F.when(unsigned >= 1 << (8 * n - 1), unsigned - (1 << (8 * n))).otherwise(unsigned)
        return F.when(F.octet_length(b) == n, value).cast(kind)

    return decode


def _ieee(kind: str, dtype: str):
    """Bytes of whole Arrow buffers are swapped at once; nulls stay in their bitmap, so NaN is a value like others."""
    width = np.dtype(dtype).itemsize
    number = pa.float64() if width == 8 else pa.float32()

    @F.arrow_udf("binary")
    def encode(a: pa.Array) -> pa.Array:
        raw = np.frombuffer(a.buffers()[1], dtype=dtype[1:])[a.offset : a.offset + len(a)].astype(dtype) if len(a) else np.zeros(0, dtype)
        fixed = pa.Array.from_buffers(pa.binary(width), len(a), [None, pa.py_buffer(raw.tobytes())])
        return pc.if_else(a.is_valid(), fixed, pa.scalar(None, pa.binary(width))).cast(pa.binary())

    @F.arrow_udf(kind)
    def decode(a: pa.Array) -> pa.Array:
        fits = pc.fill_null(pc.equal(pc.binary_length(a), width), False)
        fixed = pc.if_else(fits, a, pa.scalar(bytes(width), a.type)).cast(pa.binary(width))
        at = fixed.offset * width
        raw = np.frombuffer(fixed.buffers()[1], dtype=np.uint8)[at : at + len(fixed) * width] if len(fixed) else np.zeros(0, np.uint8)
        values = pa.array(np.frombuffer(raw.tobytes(), dtype=dtype).astype(dtype[1:]), number)
        return pc.if_else(fits, values, pa.scalar(None, number))

    return encode, decode


def _lazy_ieee(kind: str, dtype: str, which: int) -> Callable[[Column], Column]:
    # a UDF asks for a session when it is made, so it is made on use
    return lambda c: _ieee(kind, dtype)[which](c)


CODECS: dict[str, Codec] = {
    c.name: c
    for c in (
        Codec("string", "string", lambda c: F.encode(c.cast("string"), "UTF-8"), lambda b: F.decode(b, "UTF-8")),
        Codec("bytes", "binary", lambda c: c.cast("binary"), lambda b: b),
        Codec("int", "int", _whole_to_bytes(4), _bytes_to_whole(4, "int")),
        Codec("long", "bigint", _whole_to_bytes(8), _bytes_to_whole(8, "bigint")),
        Codec("short", "smallint", _whole_to_bytes(2), _bytes_to_whole(2, "smallint")),
        Codec("byte", "tinyint", _whole_to_bytes(1), _bytes_to_whole(1, "tinyint")),
        Codec("char", "string", lambda c: F.encode(F.substr(c, F.lit(1), F.lit(1)), "UTF-16BE"), lambda b: F.decode(b, "UTF-16BE")),
        Codec("boolean", "boolean", lambda c: F.when(c, F.unhex(F.lit("FF"))).when(~c, F.unhex(F.lit("00"))), lambda b: F.when(F.octet_length(b) == 1, F.hex(b) != "00")),
        Codec("float", "float", _lazy_ieee("float", ">f4", 0), _lazy_ieee("float", ">f4", 1)),
        Codec("double", "double", _lazy_ieee("double", ">f8", 0), _lazy_ieee("double", ">f8", 1)),
    )
}


def register(codec: Codec) -> None:
    """Make a codec of one's own known by its name."""
    CODECS[codec.name] = codec


def encode(name: str, c: Column) -> Column:
    return CODECS[name].encode(c)


def decode(name: str, b: Column) -> Column:
    return CODECS[name].decode(b)
