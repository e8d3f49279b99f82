"""Words of many texts at once: splitting and hashing on the bytes of an Arrow column.

Nothing here loops over words.  A text column is taken in runs of whole texts of a few MB;
word limits come from a 256-entry byte table.  A word's hash is a sum over its bytes of one
scrambled 64-bit value for each (place in the word, byte), so words that differ have unrelated
hashes whatever their pattern.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE = 1 << 18

#: Bytes of words: all but space and \t \n \v \f \r.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words: letters, digits, underscore and all of UTF-8 beyond ASCII.
WORDLIKE = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])
#: A-Z to a-z.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (in a new array)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _place_values(n: np.ndarray) -> np.ndarray:
    """Value of each (place << 8 | byte)."""
    return mix((n + U64(1)) * U64(0x9E3779B97F4A7C15))


NEAR = 64
_values = _place_values(np.arange(NEAR << 8, dtype=U64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans stand in order and don't overlap."""
    out = np.empty(len(starts), dtype=U64)
    at = 0
    while at < len(out):
        first = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, first + PIECE, side="right")))
        s, e = starts[at:to] - first, ends[at:to] - first
        n = int(e[-1])
        place = np.arange(n, dtype=np.int32)
        place -= np.repeat(s.astype(np.int32), np.diff(np.append(s, n)))
        far = np.flatnonzero(place >= NEAR)
        key = place << 8 | data[first : first + n]
        key[far] &= 255
        sums = np.empty(n + 1, dtype=U64)
        sums[0] = 0
        value = _values[key]
        value[far] = _place_values(place[far].astype(U64) << U64(8) | data[first + far])
        np.cumsum(value, out=sums[1:])
        out[at:to] = mix(sums[e] - sums[s] + (e - s).astype(U64))
        at = to
    return out


def ragged(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ..., for length[0] places, then from begin[1] on, and so on."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(begin - ends + length, length)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Words:
    """Words of a run of texts: byte limits in ``data``, and ``ptr``: text t has words ptr[t]..ptr[t+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        self.data, self.offsets = data, offsets
        if len(data):
            word = inside[data]
            before = np.empty_like(word)
            before[0], before[1:] = False, word[:-1]
            cuts = offsets[:-1][offsets[:-1] < len(data)]
            before[cuts] = False
            self.starts = np.flatnonzero(word & ~before)
            after = np.empty_like(word)
            after[-1], after[:-1] = False, word[1:]
            after[cuts[cuts > 0] - 1] = False
            self.ends = np.flatnonzero(word & ~after) + 1
        else:
            self.starts = self.ends = np.zeros(0, dtype=np.int64)
        self.ptr = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data, self.starts, self.ends)


def text_runs(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: (first row, end row, bytes, offsets into them).

    Null texts count as empty.  A text longer than the limit makes a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(what, dtype=np.uint8) if what is not None and what.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def binaries(values: np.ndarray, ptr: np.ndarray) -> pa.Array:
    """Binary column whose row t holds values[ptr[t]:ptr[t+1]]."""
    width = values.dtype.itemsize
    values = np.ascontiguousarray(values)
    base = int(ptr[0])
    return pa.Array.from_buffers(
        pa.large_binary(), len(ptr) - 1,
        [None, pa.py_buffer(((ptr - base) * width).astype(np.int64).tobytes()), pa.py_buffer(values[base : int(ptr[-1])].tobytes())],
    ).cast(pa.binary())
