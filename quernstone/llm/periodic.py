"""Periodic runs of words within each text, and the texts without the repetitions.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and at least ``least`` words and
``times`` periods, that no neighbouring word extends.  Each text is a matter of its own, so nothing is shuffled:

1. Where can runs be.  In a run of at least that length, every word lies in a stretch of 16 (least - least / times) words that stands in the
   run twice, at most a period apart.  Hashes of such stretches are sorted for a few MB of text at once; stretches that a
   text holds once, or whose neighbours are further apart than a run in their surroundings may have as its period, are left
   out.  The rest of the text holds no part of a run.
2. Runs there.  The words of each place are numbered by their bytes; suffix trees of the place and of its reversal
   (``suffixtree``) give the longest common extensions in constant time, and the Lyndon roots extended both ways all runs.
3. Collapse.  Of every run the words after its first period go.

Memory: one text's places with repeated stretches are in memory at once, some 1 KB for each of their words.

Defined results: a null text counts as empty and has no words and no runs; a text without runs keeps its words; every row
gives one row, repeated rows equal ones; a null doc_id stays null; an empty table gives an empty result; other columns
are carried only if named, as other_<name> where a result has the name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rlz import grams
from .suffixtree import maximal_runs
from .wordhash import NOT_SPACE, U64, Words, mix, ragged, text_runs

LEAST, TIMES = 24, 3
RUN_BYTES = 4 << 20


def _stretches(marks: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end word of every place that the marked stretches cover, and the place of each mark."""
    new = np.ones(len(marks), dtype=bool)
    new[1:] = (marks[1:] > marks[:-1] + width) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return marks[first], marks[np.append(first[1:], len(marks))[: len(first)] - 1] + width, np.cumsum(new) - 1


def places(h: np.ndarray, ptr: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of every place that may hold runs, each in one text, given the words' hashes."""
    width = least - least // times
    n = max(0, len(h) - width + 1)
    at = np.arange(n)
    text = np.searchsorted(ptr, at, side="right") - 1
    inside = at + width <= ptr[text + 1]
    at, text = at[inside], text[inside]
    if not len(at):
        return at, at
    keys = grams(h, width)[at] ^ mix(text.astype(U64) + U64(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    one, other = order[:-1][same], order[1:][same]
    far = np.iinfo(np.int64).max
    apart = np.full(len(at), far)
    apart[one] = at[other] - at[one]
    apart[other] = np.minimum(apart[other], at[other] - at[one])
    marked = apart < far
    marks, text, apart = at[marked], text[marked], apart[marked]
    while len(marks):
        first, end, place = _stretches(marks, text, width)
        size = (end - first)[place]
        fits = (size >= least) & (apart <= size // times)
        if fits.all():
            return first, end
        marks, text, apart = marks[fits], text[fits], apart[fits]
    return marks, marks


def runs_of(data: np.ndarray, w: Words, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """Text, start (in the text), length and period of every run, by text, start and period."""
    found = [[np.zeros(0, dtype=np.int64)] * 4]
    look = memoryview(data)
    for first, end in zip(*places(w.hashes(), w.ptr, least, times), strict=True):
        known: dict[bytes, int] = {}
        s = [known.setdefault(bytes(look[a:b]), len(known) + 1) for a, b in zip(w.starts[first:end].tolist(), w.ends[first:end].tolist(), strict=True)]
        start, length, period = maximal_runs(s, len(known))
        fits = (length >= least) & (length >= times * period)
        text = int(np.searchsorted(w.ptr, first, side="right")) - 1
        found.append([np.full(int(fits.sum()), text), start[fits] + first - w.ptr[text], length[fits], period[fits]])
    text, start, length, period = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def _kept_texts(data: np.ndarray, w: Words, kept: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by one space."""
    word = np.flatnonzero(kept)
    size = w.ends[word] - w.starts[word] + 1
    to = np.append(0, np.cumsum(size))
    take = np.minimum(ragged(w.starts[word], size), max(len(data) - 1, 0))
    out = data[take]
    out[to[1:] - 1] = 32
    ptr = np.searchsorted(word, w.ptr)
    # the space after a text's last word goes
    last = ptr[1:][np.diff(ptr) > 0]
    stay = np.ones(len(out), dtype=bool)
    stay[to[last] - 1] = False
    cut = np.append(0, np.cumsum(stay))
    return pa.Array.from_buffers(pa.large_string(), len(ptr) - 1, [None, pa.py_buffer(cut[to[ptr]].astype(np.int64).tobytes()), pa.py_buffer(out[stay].tobytes())]).cast(pa.string())


def _collapsed(least: int, times: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others = list(range(1, batch.num_columns))
            names = [*(batch.schema.names[i] for i in others), "n_words", "runs", "kept_text"]
            for lo, hi, data, offsets in text_runs(batch.column(0), RUN_BYTES):
                w = Words(data, offsets, NOT_SPACE)
                text, start, length, period = runs_of(data, w, least, times)
                gone = np.zeros(len(w.starts) + 1, dtype=np.int64)
                np.add.at(gone, w.ptr[text] + start + period, 1)
                np.add.at(gone, w.ptr[text] + start + length, -1)
                rows = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], ["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32)), rows)
                part = batch.slice(lo, hi - lo)
                made = [pa.array(np.diff(w.ptr).astype(np.int64)), runs, _kept_texts(data, w, np.cumsum(gone[:-1]) == 0)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in others), *made], names)

    return go


def collapsed(docs: DataFrame, keep: tuple[str, ...] = (), least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, in order) and kept_text of every row, and the columns to keep."""
    if times < 2 or least < 2 * times:
        raise ValueError("a run has two periods or more, and two times as many words")
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).alias(f"other_{c}") for c in keep))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    out = rows.mapInArrow(_collapsed(least, times), f"{schema}, n_words long, runs array<struct<start: long, length: long, period: long>>, kept_text string")
    return out.withColumnsRenamed({f"other_{c}": c for c in keep if c not in out.columns})


def strongest(runs: str):
    """The run with the greatest length / period, compared exactly; the first of equals."""
    r = F.col(runs)
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(r, none, lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best))
