"""Benchmark decontamination by spaced seeds.

Words are lower-cased runs of letters, digits and underscores.  A mask selects five positions
of a short span and ignores the others, so a seed still hits where an ignored word was
replaced.  All masks run over every position of training and test texts alike:

1. Test seeds (hash, item_id, position) are made from the benchmark; their hashes fill a Bloom
   filter of fixed size, so what is broadcast doesn't grow with the benchmark.
2. Training positions that pass it are kept as hits, with the stretch of word hashes around
   them (a *region*; neighbouring hits share one).  Everything else stays where it was read.
3. Hits and test seeds meet in an equi-join by hash: (region, item, diagonal).
4. Along each diagonal, words are compared one by one.  A document overlaps an item if some
   window of ``window`` words (the whole item, if shorter) around a hit agrees in at least
   ``similarity`` of its words.

An item shorter than ``window`` gets masks of its own length, so that every overlap that is tolerated
shares a seed: its places are cut into blocks, and each choice of as many blocks as words may differ is
one mask's ignored places.  Documents are searched with them only for lengths that the benchmark has.

Defined results: null texts count as empty; an item without words matches nothing; items of equal words
are searched once and each get their own rows; rows that share a doc_id are one document;
a null doc_id or item_id is kept as null; empty tables give an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import Bloom
from .scratch import stored
from .wordhash import U64, WORDLIKE, Words, as_long, binaries, mix, text_runs

#: Selected positions (1) and ignored ones (0).
MASKS = ("11111", "111011", "1101101", "10110011")
WINDOW = 13
SIMILARITY = 0.8
_K = [U64(k) for k in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]


def short_masks(n: int, similarity: float) -> list[str]:
    """Masks over a whole item of n words: whichever words differ, as many as ``similarity`` allows, one mask ignores them all."""
    differ = int(n * (1 - similarity) + 1e-9)
    blocks = min(n, max(5, differ + 1))
    block = [i * blocks // n for i in range(n)]
    return ["".join("01"[b not in gone] for b in block) for gone in combinations(range(blocks), differ)]


def masks_by_length(lengths: list[int], masks: tuple[str, ...], window: int, similarity: float) -> dict[int, list[tuple[int, str]]]:
    """Numbered masks for items of each length below ``window``, and (under ``window``) for all longer ones."""
    found, number = {window: list(enumerate(masks))}, len(masks)
    for n in sorted(lengths):
        found[n] = list(enumerate(short_masks(n, similarity), number))
        number += len(found[n])
    return found


def seeds(h: np.ndarray, ptr: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of each span that lies within one text."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    x = np.full(n, U64(salt + 1))
    for k, at in enumerate(i for i, c in enumerate(mask) if c == "1"):
        x += h[at : at + n] * _K[k % len(_K)]
    cross = np.zeros(n + 1, dtype=np.int32)
    np.add.at(cross, np.clip(ptr[1:-1] - len(mask) + 1, 0, n), 1)
    np.add.at(cross, np.clip(ptr[1:-1], 0, n), -1)
    inside = np.flatnonzero(np.cumsum(cross[:n]) == 0)
    return mix(x[inside]), inside


def _test_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in text_runs(batch.column(1)):
            w = Words(data, offsets, WORDLIKE)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), binaries(w.hashes(), w.ptr)], ["item_id", "item_words"])


def _test_seeds(masks: dict[int, list[tuple[int, str]]], window: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, words = batch.column(0), batch.column(1)
            for i in range(len(batch)):
                h = np.frombuffer(words[i].as_py(), dtype=U64)
                for salt, mask in masks[min(len(h), window)] if len(h) else ():
                    key, at = seeds(h, np.array([0, len(h)]), mask, salt)
                    yield pa.RecordBatch.from_arrays([pa.array(as_long(key)), pa.array([items[i].as_py()] * len(at), pa.int64()), pa.array(at.astype(np.int32))], ["seed", "item", "item_at"])

    return go


def _regions(masks: list[tuple[int, str]], window: int, bloom):
    span = max(len(mask) for _, mask in masks)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bloom.value
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for lo, hi, data, offsets in text_runs(batch.column(1)):
                w = Words(data, offsets, WORDLIKE)
                h = w.hashes()
                found = [(key[hit], at[hit]) for key, at in (seeds(h, w.ptr, m, i) for i, m in masks) for hit in [known.probe(key)]]
                key, at = (np.concatenate([f[c] for f in found]) for c in (0, 1))
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                key, at = key[order], at[order]
                text = np.searchsorted(w.ptr, at, side="right") - 1
                new = np.ones(len(at), dtype=bool)
                new[1:] = (text[1:] != text[:-1]) | (at[1:] - at[:-1] > 2 * window)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(at)) - 1
                begin = np.maximum(at[first] - window, w.ptr[text[first]])
                end = np.minimum(at[last] + span + window, w.ptr[text[first] + 1])
                which = np.cumsum(new) - 1
                n = len(first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number + np.arange(n)), batch.column(0).slice(lo, hi - lo).take(pa.array(text[first])),
                        pa.array((begin - w.ptr[text[first]]).astype(np.int64)),
                        pa.array([h[b:e].tobytes() for b, e in zip(begin, end, strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(as_long(key))),
                        pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array((at - begin[which]).astype(np.int32))),
                    ],
                    ["region", "doc_id", "begin", "words", "seeds", "places"],
                )
                number += n

    return go


def best_window(same: np.ndarray, window: int) -> tuple[int, int]:
    """Start and matches of the window with most matches (the first of equals)."""
    sums = np.concatenate([[0], np.cumsum(same)])
    n = sums[window:] - sums[:-window]
    at = int(n.argmax())
    return at, int(n[at])


def _overlaps(window: int, similarity: float):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                doc, item = (np.frombuffer(r[c], dtype=U64) for c in ("words", "item_words"))
                lag = r["lag"]  # place in the item less place in the region
                lo, hi = max(0, -lag), min(len(doc), len(item) - lag)
                need = min(window, len(item))
                if hi - lo < need:
                    continue
                at, n = best_window(doc[lo:hi] == item[lo + lag : hi + lag], need)
                if n >= similarity * need - 1e-9:
                    rows.append((r["doc_id"], r["item"], r["begin"] + lo + at, lo + lag + at, need, n))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item", "doc_start", "item_start", "n_words", "n_same"])

    return go


def overlaps(docs: DataFrame, items: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document and benchmark item that overlap: doc_id, item_id, doc_start, item_start (words),
    n_words compared and n_same of the best window."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    sc = docs.sparkSession.sparkContext
    words = items.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).mapInArrow(_test_words, "item_id long, item_words binary")
    test = stored(words.select("item_id", F.xxhash64("item_words").alias("item"), "item_words").distinct(), "items")
    folded = stored(test.select("item", "item_words").dropDuplicates(["item"]), "items")
    # at most window - 1 lengths; a word is eight bytes
    n = (F.octet_length("item_words") / 8).cast("int")
    lengths = [r.n for r in folded.select(n.alias("n")).where((F.col("n") > 0) & (F.col("n") < window)).distinct().collect()]
    by_length = masks_by_length(lengths, masks, window, similarity)
    keys = stored(folded.mapInArrow(_test_seeds(by_length, window), "seed long, item long, item_at int"), "seeds")
    bloom = sc.broadcast(Bloom(keys.select("seed").distinct(), "seed"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    regions = _regions([m for some in by_length.values() for m in some], window, bloom)
    regions = stored(texts.mapInArrow(regions, "region long, doc_id long, begin long, words binary, seeds array<long>, places array<int>"), "regions")
    hits = regions.select("region", F.explode(F.arrays_zip("seeds", "places")).alias("hit")).select("region", F.col("hit.seeds").alias("seed"), F.col("hit.places").alias("place"))
    diagonals = hits.join(keys, "seed").select("region", "item", (F.col("item_at") - F.col("place")).alias("lag")).distinct()
    sides = diagonals.join(regions.select("region", "doc_id", "begin", "words"), "region").join(folded, "item")
    sides = sides.select("doc_id", "item", "begin", "words", "item_words", "lag")
    found = sides.mapInArrow(_overlaps(window, similarity), "doc_id long, item long, doc_start long, item_start long, n_words long, n_same long")
    best = F.max(F.struct("n_same", (-F.col("doc_start")).alias("at"), (-F.col("item_start")).alias("item_at"), "n_words")).alias("best")
    rows = found.groupBy("doc_id", "item").agg(best).join(test.select("item", "item_id"), "item")
    return rows.select("doc_id", "item_id", (-F.col("best.at")).alias("doc_start"), (-F.col("best.item_at")).alias("item_start"), "best.n_words", "best.n_same")
