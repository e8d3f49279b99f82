"""Substring dedup by relative Lempel-Ziv parsing.

The reference of a document is all text that starts earlier (smaller doc_id, or earlier in the same
document).  It is held as an index of windows and as blocks of words:

1. Anchors.  Of the 10-word grams in a window of 20 words, that with the least hash is the window's
   anchor; equal windows have equal anchors.  Anchor hashes are counted (map-side first);
   those that occur twice go to a Bloom filter of bounded size.  About one word in six starts
   an anchor.
2. Index.  Windows whose anchor may be repeated are hashed to 96 bits and sorted by (hash, doc_id, start), in
   partitions by hash, which are scanned as streams: each but the earliest place refers to that one.
   No group is ever held.  Each run of texts settles its own repeats and sends on only the earliest place of each
   hash, so a passage in a third of all documents sends one row for each run, not for each copy.
3. Blocks.  The text that is referred to is cut into blocks of BLOCK words (and the rest of the window
   that starts last in it); only blocks that a document refers to are made, and each goes to the documents that need it.
4. Parse.  A document is factored from left to right.  At the next word whose window the index knows,
   the factor goes on word for word along the block it refers to, as long as the words are equal; the next factor
   begins where it ends.  At the boundary, the windows that begin inside the factor and end
   beyond it are checked: where the words of one equal its own reference's, the next factor follows that from the
   boundary on.  Factors hold ``window`` words or more, or belong to a stretch of that many which crosses a boundary;
   all their words go.

So what goes is exactly the union of all windows that start earlier, and each was compared word for word.
Texts without repeated windows aren't shuffled.

Beyond some 20 M repeated anchors the filter lets unrepeated ones pass and step 2 sends
more windows, at most one for each word; results stay the same.

Defined results: null text counts as empty; empty texts and texts under ``window`` words keep
all words; a null doc_id sorts after all others (which are under 2**62), and of rows without one each different text is a document
of its own; rows that share a doc_id are one document with several texts: equal starts are not earlier, so repeated
rows keep their first copies, and each text loses only words of its own; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bits import Bloom
from .scratch import stored
from .wordhash import NOT_SPACE, U64, Words, as_long, mix, text_runs

WINDOW = 20
RUN_BYTES = 8 << 20
BLOCK = 128
_K = [U64(k) for k in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]
#: Documents without an id are numbered by their text, from here on.
_UNNAMED = 1 << 62


def grams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of n values, put together from runs of 1, 2, 4 ... values."""
    made, have, out, step = h * (_K[4] + U64(2 * salt)), 1, None, 0
    left = n
    while True:
        if left & 1:
            if out is None:
                out, have_out = made, have
            else:  # the shorter run stands first
                m = len(made) - have_out
                out = out[:m] * _K[step % 4] + made[have_out : have_out + m] if m > 0 else made[:0]
                have_out += have
        left >>= 1
        if not left:
            break
        m = max(0, len(made) - have)
        made = made[:m] * _K[step % 4] + (made[have:] ^ (made[have:] >> U64(29)))
        have, step = 2 * have, step + 1
    return mix(out)


def window_anchors(h: np.ndarray, ptr: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows that lie within one text; the place and the hash of the anchor of each."""
    k = window // 2
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    least = grams(h, k)
    at = np.arange(len(least))
    size, goal = 1, window - k + 1
    while size < goal:
        by = min(size, goal - size)
        less = least[by:] < least[:-by]
        at = np.where(less, at[by:], at[:-by])
        least = np.where(less, least[by:], least[:-by])
        size += by
    cross = np.zeros(n + window + 1, dtype=np.int32)
    cuts = ptr[1:-1]
    np.add.at(cross, np.clip(cuts - window + 1, 0, n), 1)
    np.add.at(cross, np.clip(cuts, 0, n), -1)
    inside = np.flatnonzero(np.cumsum(cross[:n]) == 0)
    return inside, at[inside], least[inside]


def _anchor_counts(window: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_runs(batch.column(0), RUN_BYTES):
                w = Words(data, offsets, NOT_SPACE)
                _, at, least = window_anchors(w.hashes(), w.ptr, window)
                new = np.ones(len(at), dtype=bool)
                new[1:] = at[1:] != at[:-1]
                keys, counts = np.unique(least[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(keys)), pa.array(np.minimum(counts, 2).astype(np.int32))], ["anchor", "n"])

    return go


_ROWS = "key long, at long, doc long, ref_doc long, ref_start int, n int"


def _row_batch(key, key2, doc, start, ref_doc=None, ref_start=None, n=None) -> pa.RecordBatch:
    """Places in one layout: ``at`` is the second hash and the start; repeats already settled have a reference and a length."""
    at = key2.astype(np.int64) << 32 | start.astype(np.int64)
    none = lambda kind: pa.nulls(len(key), kind)
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(at), pa.array(doc), none(pa.int64()) if n is None else pa.array(ref_doc), none(pa.int32()) if n is None else pa.array(ref_start.astype(np.int32)), none(pa.int32()) if n is None else pa.array(n.astype(np.int32))],
        ["key", "at", "doc", "ref_doc", "ref_start", "n"],
    )


def _runs(text, doc, start, ref_doc, ref_start):
    """Repeats of the same reference that follow each other, as (doc, start, ref_doc, ref_start, n)."""
    order = np.lexsort((start, start - ref_start, ref_doc, text))
    text, doc, start, ref_doc, ref_start = (x[order] for x in (text, doc, start, ref_doc, ref_start))
    new = np.ones(len(start), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (ref_doc[1:] != ref_doc[:-1]) | (start[1:] != start[:-1] + 1) | (ref_start[1:] != ref_start[:-1] + 1)
    first = np.flatnonzero(new)
    return doc[first], start[first], ref_doc[first], ref_start[first], np.diff(np.append(first, len(start)))


def _rows(doc, start, ref_doc, ref_start, n) -> Iterator[pa.RecordBatch]:
    yield _row_batch(as_long(mix(doc.view(U64))), np.zeros(len(doc), np.int64), doc, start, ref_doc, ref_start, n)


def _settle(key: np.ndarray, key2: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by (hash, doc, start); in that order: is it the first place of its hash, and which place is that."""
    order = np.lexsort((start, doc, key2, key))
    k, k2 = key[order], key2[order]
    head = np.ones(len(order), dtype=bool)
    head[1:] = (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    return order, head, first


def _windows(window: int, bloom):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = bloom.value
        for batch in batches:
            ids = batch.column(1).to_numpy()
            for lo, hi, data, offsets in text_runs(batch.column(0), RUN_BYTES):
                w = Words(data, offsets, NOT_SPACE)
                h = w.hashes()
                at, _, least = window_anchors(h, w.ptr, window)
                at = at[repeated.probe(least)]
                if not len(at):
                    continue
                key, key2 = as_long(grams(h, window, 1)[at]), (grams(h, window, 2)[at] >> U64(32)).astype(np.uint32).view(np.int32)
                text = np.searchsorted(w.ptr, at, side="right") - 1
                doc, start = ids[lo:hi][text], (at - w.ptr[text]).astype(np.int64)
                order, head, first = _settle(key, key2, doc, start)
                doc, start, key, key2, text = doc[order], start[order], key[order], key2[order], text[order]
                later = (doc != doc[first]) | (start != start[first])
                yield from _rows(*_runs(text[later], doc[later], start[later], doc[first][later], start[first][later]))
                yield _row_batch(key[head], key2[head], doc[head], start[head])

    return go


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, at less its start, doc, start): all but the first place of each hash."""
    last = None
    names = ["doc", "start", "ref_doc", "ref_start", "n"]
    for batch in batches:
        key, at, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(key):
            continue
        key2, start = at >> 32, at & 0xFFFFFFFF
        settled = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
        done = batch.filter(pa.array(settled))
        yield pa.RecordBatch.from_arrays([done.column(2), pa.array(start[settled].astype(np.int32)), *(done.column(i) for i in (3, 4, 5))], names)
        rest = np.flatnonzero(~settled)
        if not len(rest):
            continue
        key, key2, doc, start = key[rest], key2[rest], doc[rest], start[rest]
        if last is not None:  # the batch before may hold the first place of this one's first hash
            key, key2, doc, start = (np.concatenate([[x], y]) for x, y in zip(last, (key, key2, doc, start), strict=True))
        head = np.ones(len(key), dtype=bool)
        head[1:] = (key[1:] != key[:-1]) | (key2[1:] != key2[:-1])
        first = np.flatnonzero(head)[np.cumsum(head) - 1]
        later = (doc != doc[first]) | (start != start[first])
        if last is not None:
            later[0] = False
        f = first[-1]
        last = key[f], key2[f], doc[f], start[f]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[later]), pa.array(start[later].astype(np.int32)), pa.array(doc[first][later]), pa.array(start[first][later].astype(np.int32)), pa.array(np.ones(later.sum(), np.int32))], names
        )


def document_number() -> Column:
    """The doc_id, or, where there is none, a hash of the text from 2**62 on."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_UNNAMED) + F.xxhash64(text).bitwiseAND(F.lit(_UNNAMED - 1)))


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, start, ref_doc, ref_start, n): n windows of ``window`` words in a row, from ``start`` on, that also start earlier, and where."""
    spark = docs.sparkSession
    texts = docs.select(F.col("text").cast("string").alias("text"), document_number().alias("doc"))
    counted = texts.select("text").mapInArrow(_anchor_counts(window), "anchor long, n int")
    repeated = counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    bloom = spark.sparkContext.broadcast(Bloom(repeated, "anchor"))
    places = texts.mapInArrow(_windows(window, bloom), _ROWS)
    blocks = places.repartition("key").sortWithinPartitions("key", F.shiftright("at", 32), "doc", "at")
    return blocks.mapInArrow(_scan, "doc long, start int, ref_doc long, ref_start int, n int")


def _along(window: int):
    """Repeated windows of documents (each batch's sorted anew) as runs along the same reference; a run that comes back in equal steps
    (a passage with a period, of which each round repeats the first) is one row, however often it does."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, ref_doc, ref_start, n = (batch.column(i).to_numpy().astype(np.int64) for i in range(5))
            order = np.lexsort((start, start - ref_start, ref_doc, doc))
            doc, start, ref_doc, ref_start, n = (x[order] for x in (doc, start, ref_doc, ref_start, n))
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (ref_doc[1:] != ref_doc[:-1]) | (start[1:] - start[:-1] != n[:-1]) | (ref_start[1:] - ref_start[:-1] != n[:-1])
            first = np.flatnonzero(new)
            if len(first):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _rounds(doc[first], start[first], ref_doc[first], ref_start[first], np.add.reduceat(n, first))], ["doc", "start", "ref_doc", "ref_start", "n", "times", "step"])

    return go


def _rounds(doc, start, ref_doc, ref_start, n) -> tuple[np.ndarray, ...]:
    """Runs (doc, start, ref_doc, ref_start, n) with ``times`` and ``step``: those that differ only in their start, in equal steps, are one."""
    order = np.lexsort((start, n, ref_start, ref_doc, doc))
    doc, start, ref_doc, ref_start, n = (x[order] for x in (doc, start, ref_doc, ref_start, n))
    other = np.ones(len(doc), dtype=bool)
    other[1:] = (doc[1:] != doc[:-1]) | (ref_doc[1:] != ref_doc[:-1]) | (ref_start[1:] != ref_start[:-1]) | (n[1:] != n[:-1])
    steps = np.diff(start, prepend=start[:1])
    new = other.copy()
    # the second of a group sets the step, later ones go on with that of the one before or begin anew
    new[2:] |= ~other[1:-1] & (steps[2:] != steps[1:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(doc)))
    step = np.where(times > 1, steps[np.minimum(first + 1, len(doc) - 1)], 0)
    return doc[first], start[first], ref_doc[first], ref_start[first], n[first], times, step


def _blocks(window: int, size: int, wanted):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted.value.probe(as_long(mix(batch.column(1).to_numpy().view(U64))))))
            texts = batch.column(0).cast(pa.large_binary())
            for doc, text in zip(batch.column(1).to_pylist(), texts, strict=True):
                words = (text.as_py() or b"").split()
                parts = [b" ".join(words[a : a + size + window - 1]) for a in range(0, len(words), size)]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], ["ref_doc", "block", "words"])

    return go


def parse(words: list[bytes], runs: list[tuple[int, int, int, int]], blocks: dict[tuple[int, int], list[list[bytes]]], window: int, size: int = BLOCK) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, words, ref_doc, ref_start) of one document, in order and apart.

    ``runs``: n windows in a row, from ``start`` on, that stand at ``ref_start`` of ``ref_doc``, as (start, n, ref_doc, ref_start);
    ``blocks``: the words of block ``ref_start // size`` of each reference (several lists, if several texts share its id)."""
    windows = sorted((start + i, ref_doc, ref_start + i) for start, n, ref_doc, ref_start in runs for i in range(n))
    starts = [w[0] for w in windows]
    factors: list[tuple[int, int, int, int]] = []
    end = at = 0
    while at < len(windows):
        start, ref_doc, ref_start = windows[at]
        block, begin = divmod(ref_start, size)
        most = 0
        for other in blocks.get((ref_doc, block), ()):
            n = min(len(words) - start, len(other) - begin)
            if n < window or words[start : start + window] != other[begin : begin + window]:
                continue
            k = window
            while k < n and words[start + k] == other[begin + k]:
                k += 1
            most = max(most, k)
        at += 1
        if start + most > end and most:
            a = max(start, end)  # a boundary window's stretch goes on from the boundary
            factors.append((a, start + most - a, ref_doc, ref_start + a - start))
            end = start + most
            at = max(at, bisect_right(starts, end - window))
    return factors


def _cut(window: int, size: int, with_text: bool):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            runs = batch.column("runs") if "runs" in batch.schema.names else None
            rows: list[tuple] = []
            for i in range(len(batch)):
                text = texts[i].as_py() or b""
                words = text.split()
                n, kept, factors = len(words), text, []
                if runs is not None and runs[i].is_valid:
                    blocks: dict[tuple[int, int], list[list[bytes]]] = {}
                    for b in batch.column("blocks")[i].as_py() or ():
                        blocks.setdefault((b["ref_doc"], b["block"]), []).append(b["words"].split())
                    factors = parse(words, [(r["start"] + k * r["step"], r["n"], r["ref_doc"], r["ref_start"]) for r in runs[i].as_py() for k in range(r["times"])], blocks, window, size)
                    keep = np.ones(n, dtype=bool)
                    for at, length, _, _ in factors:
                        keep[at : at + length] = False
                    if with_text:
                        kept = _without(text, keep)
                    words = [words[j] for j in np.flatnonzero(keep)]
                joined = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(joined).hexdigest(), kept.decode("utf-8", "replace") if with_text else None, [{"start": a, "n_words": n_, "ref_doc_id": d if d < _UNNAMED else None, "ref_start": b} for a, n_, d, b in factors] if with_text else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            factor = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("ref_doc_id", pa.int64()), ("ref_start", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], factor), *(batch.column(c) for c in batch.schema.names if c.startswith("other_"))],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "factors", *(c for c in batch.schema.names if c.startswith("other_"))],
            )

    return go


def _members(known, inside: bool):
    """Rows whose ``doc`` may be (isn't) in the filter."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = known.value.probe(as_long(mix(batch.column(batch.schema.get_field_index("doc")).to_numpy().view(U64))))
            yield batch.filter(pa.array(found if inside else ~found))

    return go


def _mixed(docs: DataFrame) -> DataFrame:
    """Distinct document numbers, scrambled for a Bloom filter."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(as_long(mix(batch.column(0).to_numpy().view(U64))))], ["key"])

    return docs.distinct().mapInArrow(go, "key long")


def _without(text: bytes, keep: np.ndarray) -> bytes:
    """The text less the words not kept, each with the white space that follows it."""
    data = np.frombuffer(text, dtype=np.uint8)
    w = Words(data, np.array([0, len(data)]), NOT_SPACE)
    to = np.append(w.starts[1:], len(data))
    return b"".join([text[: w.starts[0]] if len(keep) else text, *(text[w.starts[j] : to[j]] for j in np.flatnonzero(keep))])


def dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = True, keep: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)
    and, ``with_text``, kept_text (white space as it was) and factors.  ``keep``: columns to carry along."""
    sc = docs.sparkSession.sparkContext
    found = repeated_windows(docs, window).repartition("doc").sortWithinPartitions("doc")
    runs = stored(found.mapInArrow(_along(window), "doc long, start long, ref_doc long, ref_start long, n long, times long, step long"), "runs")
    # blocks that are referred to, and who needs them
    numbers = F.sequence(F.floor(F.col("ref_start") / block), F.floor((F.col("ref_start") + F.col("n") - 1) / block))
    needs = runs.select("doc", "ref_doc", F.explode(numbers).alias("block")).distinct()
    texts = docs.select(F.col("text").cast("string").alias("text"), document_number().alias("doc"))
    referred = sc.broadcast(Bloom(_mixed(runs.select("ref_doc")), "key"))
    blocks = texts.mapInArrow(_blocks(window, block, referred), "ref_doc long, block long, words binary")
    own = needs.join(blocks, ["ref_doc", "block"]).groupBy("doc").agg(F.collect_set(F.struct("ref_doc", "block", "words")).alias("blocks"))
    spans = runs.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "ref_doc", "ref_start", "times", "step")).alias("runs"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        *(F.col(c).alias(f"other_{c}") for c in keep), document_number().alias("doc"),
    )
    repeating = sc.broadcast(Bloom(_mixed(runs.select("doc")), "key"))
    layout = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    some = rows.mapInArrow(_members(repeating, True), layout).join(spans, "doc", "left").join(own, "doc", "left")
    others = "".join(f", `other_{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    result = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, factors array<struct<start: long, n_words: long, ref_doc_id: long, ref_start: long>>" + others
    go, rest = _cut(window, block, with_text), _members(repeating, False)
    out = rows.mapInArrow(lambda batches: go(rest(batches)), result).union(some.mapInArrow(go, result))
    out = out if with_text else out.drop("kept_text", "factors")
    return out.withColumnsRenamed({f"other_{c}": c for c in keep})
