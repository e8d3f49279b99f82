"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document's k-mers are runs of five words (lower-cased letters, digits and underscores),
each labelled with its occurrence number, so repeated k-mers count.  For each of ``m`` hash
orders a sample is taken: the least k-mer among first occurrences and the ``l - 1`` least of
all others, kept *in the order they have in the text*.  Two documents share such a sample with
a chance that falls with their edit distance, not just with the overlap of their k-mer sets;
the first-occurrence k-mer keeps documents apart that have only one much repeated phrase in
common.  Documents that share a sample are candidates.

With 64 orders of two k-mers, two texts whose k-mers agree in J share a sample with a chance of about
1 - (1 - J**2)**64: 0.93 at J = 0.2, which is what edits spread evenly over a fifth of the words leave,
and 0.998 at 0.3.

What is a pair: the alignment of the two word sequences within a diagonal band of
``(1 - similarity) * longer length`` has an edit similarity of at least ``similarity``, and their
distinct k-mers agree in at least what that similarity leaves when edits are spread evenly
(s**5 / (2 - s**5), about 0.2), so one phrase repeated in both isn't enough.  Both belong to the rule: texts of which close to a
fifth of the words is changed, evenly spaced, have hardly a run of five words in common and are no pair.

- Texts with equal word sequences are one node; copies are never paired.
- In each bucket every node is held against the least node only (a star), so a large group of
  near copies costs one alignment for each member and bucket, not its square.
- Where that leaves a bucket of at most HOT nodes in several components, all pairs across its components follow,
  unless their lengths rule them out; one shared sample is enough.  Pairs inside a component are never made.
- Larger buckets in several components come from passages that many unlike texts share.  Their nodes are joined exactly (``_across``): no
  pair of them that the rule takes is left out, whatever samples it shares.  A text of m words has at least m - q + 1 - q * edits runs of
  q words in common with a similar one, and by the second half of the rule a share of its distinct k-mers; so two similar texts have one of the
  rarest runs in common that are left when that many less one of the commonest are set aside.  Runs of two words, of five (which count once however often a text repeats them) and of one follow each other:
  where a rare run stands in at most HOT nodes, all pairs across components follow; nodes that have one in more (a passage that is
  too large a share of their text) go on to the next.  Runs of one component only are the rarest, as they link nothing, and those of more than CROWD * HOT nodes
  (and a few that a filter of fixed size takes for such; an order needs only be the same for all texts) the commonest.  The former aren't shuffled
  at all, but for some: a map of fixed size, of bits that runs of several components have, rules them out.  The latter are once, for the count,
  which each task sums up over its texts before, so that a passage of all of them is one row of it.  What is crowded still after single words agrees in most of its words: those nodes are held against each other
  in blocks, each a task of its own, ruled out by their counts of words first.  That step alone grows with the square of its nodes.
- Texts are never shuffled: the word sequences of candidates only are, picked where the texts
  are read by a Bloom filter of fixed size.

Defined results: null text counts as empty; texts without words are copies of each other only
if equal; texts of one to four words have one k-mer (all their words); a null doc_id has a
null class and links nothing; rows that share a doc_id are one document, aligned by that of its texts (other than copies of
documents with a lesser id) whose digest is the least; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bits import MARKS, Bloom, Marks, Owned, owned_bits
from .components import components
from .rlz import grams
from .scratch import stored
from .wordhash import U64, WORDLIKE, Words, as_long, binaries, mix, ragged, text_runs

WORDS_IN_KMER = 5
SIMILARITY = 0.8
ORDERS = 64
LEAST = 2
HOT = 16
CROWD = 8
RUNS = (2, WORDS_IN_KMER, 1)
AT_ONCE = 1 << 18
IN_BLOCK = 256
COUNTS = 256
_factors = (np.random.default_rng(20190712).integers(1, 1 << 63, size=256, dtype=np.uint64) << U64(1)) | U64(1)


def occurrence_labels(kmers: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k-mer with the number of times it stood before in the same text, and whether that is none."""
    key = mix(kmers ^ (text.astype(U64) * U64(0x9FB21C651E98DF25)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    head = np.ones(len(k), dtype=bool)
    head[1:] = k[1:] != k[:-1]
    at = np.arange(len(k))
    nth = np.empty(len(k), dtype=U64)
    nth[order] = at - at[head][np.cumsum(head) - 1] if len(k) else 0
    return mix(kmers + nth * U64(0xC2B2AE3D27D4EB4F)), nth == 0


def sketch(labels: np.ndarray, first: np.ndarray, orders: int, least: int) -> np.ndarray:
    """One hash for each order: of the least first occurrence and the least others under it, in text order."""
    n = len(labels)
    take = min(least, n)
    firsts = None if first.all() else np.flatnonzero(first)
    out = np.zeros(orders, dtype=U64)
    rows = max(1, min(orders, (1 << 20) // max(n, 1)))
    for a in range(0, orders, rows):
        v = labels * _factors[a : min(a + rows, orders), None]
        which = np.arange(len(v))
        picked = np.empty((len(v), take), dtype=np.int64)
        for i in range(take):
            picked[:, i] = firsts[v[:, firsts].argmin(axis=1)] if i == 0 and firsts is not None else v.argmin(axis=1)
            v[which, picked[:, i]] = np.iinfo(np.uint64).max
        picked.sort(axis=1)
        key = np.arange(a, a + len(v), dtype=U64)
        for i in range(take):
            key = mix(key * U64(0x9E3779B97F4A7C15) + labels[picked[:, i]])
        out[a : a + len(v)] = key
    return out


def text_kmers(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """K-mers of all texts and the text of each; a text under five words has its words' hash as its only one."""
    n = np.diff(ptr)
    all_kmers = grams(h, WORDS_IN_KMER)
    count = np.where(n >= WORDS_IN_KMER, n - WORDS_IN_KMER + 1, np.minimum(n, 1))
    begin = np.cumsum(count) - count
    text = np.repeat(np.arange(len(n)), count)
    kmers = np.zeros(len(text), dtype=U64)
    long_ = n[text] >= WORDS_IN_KMER
    kmers[long_] = all_kmers[ragged(ptr[:-1], count)[long_]]
    for t in np.flatnonzero((n > 0) & (n < WORDS_IN_KMER)):
        x = np.zeros(1, dtype=U64)
        for word in h[ptr[t] : ptr[t + 1]]:
            x = mix(x * U64(0x9E3779B97F4A7C15) + word)
        kmers[begin[t]] = x[0]
    return kmers, text


def text_samples(kmers: np.ndarray, text: np.ndarray, n: int, orders: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples of n texts, one row for each text, and which have any."""
    count = np.bincount(text, minlength=n)
    ptr = np.append(0, np.cumsum(count))
    labels, first = occurrence_labels(kmers, text)
    keys = np.zeros((n, orders), dtype=U64)
    for t in np.flatnonzero(count):
        keys[t] = sketch(labels[ptr[t] : ptr[t + 1]], first[ptr[t] : ptr[t + 1]], orders, least)
    return keys, count > 0


def _lists(keys: np.ndarray, some: np.ndarray) -> pa.Array:
    """A list of samples for each text; none where there are none."""
    at = np.append(0, np.cumsum(np.where(some, keys.shape[1], 0))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(as_long(keys[some].reshape(-1))))


def text_digests(data: np.ndarray, offsets: np.ndarray, w: Words, h: np.ndarray) -> np.ndarray:
    """Two numbers for each text: of its words, or of its bytes if it has none."""
    out = np.empty((len(offsets) - 1, 2), dtype=np.int64)
    for t in range(len(out)):
        what = b"w" + h[w.ptr[t] : w.ptr[t + 1]].tobytes() if w.ptr[t + 1] > w.ptr[t] else b"t" + data[offsets[t] : offsets[t + 1]].tobytes()
        out[t] = np.frombuffer(hashlib.blake2b(what, digest_size=16).digest(), dtype=np.int64)
    return out


def _sketches(orders: int, least: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_runs(batch.column(1)):
                w = Words(data, offsets, WORDLIKE)
                h = w.hashes()
                n = np.diff(w.ptr)
                keys, some = text_samples(*text_kmers(h, w.ptr), len(n), orders, least)
                digests = text_digests(data, offsets, w, h)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(n.astype(np.int32)), _lists(keys, some)], ["doc_id", "d1", "d2", "n", "keys"]
                )

    return go


def _sequences(wanted):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted.value.probe(batch.column(0).to_numpy())))
            for lo, hi, data, offsets in text_runs(batch.column(1)):
                w = Words(data, offsets, WORDLIKE)
                h = w.hashes()
                digests = text_digests(data, offsets, w, h)
                made = [batch.column(0).slice(lo, hi - lo), pa.array(digests[:, 0]), pa.array(digests[:, 1]), binaries((h >> U64(32)).astype(np.uint32), w.ptr)]
                yield pa.RecordBatch.from_arrays(made, ["node", "d1", "d2", "words"])

    return go


def banded_distance(a: np.ndarray, b: np.ndarray, band: int) -> int | None:
    """Edit distance of two sequences if it is at most ``band``, else None.

    Bit-parallel over the 2 * band + 1 diagonals: the vertical differences of a column stand
    in one integer that moves one row down with each element of ``b``.
    """
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    front = n if same.all() else int(same.argmin())
    a, b = a[front:], b[front:]
    n -= front
    if n:
        same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
        back = n if same.all() else int(same.argmin())
        a, b = a[: len(a) - back], b[: len(b) - back]
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > band:
        return None
    if not n:
        return m
    band = min(band, m)
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    width = 2 * band + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    up, down, score = full ^ ((1 << band) - 1), 0, band
    most = band + n - (m - band)
    for j, x in enumerate(b.tolist(), 1):
        eq = places.get(x, 0)
        shift = j - band - 1
        eq = (eq >> shift if shift >= 0 else eq << -shift) & full
        same_diag = ((((eq & up) + up) ^ up) | eq | down) & full
        right_up = (down | ~(same_diag | up)) & full
        right_down = same_diag & up
        if j + band <= m:
            if not same_diag & top:
                score += 1
                if score > most:
                    return None
        else:
            row = 1 << (m - j + band)
            if right_up & row:
                score += 1
            elif right_down & row:
                score -= 1
        moved = same_diag >> 1
        up = (right_down | ~(moved | right_up)) & full
        down = moved & right_up
    return score if score <= band else None


def distinct_kmers(words: np.ndarray) -> np.ndarray:
    n = WORDS_IN_KMER
    return np.unique(grams(words.astype(U64), n)) if len(words) >= n else np.unique(words)


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Is the edit similarity of two word sequences, and that of their distinct k-mers, high enough."""
    a, b = distinct_kmers(x), distinct_kmers(y)
    both = len(np.intersect1d(a, b, assume_unique=True))
    kept = similarity**WORDS_IN_KMER
    if len(x) >= WORDS_IN_KMER <= len(y) and both * (2 - kept) < (len(a) + len(b) - both) * kept:
        return False
    return banded_distance(x, y, int((1 - similarity) * max(len(x), len(y)) + 1e-9)) is not None


def _aligned(similarity: float):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            first, second = batch.column("words_a"), batch.column("words_b")
            kept = []
            for i in range(len(batch)):
                x, y = (np.frombuffer(c[i].as_py(), dtype=np.uint32) for c in (first, second))
                if similar(x, y, similarity):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([a.take(pa.array(kept, pa.int64())), b.take(pa.array(kept, pa.int64()))], ["a", "b"])

    return go


def _words(nodes: DataFrame, texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node, words) of these nodes (and some more), by the chosen text of each."""
    wanted = nodes.sparkSession.sparkContext.broadcast(Bloom(nodes, "node"))
    words = texts.mapInArrow(_sequences(wanted), "node long, d1 long, d2 long, words binary").join(chosen, ["node", "d1", "d2"], "left_semi")
    return stored(words.select("node", "words").dropDuplicates(["node"]), "sequences")


def _verified(pairs: DataFrame, texts: DataFrame, chosen: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts align, each by its chosen one."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    words = _words(nodes.distinct(), texts, chosen).hint("merge")
    sides = pairs.join(words.select(F.col("node").alias("a"), F.col("words").alias("words_a")), "a")
    sides = sides.join(words.select(F.col("node").alias("b"), F.col("words").alias("words_b")), "b")
    return sides.mapInArrow(_aligned(similarity), "a long, b long")


def _repeated(hubs):
    """The samples of each node that others may share."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1)
            flat, n = keys.flatten().to_numpy(zero_copy_only=False), np.diff(keys.offsets.to_numpy())
            may = hubs.value.probe(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), n)[may]), pa.array(flat[may])], ["node", "key"])

    return go


def _pairs(placed: DataFrame, lengths: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that share a bucket of (key, node, root) rows but no root."""
    placed = stored(placed.join(lengths, "node"), "placed")
    roots = placed.select("key", F.col("root").alias("root_b")).distinct()
    first = placed.select("key", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"))
    second = placed.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"))
    met = first.join(roots, "key").where("root_a < root_b").join(second, ["key", "root_b"])
    return met.where(_worth(similarity)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _worth(similarity: float):
    """May texts of n_a and n_b words be similar; the aligner's band is rounded down after adding 1e-9, so this must not be the tighter bound."""
    return F.greatest("n_a", "n_b") - F.least("n_a", "n_b") <= F.floor((1 - similarity) * F.greatest("n_a", "n_b") + 1e-9)


def least_common(n: int, q: int, similarity: float) -> int:
    """How many runs of q words (with their number of occurrence) a text of n words has in common with any similar one at least, which may be 0."""
    least = n
    for m in range(n, int(n / similarity + 1e-9) + 1):
        least = min(least, m - q + 1 - q * int((1 - similarity) * m + 1e-9))
    return max(0, least)


def rare_runs(words: np.ndarray, q: int, similarity: float) -> tuple[np.ndarray, int]:
    """The runs of q words of a text, as numbers, and how many of the rarest of them a similar text can't miss all of."""
    if q == WORDS_IN_KMER:
        runs = distinct_kmers(words) if len(words) >= q else np.zeros(0, U64)
        kept = similarity**q
        common = int(np.ceil(kept / (2 - kept) * len(runs) - 1e-9))
    else:
        runs = grams(words.astype(U64), q) if len(words) >= q else np.zeros(0, U64)
        runs = np.unique(occurrence_labels(runs, np.zeros(len(runs), np.int64))[0])
        common = least_common(len(words), q, similarity)
    return runs, len(runs) - max(common, 1) + 1


def not_by_runs(q: int, similarity: float) -> int | None:
    """Texts up to this many words may have similar ones without a common run of q words; None: texts of any length may."""
    if q == WORDS_IN_KMER:  # the rule asks texts under five words for none, and so their partners
        return int((q - 1) / similarity + 1e-9)
    if q * (1 - similarity) >= 0.9:
        return None
    upto = int((2 * q + 2) / (1 - q * (1 - similarity))) + 1
    return max((n for n in range(1, upto + 1) if least_common(n, q, similarity) < 1), default=0)


def _runs_at_once(batches: Iterator[pa.RecordBatch], q: int, similarity: float, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The runs of texts (node, root, words) and the root of each, of texts of ``at_once`` runs at a time."""
    runs, roots, size = [], [], 0

    def both() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate(runs), np.repeat(np.array(roots, np.int64), [len(r) for r in runs])

    for batch in batches:
        for root, words in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            runs.append(rare_runs(np.frombuffer(words.as_py(), dtype=np.uint32), q, similarity)[0])
            roots.append(root)
            size += len(runs[-1])
            if size >= at_once:
                yield both()
                runs, roots, size = [], [], 0
    if size:
        yield both()


def _marked(q: int, similarity: float, bits: int, at_once: int = AT_ONCE):
    """Marks of the runs of texts (node, root, words) by their roots: two maps of fixed size for each task, however many runs it has."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(bits)
        for key, root in _runs_at_once(batches, q, similarity, at_once):
            marks.add(key, root)
        yield marks.rows()

    return go


def _counted(q: int, similarity: float, at_once: int = AT_ONCE, owned=None):
    """(key, n, lo, hi) of every run of texts (node, root, words), or of those that pass ``owned``: how many texts have it and their least
    and greatest root, summed up over texts until there are sums of half of ``at_once`` runs."""

    def summed(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        key, n, lo, hi = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(key)
        key = key[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        return key[head], np.add.reduceat(n[order], head), np.minimum.reduceat(lo[order], head), np.maximum.reduceat(hi[order], head)

    def rows(sums: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(as_long(sums[0])), *(pa.array(c) for c in sums[1:])], ["key", "n", "lo", "hi"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for key, root in _runs_at_once(batches, q, similarity, at_once):
            if owned is not None:
                may = owned.value.probe(key)
                key, root = key[may], root[may]
            held.append((key, np.ones(len(key), np.int64), root, root))
            size += len(key)
            if size >= at_once:
                held = [summed(held)]
                size = len(held[0][0])
                if 2 * size >= at_once:
                    yield rows(held[0])
                    held, size = [], 0
        if size:
            yield rows(summed(held))

    return go


def _runs(q: int, similarity: float, some, big):
    """(key, node, root, aside) of the runs of texts (node, root, words), some texts at a time; aside: how many of a text's commonest runs may be set aside.

    Of two filters, ``some`` and ``big``: only runs that are in the first and not in the second; those in the second are set aside before
    all others, and a text that has more of them than it may set aside has a row without a key."""

    def batched(rows: list[tuple[np.ndarray, int, int, int, bool]]) -> pa.RecordBatch:
        n = [len(r[0]) + r[4] for r in rows]
        none = np.zeros(sum(n), dtype=bool)
        none[np.cumsum(n)[[r[4] for r in rows]] - 1] = True
        columns = [np.repeat(np.array([r[i] for r in rows], np.int64), n) for i in (1, 2, 3)]
        keys = np.zeros(len(none), dtype=np.int64)
        keys[~none] = as_long(np.concatenate([r[0] for r in rows]))
        return pa.RecordBatch.from_arrays([pa.array(keys, mask=none), pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int32))], ["key", "node", "root", "aside"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for node, root, words in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), strict=True):
                runs, most = rare_runs(np.frombuffer(words.as_py(), dtype=np.uint32), q, similarity)
                aside, last = len(runs) - most, big.value.probe(as_long(runs))
                runs, n = runs[~last & some.value.probe(as_long(runs))], int(last.sum())
                held.append((runs, node, root, max(0, aside - n), n > aside))
                size += len(runs)
                if size >= 1 << 16:
                    yield batched(held)
                    held, size = [], 0
            if held:
                yield batched(held)

    return go


def _held(similarity: float):
    """The similar pairs of two blocks of nodes (of one, if they are the same)."""

    def counts(words: list[np.ndarray]) -> np.ndarray:
        return np.array([np.bincount(mix(w.astype(U64)) % U64(COUNTS), minlength=COUNTS) for w in words], dtype=np.int32).reshape(-1, COUNTS)

    def go(group: pd.DataFrame) -> pd.DataFrame:
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        first, second = (group[group["block"] == x].reset_index(drop=True) for x in (i, j))
        x, y = ([np.frombuffer(w, dtype=np.uint32) for w in side["words"]] for side in (first, second))
        cx, cy, nx, ny = counts(x), counts(y), np.array([len(w) for w in x], np.int64), np.array([len(w) for w in y], np.int64)
        found = []
        for k in range(len(x)):
            longer = np.maximum(nx[k], ny)
            edits = np.floor((1 - similarity) * longer + 1e-9)
            may = (second["root"].to_numpy() != first["root"][k]) & (longer - np.minimum(nx[k], ny) <= edits)
            if i == j:
                may[: k + 1] = False
            at = np.flatnonzero(may)
            # an edit changes two counts by one
            at = at[np.abs(cy[at] - cx[k]).sum(axis=1) <= 2 * edits[at]]
            found += [(first["node"][k], second["node"][m]) for m in at if similar(x[k], y[m], similarity)]
        return pd.DataFrame({"a": [min(p) for p in found], "b": [max(p) for p in found]}, dtype="int64")

    return go


def _block_pairs(rows: DataFrame, similarity: float, in_block: int = IN_BLOCK) -> DataFrame:
    """The similar pairs (a, b) of all rows (node, root, words) of different roots; blocks against blocks, a task holds two of them."""
    n = -(-rows.count() // in_block)
    placed = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(n)).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    placed = placed.select("node", "root", "words", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return placed.groupBy("i", "j").applyInPandas(_held(similarity), "a long, b long")


def _across(rows: DataFrame, lengths: DataFrame, similarity: float, hot: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Of nodes (node, root, words): pairs (a, b) to align, and pairs that are similar.  No similar pair of different roots is in neither."""
    found, sc = [], rows.sparkSession.sparkContext
    for q in RUNS:
        short = not_by_runs(q, similarity)
        if short is None:
            continue
        texts = rows.select("node", "root", "words")
        # runs of one component only come first in the order of rarity: they link nothing, so they are neither counted, but for some that the map lets pass, nor met again
        bits = owned_bits(texts.agg(F.sum(F.length("words"))).first()[0] // 4)
        owned = sc.broadcast(Owned(texts.mapInArrow(_marked(q, similarity, bits), MARKS), bits))
        spread = texts.mapInArrow(_counted(q, similarity, owned=owned), "key long, n long, lo long, hi long").groupBy("key").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        spread = stored(spread.where("lo < hi").select("key", "n"), "spread")
        # those of a crowd come last: their texts go on if they have too many of them
        some, big = (sc.broadcast(Bloom(spread.where(which), "key")) for which in (F.col("n") <= CROWD * hot, F.col("n") > CROWD * hot))
        runs = stored(texts.mapInArrow(_runs(q, similarity, some, big), "key long, node long, root long, aside int"), "runs")
        from_last = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("n"), F.desc("key")))
        rare = runs.join(spread.where(F.col("n") <= CROWD * hot).hint("merge"), "key").withColumn("from_last", from_last).where("from_last > aside").select("key", "node", "root")
        rare = stored(rare, "rare")
        sizes = stored(rare.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key", "size"), "sizes")
        found.append(_pairs(rare.join(sizes.where(F.col("size") <= hot), "key", "left_semi"), lengths, similarity))
        more = rare.join(sizes.where(F.col("size") > hot), "key", "left_semi").select("node").union(runs.where("key is null").select("node"))
        more = more.union(rows.where(F.length("words") <= 4 * short).select("node")).distinct()
        rows = stored(rows.join(more, "node", "left_semi"), "rest")
        if rows.isEmpty():
            break
    held = None if rows.isEmpty() else _block_pairs(rows, similarity)
    return reduce(DataFrame.union, found).distinct(), held


def classes(docs: DataFrame, similarity: float = SIMILARITY, orders: int = ORDERS, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """(doc_id, class_id): one row per row of ``docs``; class_id is the least doc_id of its near duplicates."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.lower(F.col("text").cast("string")).alias("text"))
    made = stored(texts.mapInArrow(_sketches(orders, least), "doc_id long, d1 long, d2 long, n int, keys array<long>"), "sketches")
    known = made.where("doc_id is not null")
    known_texts = texts.where("node is not null")
    nodes = stored(known.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"), F.first("n").alias("n")), "nodes")
    # an id of several texts is aligned by one of them
    chosen = nodes.groupBy("node").agg(F.min(F.struct("d1", "d2", "n", "keys")).alias("text")).select("node", "text.*")
    lengths = chosen.select("node", "n")
    samples = nodes.select("node", F.explode("keys").alias("key"))
    hubs = stored(samples.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("most"), F.count("*").alias("size")).where("hub < most").drop("most"), "hubs")
    repeated = nodes.select("node", "keys").mapInArrow(_repeated(sc.broadcast(Bloom(hubs, "key"))), "node long, key long")
    members = stored(repeated.join(hubs, "key"), "members")
    stars = stored(members.where("node > hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = stored(_verified(stars, known_texts, chosen, similarity), "verified")
    root = stored(components(links), "roots")
    # what the stars left apart; the hub was held against all
    placed = members.where("node > hub").join(root, "node", "left").select("key", "size", "node", F.coalesce("root", "node").alias("root"))
    placed = stored(placed, "placed")
    split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    apart = stored(placed.join(split, "key", "left_semi"), "apart")
    across = _pairs(apart.where(F.col("size") <= hot).drop("size"), lengths, similarity)
    crowded, held = stored(apart.where(F.col("size") > hot).select("node", "root").distinct(), "crowded"), None
    if not crowded.isEmpty():
        rows = stored(crowded.join(_words(crowded.select("node"), known_texts, chosen).hint("merge"), "node"), "crowded")
        pairs, held = _across(rows, lengths, similarity, hot)
        across = across.union(pairs).distinct()
    across = stored(across, "across")
    if held is not None or not across.isEmpty():
        more = links if across.isEmpty() else links.union(_verified(across, known_texts, chosen, similarity))
        root = stored(components(stored(more if held is None else more.union(held), "verified")), "roots")
    of_node = nodes.select("d1", "d2", "node").join(root, "node", "left").select("d1", "d2", F.coalesce("root", "node").alias("class_id"))
    found = known.select("doc_id", "d1", "d2").join(stored(of_node, "class"), ["d1", "d2"]).select("doc_id", "class_id")
    return found.union(made.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id")))
