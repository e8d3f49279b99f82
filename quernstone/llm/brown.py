"""Language-model scores from a Brown class bigram: P(word) = P(class | class before) * P(word | class).

Words are runs of other than space and \\t-\\r, A-Z lower-cased; every text ends with an end token.

- Counts of all words of all training texts are made by Spark (map-side first) and written.
- Exchange clustering, distributed: each round, every task counts for its texts which classes stand
  before and after each word; the sums say, for half of the words by turns, which class gives the class
  bigrams the most mutual information.  If it falls, the moves are taken back and fewer words (down to one
  in 16) have their turn at once; rounds end when every word had its turn and little was added, after 24
  at most.  The words exchanged so are those of at least 1e-5 of all training tokens (at most 100,000), as
  their assignment and the class matrix pass through the driver.
- Every other word that stands in the training texts at least twice, at any size of the table, then gets
  the class that adds most by the same measure: the classes before and after its tokens are rows keyed by
  the word, shuffled and summed by word, and its class stays a row.  This is done once, with the classes
  that the rounds left; neighbours that are such words themselves count by shape here.
- Words seen once or never have the class of their shape (length, ending, digits).
- Counts and classes of words of at least 1e-6 of all tokens (at most 1,000,000) are looked up where the text is;
  rarer ones by a join on the word, which can't be skewed, as none has more than 1e-6 of the tokens.
  What that join gives is put into the texts' classes, from which the class bigrams are counted anew.

Smoothing: a class follows a class with (n + b * P(class)) / (total + b); a word stands in its class with
(n + a) / (total + a * (distinct + 1)), the 1 being for all words never seen in it.

Words are known by a 64-bit hash, of which three bits are the shape.  Rounds read the encoded texts,
written once, instead of the texts.

Defined results: null text counts as empty and has one token, its end; a null doc_id isn't held out;
without training texts all counts are 0 and all known words none; every row gives one row; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .wordhash import LOWER, NOT_SPACE, U64, Words, as_long, binaries, text_runs

CLASSES = 32
#: At most; rounds end before if they add little.
ROUNDS = 24
PAYS = 1e-3
MOST_TURNS = 16
FREQUENT = 1e-6
CLUSTERED = 1e-5
#: Training tokens from which a word has a class of its own choice and not of its shape.
LEAST = 2
SHAPES = 8
#: The end of a text among the numbers of its words: before those of the shapes, -SHAPES to -1.
END = -1 - SHAPES
BLOCK = 512
WORD_PRIOR = 0.3
CLASS_PRIOR = 2.0


def word_keys(data: np.ndarray, w: Words) -> np.ndarray:
    """Hash of each word with its shape in the last three bits."""
    h = w.hashes()
    if not len(h):
        return as_long(h)
    first, last = data[w.starts], data[w.ends - 1]
    digit = lambda b: (b >= 48) & (b <= 57)
    mark = (last < 128) & ~((last >= 97) & (last <= 122)) & ~digit(last)
    shape = (w.ends - w.starts > 8).astype(U64) | mark.astype(U64) << U64(1) | (digit(first) | digit(last)).astype(U64) << U64(2)
    return as_long((h & ~U64(7)) | shape)


def _keys_of_run(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    w = Words(data, offsets, NOT_SPACE)
    return word_keys(data, w), w.ptr


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(_keys_of_run(data, offsets)[0], return_counts=True) for _, _, data, offsets in text_runs(batch.column(0))]
        if not found:
            continue
        keys, counts = (np.concatenate(c) for c in zip(*found, strict=True))
        merged, where = np.unique(keys, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(merged), pa.array(np.bincount(where, counts, len(merged)).astype(np.int64))], ["key", "n"])


@dataclass
class Frequent:
    """Words looked up without a join: keys in order, counts, and their number among the clustered words (-1: none)."""

    keys: np.ndarray
    counts: np.ndarray
    clustered: np.ndarray

    @property
    def n_clustered(self) -> int:
        return int((self.clustered >= 0).sum())

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, -1)


def _encode(frequent):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = frequent.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for lo, hi, data, offsets in text_runs(batch.column(2)):
                keys, ptr = _keys_of_run(data, offsets)
                at = f.find(keys)
                rare = at < 0
                ids = np.insert(np.where(rare, -1 - (keys & 7), at).astype(np.int32), ptr[1:], END)
                rare_ptr = np.concatenate([[0], np.cumsum(rare)])[ptr]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(hi - lo)), batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), binaries(ids, ptr + np.arange(len(ptr))), binaries(keys[rare], rare_ptr)],
                    ["row", "doc_id", "held_out", "ids", "rare"],
                )
                row += hi - lo

    return go


_ENCODED = "row long, doc_id long, held_out boolean, ids binary, rare binary"


class ClassMap:
    """Class of each frequent word, of each shape and of the end token."""

    def __init__(self, frequent: Frequent, assigned: np.ndarray, classes: int):
        self.classes = classes
        self.size = classes + SHAPES + 1
        self.end = self.size - 1
        shape = classes + (frequent.keys & 7)
        own = frequent.clustered >= 0
        table = shape.astype(np.int64)
        table[own] = assigned[frequent.clustered[own]]
        #: Indexed by id less END, so that the end and a rare word's -1 - shape are in range, too.
        self.table = np.concatenate([[self.end], classes + np.arange(SHAPES)[::-1], table])

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.table[ids - END]


def _class_runs(column: pa.Array, classes: ClassMap) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a column of texts in a row (with their ends), their classes, and the number of tokens of each text."""
    ids, n = _flat(column, np.int32)
    return ids, classes.of(ids), n


def _before(of: np.ndarray, end: int) -> np.ndarray:
    """Class before each token; a text begins after an end."""
    out = np.empty_like(of)
    if len(of):
        out[0], out[1:] = end, of[:-1]
    return out


def _contexts(frequent, classes: ClassMap, moving: np.ndarray):
    """Each task's sums: the class matrix (block -1) and, for each block of the words that may move, classes before and after."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, k, n = frequent.value, classes.size, len(moving)
        matrix = np.zeros(k * k, dtype=np.int64)
        sides = np.zeros((2, n * k), dtype=np.int64)
        place = np.full(f.n_clustered + 1, -1)
        place[moving] = np.arange(n)
        number = np.append(np.full(-END, -1), place[f.clustered])
        for batch in batches:
            ids, of, _ = _class_runs(batch.column(0), classes)
            if not len(ids):
                continue
            before = _before(of, classes.end)
            matrix += np.bincount(before * k + of, minlength=k * k)
            if not n:
                continue
            word = number[ids - END]
            own = np.flatnonzero(word >= 0)  # never the last: a text's last token is its end
            at = word[own] * k
            sides[0] += np.bincount(at + before[own], minlength=n * k)
            sides[1] += np.bincount(at + of[own + 1], minlength=n * k)
        blocks = [(-1, matrix)]
        for a in range(0, n, BLOCK):
            blocks.append((a // BLOCK, sides[:, a * k : min(n, a + BLOCK) * k].reshape(-1)))
        part = TaskContext.get().partitionId() % 64
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array([x.tobytes() for _, x in blocks], pa.binary())], ["block", "part", "sums"])

    return go


def _added(table: pa.Table) -> pa.Table:
    total = None
    for x in table["sums"]:
        v = np.frombuffer(x.as_py(), dtype=np.int64)
        total = v if total is None else total + v
    return pa.table({"block": table["block"].slice(0, 1), "part": table["part"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


_SUMS = "block int, part int, sums binary"


def _summed(sums: DataFrame) -> DataFrame:
    return sums.groupBy("block", "part").applyInArrow(_added, _SUMS).groupBy("block").applyInArrow(_added, _SUMS)


def _sums(encoded: DataFrame, frequent, classes: ClassMap, moving: np.ndarray) -> DataFrame:
    return _summed(encoded.where(~F.col("held_out")).select("ids").mapInArrow(_contexts(frequent, classes, moving), _SUMS))


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def best_class(now: int, before: np.ndarray, after: np.ndarray, matrix: np.ndarray, classes: int) -> int:
    """The class in which a word adds most to the mutual information of neighbouring classes."""
    m = matrix.astype(np.float64)
    m[:, now] = np.maximum(m[:, now] - before, 0.0)
    m[now, :] = np.maximum(m[now, :] - after, 0.0)
    into, out_of = m[:, :classes], m[:classes, :].T
    gain = (_phi(into + before[:, None]) - _phi(into)).sum(0) + (_phi(out_of + after[:, None]) - _phi(out_of)).sum(0)
    column, row = m.sum(0)[:classes], m.sum(1)[:classes]
    gain -= _phi(column + before.sum()) - _phi(column) + _phi(row + after.sum()) - _phi(row)
    best = int(gain.argmax())
    return best if gain[best] > gain[now] + 1e-9 else now


def _moves(assigned: np.ndarray, matrix: np.ndarray, classes: ClassMap, moving: np.ndarray):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = classes.size
        for batch in batches:
            out = []
            for block, sums in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                sides = np.frombuffer(sums.as_py(), dtype=np.int64).reshape(2, -1, k).astype(np.float64)
                for i in range(sides.shape[1]):
                    w = int(moving[block * BLOCK + i])
                    out.append((w, best_class(int(assigned[w]), sides[0, i], sides[1, i], matrix, classes.classes)))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int32()) for c in (0, 1)], ["word", "class"])

    return go


def mutual_information(matrix: np.ndarray) -> float:
    """Of neighbouring classes, in nats."""
    m = matrix.astype(np.float64)
    n = max(m.sum(), 1.0)
    return float((_phi(m).sum() - _phi(m.sum(0)).sum() - _phi(m.sum(1)).sum() + _phi(n)) / n)


def cluster(encoded: DataFrame, frequent, n_words: int, by_count: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[ClassMap, np.ndarray]:
    """Exchange clustering; returns the class map and the class matrix under it."""
    f = frequent.value
    assigned = np.zeros(n_words, dtype=np.int64)
    assigned[by_count] = np.arange(n_words) % classes
    best, kept, share, idle = -1.0, assigned, 2, 0
    for turn in range(rounds if n_words > classes else 0):
        now = ClassMap(f, assigned, classes)
        moving = np.flatnonzero((np.arange(n_words) + turn) % share == 0)
        sums = stored(_sums(encoded, frequent, now, moving), "contexts")
        matrix = _matrix(sums, now.size)
        reached = mutual_information(matrix)
        if reached < best - 1e-12:  # words that moved at once spoiled each other's gain
            assigned, share, idle = kept, 2 * share, 0
            if share > MOST_TURNS:
                break
            continue
        idle = 0 if reached > best * (1 + PAYS) else idle + 1
        best, kept = max(best, reached), assigned
        if idle > share:
            break
        moves = sums.where("block >= 0").mapInArrow(_moves(assigned, matrix, now, moving), "word int, class int").toArrow()
        assigned = assigned.copy()
        assigned[moves["word"].to_numpy()] = moves["class"].to_numpy()
    assigned = kept
    last = ClassMap(f, assigned, classes)
    return last, _matrix(_sums(encoded, frequent, last, np.zeros(0, np.int64)), last.size)


def _matrix(sums: DataFrame, k: int) -> np.ndarray:
    rows = sums.where("block = -1").collect()
    return np.frombuffer(rows[0].sums, dtype=np.int64).reshape(k, k) if rows else np.zeros((k, k), dtype=np.int64)


def _narrow(most: int) -> type:
    return np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32


def _flat(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column one after the other, and how many each row has."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if len(column) and data is not None and data.size else np.zeros(0, np.uint8)
    return np.frombuffer(values.tobytes(), dtype=dtype), np.diff(at) // np.dtype(dtype).itemsize


def _outside(frequent, classes: ClassMap):
    """Each word that isn't clustered, with the classes before and after each of its tokens as one number."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, k = frequent.value, classes.size
        number = np.append(np.full(-END, -1), f.clustered)
        for batch in batches:
            ids, of, _ = _class_runs(batch.column(0), classes)
            real = np.flatnonzero(of != classes.end)
            own = real[number[ids[real] - END] < 0]
            if not len(own):
                continue
            keys = np.empty(len(own), dtype=np.int64)
            rare = ids[own] < 0
            keys[~rare], keys[rare] = f.keys[ids[own[~rare]]], _flat(batch.column(1), np.int64)[0]
            pairs = (_before(of, classes.end)[own] * k + of[own + 1]).astype(_narrow(k * k))
            order = np.argsort(keys, kind="stable")
            keys, pairs = keys[order], pairs[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys[first]), binaries(pairs, np.append(first, len(keys)))], ["key", "pairs"])

    return go


def best_classes(sides: np.ndarray, matrix: np.ndarray, classes: int) -> np.ndarray:
    """For words of no class yet: the class in which each adds most.  ``sides``: counts of classes before, then after."""
    m = matrix.astype(np.float64)
    table = np.concatenate([m[:, :classes], m[:classes, :].T])
    column, row = m.sum(0)[:classes], m.sum(1)[:classes]
    out = np.zeros(len(sides), dtype=np.int64)
    for a in range(0, len(sides), BLOCK):
        part = sides[a : a + BLOCK]
        word, at = np.nonzero(part)
        gain = _phi(table[at] + part[word, at][:, None]) - _phi(table[at])
        gain = np.add.reduceat(gain, np.flatnonzero(np.append(True, word[1:] != word[:-1])))
        n = part.sum(1)[:, None] / 2
        gain -= _phi(column + n) - _phi(column) + _phi(row + n) - _phi(row)
        out[a : a + BLOCK] = gain.argmax(1)
    return out


def _chosen(matrix: np.ndarray, classes: ClassMap):
    """Count and class of each word; the rows come in order of the words, whose sums are all that is held."""
    k = classes.size

    def rows(keys: np.ndarray, sides: np.ndarray) -> pa.RecordBatch:
        n = sides[:, :k].sum(1)
        of = classes.classes + (keys & (SHAPES - 1))
        often = n >= LEAST
        of[often] = best_classes(sides[often], matrix, classes.classes)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.array(of.astype(np.int32))], ["key", "n", "class"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = np.zeros(0, np.int64), np.zeros((0, 2 * k), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            pairs, lengths = _flat(batch.column(1), _narrow(k * k))
            keys, word = np.unique(np.append(last, batch.column(0).to_numpy()), return_inverse=True)
            word = np.repeat(word[len(last) :], lengths) * (2 * k)
            sides = (np.bincount(word + pairs // k, minlength=len(keys) * 2 * k) + np.bincount(word + k + pairs % k, minlength=len(keys) * 2 * k)).reshape(-1, 2 * k)
            sides[: len(left)] += left
            if len(keys) > 1:
                yield rows(keys[:-1], sides[:-1])
            last, left = keys[-1:], sides[-1:]
        if len(last):
            yield rows(last, left)

    return go


def outside_classes(encoded: DataFrame, frequent, classes: ClassMap, matrix: np.ndarray) -> DataFrame:
    """(key, n, class) of each word of the training texts that isn't clustered."""
    contexts = encoded.where(~F.col("held_out")).select("ids", "rare").mapInArrow(_outside(frequent, classes), "key long, pairs binary")
    return contexts.repartition("key").sortWithinPartitions("key").mapInArrow(_chosen(matrix, classes), "key long, n long, class int")


@dataclass
class ClassModel:
    """What a task needs to look words up: bounded by the clustered and frequent words."""

    classes: ClassMap
    word: np.ndarray  # log10 P(word | class) by id
    known: np.ndarray  # log10(n + 1) by id
    below: np.ndarray  # log10 of the denominator of P(word | class) by class
    end_count: int


def _local(model):
    """Sums over a text's frequent words and end, and the class of each token; a rare word has the number of classes
    and its shape instead, and its place among the text's distinct rare words in ``slots``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        k = m.classes.size
        for batch in batches:
            ids, of, n = _class_runs(batch.column(3), m.classes)
            if not len(n):
                continue
            real = of != m.classes.end
            rare = real & (ids < 0)
            own = real & ~rare
            at = ids[own]
            score, base, seen = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), dtype=np.int64)
            score[own], base[own], seen[own] = m.word[at], m.known[at], 1
            base[~real], seen[~real] = math.log10(m.end_count + 1), m.end_count > 0
            of[rare] += k - m.classes.classes
            ends = np.append(0, np.cumsum(n))
            slots = [np.unique(np.frombuffer(x.as_py(), dtype=np.int64), return_inverse=True)[1].astype(np.int32) for x in batch.column(4)]
            add = lambda x: pa.array(np.add.reduceat(x, ends[:-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(n), add(seen), add(base), add(score), binaries(of.astype(_narrow(k + SHAPES)), ends), pa.array([x.tobytes() for x in slots], pa.binary())],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "codes", "slots"],
            )

    return go


def _rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [np.unique(np.frombuffer(x.as_py(), dtype=np.int64)) for x in batch.column(1)]
        if parts:
            rows = np.repeat(batch.column(0).to_numpy(), [len(p) for p in parts])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(rows), pa.array(np.concatenate([np.arange(len(p), dtype=np.int32) for p in parts]))], ["key", "row", "slot"])


def _filled(below: np.ndarray, classes: int, k: int):
    """The sums of all words and the class of each token, with what the join gave for the rare ones."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, n = _flat(batch.column("codes"), _narrow(k + SHAPES))
            if not len(n):
                continue
            codes = codes.astype(np.int64)
            rare = np.flatnonzero(codes >= k)
            slots, n_slots = _flat(batch.column("slots"), np.int32)
            begins = np.cumsum(n_slots) - n_slots  # a text has at most as many distinct rare words as rare tokens
            count = np.zeros(len(slots), dtype=np.int64)
            of = np.full(len(slots), -1)
            words = batch.column("words")
            inner = words.flatten()
            sizes = np.array([len(x) if x.is_valid else 0 for x in words], dtype=np.int64)
            place = np.repeat(begins, sizes) + inner.field("slot").to_numpy()
            count[place], of[place] = inner.field("n").to_numpy(), inner.field("class").to_numpy()
            at = np.repeat(begins, n_slots) + slots
            count, of = count[at], of[at]
            of = np.where(of < 0, codes[rare] - k + classes, of)
            codes[rare] = of
            text = np.repeat(np.arange(len(n)), n_slots)
            add = lambda name, x: pa.array(batch.column(name).to_numpy() + np.bincount(text, x, len(n)))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"), batch.column("n_tokens"), pa.array(batch.column("n_known").to_numpy() + np.bincount(text, count > 0, len(n)).astype(np.int64)),
                    add("base", np.log10(count + 1.0)), add("score", np.log10(count + WORD_PRIOR) - below[of]), binaries(codes.astype(_narrow(k)), np.append(0, np.cumsum(n))),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "codes"],
            )

    return go


def _bigrams(k: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.zeros(k * k, dtype=np.int64)
        for batch in batches:
            of = _flat(batch.column(0), _narrow(k))[0].astype(np.int64)
            matrix += np.bincount(_before(of, k - 1) * k + of, minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([TaskContext.get().partitionId() % 64], pa.int32()), pa.array([matrix.tobytes()], pa.binary())], ["block", "part", "sums"])

    return go


def _followed(follow: np.ndarray, k: int):
    """Adds log10 P(class | class before) of each token to the score."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, n = _flat(batch.column(6), _narrow(k))
            if len(n):
                of = of.astype(np.int64)
                score = batch.column(5).to_numpy() + np.add.reduceat(follow[_before(of, k - 1) * k + of], np.cumsum(n) - n)
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"])

    return go


def held_out(doc_id: Column, folds: int = 7, held: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))


def scored(docs: DataFrame, folds: int = 7, held: int = 2, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities), one row per row."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long"), folds, held).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = stored(texts.where(~F.col("held_out")).select("text").mapInArrow(_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "counts")
    ends = texts.where(~F.col("held_out")).count()
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = total + ends, distinct + (ends > 0)  # the end token is one of them

    least, clustered_from = max(1, math.ceil(FREQUENT * total)), max(2, math.ceil(CLUSTERED * total))
    table = counts.where(F.col("n") >= least).toArrow()  # at most 1 / FREQUENT rows
    keys, n = table["key"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    own = np.flatnonzero(n >= clustered_from)
    number = np.full(len(keys), -1)
    number[own] = np.arange(len(own))
    frequent = Frequent(keys, n, number)
    shared = sc.broadcast(frequent)
    encoded = stored(texts.mapInArrow(_encode(shared), _ENCODED), "encoded")
    class_map, matrix = cluster(encoded, shared, len(own), np.lexsort((keys[own], -n[own])), classes, rounds)

    outside = stored(outside_classes(encoded, shared, class_map, matrix), "outside")
    between = outside.where(F.col("n") >= least).select("key", "class").toArrow()  # at most 1 / FREQUENT rows, too
    class_map.table[frequent.find(between["key"].to_numpy()) - END] = between["class"].to_numpy()
    k = class_map.size
    in_class, kinds = np.zeros(k), np.zeros(k)
    of = class_map.of(own)
    np.add.at(in_class, of, n[own])
    np.add.at(kinds, of, 1)
    for r in outside.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # a row for each class
        in_class[r["class"]] += r.n
        kinds[r["class"]] += r.v
    below = np.log10(in_class + WORD_PRIOR * (kinds + 1))
    model = ClassModel(class_map, np.log10(n + WORD_PRIOR) - below[class_map.table[-END:]], np.log10(n + 1.0), below, ends)
    sums = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    local = encoded.mapInArrow(_local(sc.broadcast(model)), f"row long, {sums}, codes binary, slots binary")
    rare = encoded.select("row", "rare").mapInArrow(_rare_words, "key long, row long, slot int")
    looked_up = rare.join(outside, "key").select("row", "slot", "n", "class")
    of_row = looked_up.repartition("row").groupBy("row").agg(F.collect_list(F.struct("slot", "n", "class")).alias("words"))
    filled = stored(local.join(of_row, "row", "left").mapInArrow(_filled(below, classes, k), f"{sums}, codes binary"), "filled")
    matrix = _matrix(_summed(filled.where(~F.col("held_out")).select("codes").mapInArrow(_bigrams(k), _SUMS)), k)
    alone = (matrix.sum(0) + 1.0) / (matrix.sum() + k)
    follow = np.log10((matrix + CLASS_PRIOR * alone[None, :]) / (matrix.sum(1)[:, None] + CLASS_PRIOR)).reshape(-1)
    return filled.mapInArrow(_followed(follow, k), sums).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))).alias("base_score"), "score",
    )
