"""Spelling variants: words of a vocabulary that one inserted, deleted or replaced letter makes of each other.

1. Vocabulary.  Runs of letters are counted by Spark, map-side first; words of ``least_chars`` letters and ``least_n`` occurrences stay.
2. Letter counts.  A word's vector counts its letters (a to z, the others in 14 groups; counts beyond 255 as 255).  One edit takes
   one letter away, adds one, or does both, so vectors of near words have an L1 distance of at most two, and none
   lies more than one above or one below the other's box.
3. Cells.  A k-d tree over the vectors of each length, fitted on a sample of at most ``SAMPLE`` words in expectation, deals out
   all words to cells of about ``CELL`` words; cells with more are dealt in blocks by hash.  A word goes as a member to its own
   block and as a query to each other block whose cell's box a near word may lie in: those of its own length that come after its
   own, and those of the next length.
4. Search.  Each block's members stand in a k-d tree with the tight box of each leaf; queries stream past it, branches and leaves out of
   reach are pruned, and the letters decide: words of one length differ in one place, others agree before and after the
   letter added.  So each pair is met once, and counted for both words; rows that leave are sums for a word, not pairs.
5. Forms.  A word's form is its near word with the most occurrences if those are ``times`` as many as its own or more; roots follow
   forms by pointer jumping, which takes the logarithm of the longest chain, as occurrences grow along it.

Memory: one block's members and one batch of queries; the trees of at most ``CELLS`` cells and the numbers of those over
``CELL`` words pass through the driver.

Defined results: null text has no words; a null doc_id changes nothing about its words; repeated rows count again;
an empty table gives an empty vocabulary; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

LETTERS = r"[A-Za-zÀ-ÿ]+"
DIMS = 40
SAMPLE = 1 << 16
CELL = 4096
CELLS = 4096
LEAF = 32
MOST_PAIRS = 1 << 20
#: Cells of lengths that no word of the sample has are numbered from here on.
_ALONE = 1 << 40

_dim = np.zeros(256, dtype=np.int64)
_dim[97:123] = np.arange(26)
_dim[192:] = 26 + np.arange(64) % 14
_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def vocabulary(docs: DataFrame, least_chars: int = 6, least_n: int = 5, change: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lower-cased; ``change`` makes a shorter or equal word of (doc_id, word) first."""
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(LETTERS), F.lit(0))
    rows = docs.select("doc_id", F.explode(runs).alias("run")).where(F.length("run") >= least_chars)
    word = F.translate("run", _A_TO_Z, _A_TO_Z.lower())
    rows = rows.select("doc_id", word.alias("run"))
    rows = rows.select((F.col("run") if change is None else change(F.col("doc_id"), F.col("run"))).alias("word"))
    return rows.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def matrix(words: list[bytes], size: int) -> np.ndarray:
    """Letters of words of one length, a row each."""
    return np.frombuffer(b"".join(words), dtype=np.uint8).reshape(len(words), size)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    out = np.zeros((len(letters), DIMS), dtype=np.int32)
    at = np.arange(len(letters))
    for j in range(letters.shape[1]):
        out[at, _dim[letters[:, j]]] += 1
    return np.minimum(out, 255).astype(np.int16)


class Tree:
    """A k-d tree: each inner node sends vectors up to ``cut`` in ``dim`` to the left, others to the right."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.dim, self.cut, self.left, self.right, self.lo, self.hi, self.leaf = [], [], [], [], [], [], []
        self.members: list[np.ndarray] = []
        todo = [(np.arange(len(x)), np.zeros(x.shape[1], int), np.full(x.shape[1], 255), None, 0)]
        while todo:
            rows, lo, hi, parent, side = todo.pop()
            me = len(self.dim)
            if parent is not None:
                (self.right if side else self.left)[parent] = me
            d, cut = self._split(x[rows]) if len(rows) > leaf else (-1, 0)
            for to, value in zip((self.dim, self.cut, self.left, self.right, self.lo, self.hi, self.leaf), (d, cut, -1, -1, lo[d], hi[d], -1), strict=True):
                to.append(value)
            if d < 0:
                self.leaf[me] = len(self.members)
                self.members.append(rows)
                continue
            below = x[rows, d] <= cut
            top, bottom = hi.copy(), lo.copy()
            top[d], bottom[d] = cut, cut + 1
            todo += [(rows[below], lo, top, me, 0), (rows[~below], bottom, hi, me, 1)]
        for name in ("dim", "cut", "left", "right", "lo", "hi", "leaf"):
            setattr(self, name, np.asarray(getattr(self, name), dtype=np.int64))

    @staticmethod
    def _split(x: np.ndarray) -> tuple[int, int]:
        """The dimension and cut that come closest to halves; (-1, 0) if all vectors are equal."""
        best, where = 0, (-1, 0)
        for cut in range(4):
            below = (x <= cut).sum(axis=0)
            even = np.minimum(below, len(x) - below)
            d = int(np.argmax(even))
            if even[d] > best:
                best, where = int(even[d]), (d, cut)
        if not best:
            spread = x.max(axis=0) - x.min(axis=0)
            d = int(np.argmax(spread))
            if spread[d]:
                where = (d, int((int(x[:, d].max()) + int(x[:, d].min())) // 2))
        return where

    def homes(self, v: np.ndarray) -> np.ndarray:
        """The leaf each vector belongs to."""
        node = np.zeros(len(v), dtype=np.int64)
        while True:
            at = np.flatnonzero(self.dim[node] >= 0)
            if not len(at):
                return self.leaf[node]
            n = node[at]
            node[at] = np.where(v[at, self.dim[n]] <= self.cut[n], self.left[n], self.right[n])

    def within(self, v: np.ndarray, most_up: int, most_down: int) -> tuple[np.ndarray, np.ndarray]:
        """(vector, leaf) of all leaves whose box has a point at most so far above and below the vector."""
        q, node = np.arange(len(v)), np.zeros(len(v), dtype=np.int64)
        up, down = np.zeros(len(v), dtype=np.int64), np.zeros(len(v), dtype=np.int64)
        found = []
        while len(q):
            done = self.dim[node] < 0
            found.append((q[done], self.leaf[node[done]]))
            q, node, up, down = q[~done], node[~done], up[~done], down[~done]
            x, cut = v[q, self.dim[node]].astype(np.int64), self.cut[node]
            lower = down - np.maximum(0, x - self.hi[node]) + np.maximum(0, x - cut)
            upper = up - np.maximum(0, self.lo[node] - x) + np.maximum(0, cut + 1 - x)
            a, b = lower <= most_down, upper <= most_up
            q, node, up, down = np.append(q[a], q[b]), np.append(self.left[node[a]], self.right[node[b]]), np.append(up[a], upper[b]), np.append(lower[a], down[b])
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (q, q)


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Do words of one length, letters packed eight to a number, differ in exactly one letter."""
    n = np.zeros(len(a), dtype=np.uint8)
    for lane in range(a.shape[1]):
        x = a[:, lane] ^ b[:, lane]
        x |= x >> np.uint64(4)
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        n += np.minimum(np.bitwise_count(x & np.uint64(0x0101010101010101)), 2)
        np.minimum(n, 2, out=n)
    return n == 1


def one_added(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Is the longer word the shorter one with one letter more."""
    size = short.shape[1]
    ahead = np.cumprod(short == long[:, :-1], axis=1, dtype=bool).sum(axis=1)
    behind = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1, dtype=bool).sum(axis=1)
    return ahead + behind >= size


def packed(letters: np.ndarray) -> np.ndarray:
    """Letters eight to a number."""
    lanes = -(-letters.shape[1] // 8)
    out = np.zeros((len(letters), lanes * 8), dtype=np.uint8)
    out[:, : letters.shape[1]] = letters
    return out.view(np.uint64)


class Block:
    """Members of one length in a k-d tree."""

    def __init__(self, words: list[bytes], n: np.ndarray):
        self.words, self.n, self.letters = words, n, matrix(words, len(words[0]))
        self.packed = packed(self.letters)
        self.counts = letter_counts(self.letters)
        self.tree = Tree(self.counts, LEAF)
        self.low = np.stack([self.counts[m].min(axis=0) for m in self.tree.members])
        self.high = np.stack([self.counts[m].max(axis=0) for m in self.tree.members])
        self.order = np.concatenate(self.tree.members)
        self.ptr = np.append(0, np.cumsum([len(m) for m in self.tree.members]))

    def near(self, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) of all near pairs, for queries of the members' length or one letter shorter."""
        same = letters.shape[1] == self.letters.shape[1]
        v, lanes = letter_counts(letters), packed(letters) if same else None
        most_down = 1 if same else 0
        q, leaf = self.tree.within(v, 1, most_down)
        for at in range(0, len(q), MOST_PAIRS // LEAF):
            some, to = q[at : at + MOST_PAIRS // LEAF], leaf[at : at + MOST_PAIRS // LEAF]
            x = v[some]
            reach = (np.maximum(self.low[to] - x, 0).sum(axis=1) <= 1) & (np.maximum(x - self.high[to], 0).sum(axis=1) <= most_down)
            some, to = some[reach], to[reach]
            size = self.ptr[to + 1] - self.ptr[to]
            # leaves of equal vectors may be large, so pairs are taken by their number
            for part in np.split(np.arange(len(some)), np.flatnonzero(np.diff(np.cumsum(size) // MOST_PAIRS)) + 1) if len(some) else ():
                for lo in range(0, int(size[part].max()), MOST_PAIRS):
                    k = np.minimum(np.maximum(size[part] - lo, 0), MOST_PAIRS)
                    pair = np.repeat(some[part], k)
                    member = self.order[np.repeat(self.ptr[to[part]] + lo - np.cumsum(k) + k, k) + np.arange(int(k.sum()))]
                    fits = one_replaced(lanes[pair], self.packed[member]) if same else one_added(letters[pair], self.letters[member])
                    yield pair[fits], member[fits]


_SUMS = "word string, n_near long, best_n long, best string"


def _sums(key: np.ndarray, words: list[bytes], other: np.ndarray, other_words: list[bytes], other_n: np.ndarray) -> pa.RecordBatch:
    """For each word of the pairs: how many, and the other with the most occurrences (the first of equals)."""
    width = max(len(other_words[0]), 1)
    text = np.array(other_words, dtype=f"S{width}")
    place = np.empty(len(text), dtype=np.int64)
    place[np.argsort(text, kind="stable")] = np.arange(len(text))
    order = np.lexsort((place[other], -other_n[other], key))
    key, other = key[order], other[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    say = lambda w, at: pa.array([w[i].decode("latin-1") for i in at.tolist()], pa.string())
    return pa.RecordBatch.from_arrays(
        [say(words, key[first]), pa.array(np.diff(np.append(first, len(key)))), pa.array(other_n[other[first]]), say(other_words, other[first])],
        ["word", "n_near", "best_n", "best"],
    )


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (cell, block, role): members (role 0), then queries, of each block: sums for all words with near ones."""
    at, words, n, block = None, [], [], None

    def ready() -> Iterator[pa.RecordBatch]:
        """Put up the tree and meet the members with each other."""
        nonlocal block
        block = Block(words, np.concatenate(n))
        pairs = list(block.near(block.letters))
        q, m = (np.concatenate(c) for c in zip(*pairs, strict=True)) if pairs else ([], [])
        if len(q):
            yield _sums(q, words, m, words, block.n)

    for batch in batches:
        if not batch.num_rows:
            continue
        cell, part, role, count = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
        text = [w.encode("latin-1") for w in batch.column(3).to_pylist()]
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(role) != 0)) + 1
        for lo, hi in zip(np.append(0, cuts).tolist(), np.append(cuts, len(cell)).tolist(), strict=True):
            if at != (cell[lo], part[lo]):
                if words and block is None:
                    yield from ready()
                at, words, n, block = (cell[lo], part[lo]), [], [], None
            if role[lo] == 0:
                words += text[lo:hi]
                n.append(count[lo:hi])
                continue
            if not words:  # a block that no word belongs to
                continue
            if block is None:
                yield from ready()
            asked, asked_n = text[lo:hi], count[lo:hi]
            for q, m in block.near(matrix(asked, len(asked[0]))):
                if len(q):
                    yield _sums(q, asked, m, words, block.n)
                    yield _sums(m, words, q, asked, asked_n)
    if words and block is None:
        yield from ready()


class Cells:
    """A tree for each word length over a sample, its leaves numbered as cells; lengths without one are a cell each."""

    def __init__(self, sample: list[bytes], leaf: int):
        self.trees: dict[int, Tree] = {}
        self.first: dict[int, int] = {}
        self.blocks: dict[int, int] = {}
        at = 0
        for size in sorted({len(w) for w in sample}):
            tree = Tree(letter_counts(matrix([w for w in sample if len(w) == size], size)), leaf)
            self.first[size], at = at, at + len(tree.members)
            tree.members = []
            self.trees[size] = tree

    def home(self, size: int, v: np.ndarray) -> np.ndarray:
        return self.first[size] + self.trees[size].homes(v) if size in self.trees else np.full(len(v), _ALONE + size)

    def reached(self, size: int, v: np.ndarray, most_up: int, most_down: int) -> tuple[np.ndarray, np.ndarray]:
        if size not in self.trees:
            return np.arange(len(v)), np.full(len(v), _ALONE + size)
        q, leaf = self.trees[size].within(v, most_up, most_down)
        return q, self.first[size] + leaf

    def dealt(self, homes_only: bool) -> Callable:
        """Rows of words to (cell, block, role, word, n)."""

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = np.array([w.encode("latin-1") for w in batch.column(0).to_pylist()], dtype=object)
                n = batch.column(1).to_numpy(zero_copy_only=False)
                sizes = np.array([len(w) for w in words], dtype=np.int64)
                for size in np.unique(sizes).tolist():
                    some = np.flatnonzero(sizes == size)
                    v = letter_counts(matrix(words[some].tolist(), size))
                    home = self.home(size, v)
                    salt = np.array([zlib.crc32(w) for w in words[some]], dtype=np.int64)
                    own = salt % np.array([self.blocks.get(c, 1) for c in home.tolist()], dtype=np.int64)
                    rows = [(np.arange(len(some)), home, own, np.zeros(len(some), dtype=np.int64))]
                    for role, other, most_down in () if homes_only else ((1, size, 1), (2, size + 1, 0)):
                        q, cell = self.reached(other, v, 1, most_down)
                        k = np.array([self.blocks.get(c, 1) for c in cell.tolist()], dtype=np.int64)
                        q, cell, block = np.repeat(q, k), np.repeat(cell, k), np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
                        stay = (cell > home[q]) | ((cell == home[q]) & (block > own[q])) | (role == 2)
                        rows.append((q[stay], cell[stay], block[stay], np.full(int(stay.sum()), role)))
                    q, cell, block, role = (np.concatenate(c) for c in zip(*rows, strict=True))
                    q = some[q]
                    for lo in range(0, len(q), 50_000):
                        hi = lo + 50_000
                        say = [batch.column(0).take(pa.array(q[lo:hi])), batch.column(1).take(pa.array(q[lo:hi]))]
                        yield pa.RecordBatch.from_arrays([pa.array(cell[lo:hi]), pa.array(block[lo:hi].astype(np.int32)), pa.array(role[lo:hi].astype(np.int32)), *say], ["cell", "block", "role", "word", "n"])

        return go


_DEALT = "cell long, block int, role int, word string, n long"


def near_words(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """(word, n_near, best_n, best) of every word of a stored table (word, n) that has near ones."""
    total = words.count()
    share = min(1.0, sample / max(total, 1))
    chosen = words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))).select("word") if share < 1 else words.select("word")
    known = sorted(r.word.encode("latin-1") for r in chosen.collect())
    wanted = min(CELLS, max(1, total // cell))
    cells = Cells(known, max(1, len(known) // wanted))
    full = words.mapInArrow(cells.dealt(homes_only=True), _DEALT).groupBy("cell").count().where(F.col("count") > cell)
    cells.blocks = {r.cell: -(-r["count"] // cell) for r in full.collect()}
    rows = words.mapInArrow(cells.dealt(homes_only=False), _DEALT)
    placed = rows.repartition("cell", "block").sortWithinPartitions("cell", "block", "role", "word")
    found = placed.mapInArrow(_searched, _SUMS)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("first")).select(
        "word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.best").alias("best")
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a stored table (word, form): forms followed to the last by pointer jumping."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        rows = at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        rows = stored(rows, "roots")
        at = rows.select("word", "root")
        if rows.where("moved").isEmpty():
            return at


def grouped(words: DataFrame, times: int = 5) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word of a vocabulary (word, n)."""
    words = stored(words, "words")
    near = stored(near_words(words), "near")
    form = F.col("best_n") >= times * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n")
    )
    rows = stored(rows, "forms")
    return rows.join(roots(rows.where("form is not null").select("word", "form")), "word", "left").withColumn("root", F.coalesce("root", "word"))
