"""Quality rules by weak supervision: each rule votes good or bad or abstains, and the votes are weighed.

1. Statistics.  One pass over whole texts in Arrow batches counts words, lines and characters; nothing is shuffled.
   The narrow table of counts is written once.
2. Votes.  A rule is two conditions on whole-number counts, in SQL: where the first holds it votes good (1), else
   where the second holds bad (-1), else it abstains (0).
3. Accuracies.  Expectation-maximisation over the hidden quality: for each rule the share of its votes on good texts that
   say good and on bad texts that say bad, and the share of good texts.  Votes are taken to be independent given the quality, and
   whether a rule abstains says nothing.  Rows count only by their pattern of votes, so Spark sums the texts of each
   pattern, and the rounds run on at most 3 ** (number of rules) rows, whatever the table's size.
   Texts tend to be bad in one way only, so a rule calls most bad texts good; what makes it a rule is that it calls few good texts bad.
   That is what is known beforehand, so a rule is right on at least 98 % of its votes on good texts and 20 % of those on bad ones
   (``OF_GOOD``, ``OF_BAD``: bounds); a few votes that no text gave (``SEEN_GOOD``, ``SEEN_BAD``) hold for rules that hardly vote.
4. Verdict.  The posterior log odds of good are a sum of one weight for each vote, a Spark column; a text is
   kept whose probability is at least ``threshold``, and which doesn't fail the base test.

Base test: under 10 words, or over 20 % of the words in runs of five words that the text holds twice or more.
Runs of five words and lines are compared by 64-bit hashes within one text.

Defined results: a null text counts as empty and fails the base test; every row gives one row, repeated rows equal
ones; a null doc_id stays null; an empty table gives an empty result; other columns are carried only if named, as
other_<name> where a result has the name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rlz import grams
from .scratch import stored
from .wordhash import NOT_SPACE, U64, Words, mix, span_hashes, text_runs

WINDOW = 5
ROUNDS = 30
#: Right and wrong votes that no text gave: on good texts, on bad ones.
SEEN_GOOD, SEEN_BAD = (9.9, 0.1), (2.0, 8.0)
#: Bounds of the share of right votes.
OF_GOOD, OF_BAD = (0.98, 0.995), (0.2, 0.95)
THRESHOLD = 0.5
MOST_RULES = 9

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_upper", "n_marks", "n_odd_words")
BASE = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


@dataclass(frozen=True)
class Rule:
    """When a rule votes good and, if it doesn't, when it votes bad: conditions on the counts."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.when(F.expr(self.good), 1).when(F.expr(self.bad), -1).otherwise(0)


RULES = (
    Rule("length", "n_words >= 60", "n_words < 20"),
    Rule("word_size", "n_words > 0 AND word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("symbols", "100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("odd_words", "100 * n_odd_words <= n_words", "10 * n_odd_words > n_words"),
    Rule("dup_lines", "n_lines >= 3 AND n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeats", "n_words >= 20 AND 100 * n_repeat_words <= n_words", "10 * n_repeat_words > n_words"),
    Rule("upper", "n_words > 0 AND 10 * n_upper <= word_chars", "10 * n_upper > 3 * word_chars"),
    Rule("line_ends", "n_lines > 0 AND 2 * n_ended_lines >= n_lines", "10 * n_ended_lines < n_lines"),
    Rule("marks", "n_words > 0 AND 20 * n_marks <= n_words", "10 * n_marks > n_words"),
)

_set = lambda chars: np.isin(np.arange(256), list(chars))
_SYMBOL, _MARK, _END = _set(b"#*$%&|<>"), _set(b"!?"), _set(b".!?:;\"')")
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
_UPPER = _set(range(65, 91))
_LETTER = _UPPER | _set(range(97, 123)) | _set(range(128, 256))


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: the key stands elsewhere too; it stands earlier."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    both, later = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    later[order[1:][same]] = True
    both[order[1:][same]] = both[order[:-1][same]] = True
    return both, later


def counts_of_run(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> dict[str, np.ndarray]:
    """The counts of each text of a run."""
    n = len(offsets) - 1
    w = Words(data, offsets, NOT_SPACE)
    text_of = lambda places: np.searchsorted(offsets, places, side="right") - 1
    salt = mix(np.arange(n, dtype=U64) + U64(1))
    out = {"n_words": np.diff(w.ptr), "n_symbols": _sums(_SYMBOL[data], offsets), "n_marks": _sums(_MARK[data], offsets)}
    out["word_chars"] = _sums(NOT_SPACE[data] & ~_CONTINUES[data], offsets)
    upper = _UPPER[data]
    if len(data) > 1:  # the two-byte letters from U+00C0 to U+00DE
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    out["n_upper"] = _sums(upper, offsets)
    total = np.append(0, np.cumsum(_SYMBOL[data])), np.append(0, np.cumsum(_LETTER[data]))
    symbols, letters = (t[w.ends] - t[w.starts] for t in total)
    out["n_odd_words"] = _sums((symbols > 0) | (letters == 0), w.ptr)
    # lines with a word: spans between line ends, within one text
    feeds = np.flatnonzero(data == 10)
    starts = np.union1d(offsets[:-1], feeds + 1).astype(np.int64)
    starts = starts[starts < len(data)]
    text = text_of(starts)
    ends = np.minimum(np.append(feeds, len(data))[np.searchsorted(feeds, starts)], offsets[text + 1])
    last = np.searchsorted(w.starts, ends)
    has = last > np.searchsorted(w.starts, starts)
    starts, ends, last, text = starts[has], ends[has], last[has], text[has]
    lines = np.bincount(text, minlength=n)
    ended = _END[data[w.ends[last - 1] - 1]]
    _, later = _repeated(span_hashes(data, starts, ends) ^ salt[text])
    out |= {"n_lines": lines, "n_ended_lines": np.bincount(text[ended], minlength=n), "n_dup_lines": np.bincount(text[later], minlength=n)}
    # words in windows that the text holds twice or more
    words = len(w.starts)
    covered = np.zeros(words + 1, dtype=np.int32)
    at = np.arange(max(0, words - window + 1))
    text = np.searchsorted(w.ptr, at, side="right") - 1
    inside = at + window <= w.ptr[text + 1]
    at, text = at[inside], text[inside]
    both, _ = _repeated(grams(w.hashes(), window)[at] ^ salt[text]) if len(at) else (np.zeros(0, dtype=bool), None)
    np.add.at(covered, at[both], 1)
    np.add.at(covered, at[both] + window, -1)
    out["n_repeat_words"] = _sums(np.cumsum(covered[:-1]) > 0, w.ptr)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        others = list(range(1, batch.num_columns))
        for lo, hi, data, offsets in text_runs(batch.column(0)):
            made = counts_of_run(data, offsets)
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in others), *(pa.array(made[c].astype(np.int64)) for c in COUNTS)], [*(batch.schema.names[i] for i in others), *COUNTS])


def counted(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and the counts of every row; columns to keep as other_<name>."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).alias(f"other_{c}") for c in keep))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), *(f"{c} long" for c in COUNTS)])
    return rows.mapInArrow(_counted, schema)


@dataclass(frozen=True)
class Model:
    """Share of good texts; for each rule how often it says good of good texts and bad of bad ones."""

    good: float
    right_good: tuple[float, ...]
    right_bad: tuple[float, ...]

    def weights(self) -> list[tuple[float, float]]:
        """What a vote for good and one for bad add to the log odds."""
        return [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in zip(self.right_good, self.right_bad, strict=True)]

    def log_odds(self, votes: list[Column]) -> Column:
        z = F.lit(math.log(self.good / (1 - self.good)))
        for vote, (up, down) in zip(votes, self.weights(), strict=True):
            z = z + F.when(vote == 1, F.lit(up)).when(vote == -1, F.lit(down)).otherwise(F.lit(0.0))
        return z


def maximised(votes: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Rounds of expectation-maximisation over patterns of votes and their numbers of texts."""
    rules = votes.shape[1]
    share = lambda right, wrong, seen, of: np.clip((right + seen[0]) / (right + wrong + sum(seen)), *of)
    none, up, down = np.zeros(rules), votes == 1, votes == -1
    good, right_good, right_bad = 0.5, share(none, none, SEEN_GOOD, OF_GOOD), share(none, none, SEEN_BAD, OF_BAD)
    for _ in range(rounds if n.sum() else 0):
        z = math.log(good / (1 - good)) + up @ np.log(right_good / (1 - right_bad)) + down @ np.log((1 - right_good) / right_bad)
        q = n / (1 + np.exp(-z))
        good = (q.sum() + 1) / (n.sum() + 2)
        right_good, right_bad = share(q @ up, q @ down, SEEN_GOOD, OF_GOOD), share((n - q) @ down, (n - q) @ up, SEEN_BAD, OF_BAD)
    return Model(float(good), tuple(map(float, right_good)), tuple(map(float, right_bad)))


def _votes(rules: tuple[Rule, ...]) -> list[Column]:
    return [r.vote().alias(f"vote_{i}") for i, r in enumerate(rules)]


def fit(counts: DataFrame, rules: tuple[Rule, ...] = RULES) -> Model:
    """Learn from the votes on every row."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules: the patterns of their votes are kept on the driver")
    names = [f"vote_{i}" for i in range(len(rules))]
    patterns = counts.select(*_votes(rules)).groupBy(*names).count().collect()
    rows = np.array(sorted(tuple(r) for r in patterns), dtype=np.int64).reshape(-1, len(rules) + 1)
    return maximised(rows[:, :-1], rows[:, -1].astype(float))


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the counts, base_failed, the probability of being good and kept, and the columns to keep; one row per row."""
    counts = stored(counted(docs, keep), "counts")
    model = fit(counts, rules)
    odds = model.log_odds([r.vote() for r in rules])
    out = counts.withColumns({"base_failed": F.expr(BASE), "probability": 1 / (1 + F.exp(-odds))})
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold))
    return out.withColumnsRenamed({f"other_{c}": c for c in keep if c not in out.columns})
