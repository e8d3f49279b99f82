"""Rules that vote, periodic runs and spelling variants against plain Python, and their odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.llm import periodic, supervision, variants
from quernstone.llm.suffixtree import maximal_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", "  \n ", "a", "a b\nc\n\na b\n a b", "x" * 3000, "né É Ü!? \n", "| ## $a\n|", "the end.\r\nthe end.\r\n\x0b", " nbsp  line\n", "a b c d e f " * 400]
SCHEMA = "doc_id long, text string, n_words string, kept boolean"


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    count = lambda chars: sum(c in chars for c in text)
    odd = lambda w: any(c in "#*$%&|<>" for c in w) or not any(c.isascii() and c.isalpha() or ord(c) > 127 for c in w)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": count("#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated),
        "n_lines": len(lines), "n_ended_lines": sum(WORD.findall(x)[-1].encode()[-1:] in [bytes([c]) for c in b".!?:;\"')"] for x in lines),
        "n_upper": sum("A" <= c <= "Z" or "À" <= c <= "Þ" for c in text), "n_marks": count("!?"), "n_odd_words": sum(map(odd, words)),
    }


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab É.!|\n\té", max_size=60)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_counts_are_those_of_plain_python(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(range(len(texts)), pa.int64())], ["text", "doc_id"])
    got = [r for b in supervision._counted([batch]) for r in b.to_pylist()]
    assert [{k: r[k] for k in supervision.COUNTS} for r in got] == [plain_counts(t) for t in texts]


def test_counts_of_odd_texts(spark):
    rows = [(i, t, "clash", True) for i, t in enumerate(ODD)] + [(None, "a b", None, None), (1, "", "x", None), (1, "", "x", None)]
    got = supervision.counted(spark.createDataFrame(rows, SCHEMA)).drop("doc_id").collect()
    assert sorted(map(tuple, got)) == sorted(tuple(plain_counts(t).values()) for _, t, _, _ in rows)
    by_id = {r.doc_id: r for r in supervision.counted(spark.createDataFrame(rows[: len(ODD)], SCHEMA)).collect()}
    assert all({k: by_id[i][k] for k in supervision.COUNTS} == plain_counts(t) for i, t in enumerate(ODD))


def test_verdicts_of_odd_rows(spark):
    long = "The quick fox sees one more hill and the next valley. " * 1
    rows = [(i, long + f"It is day {i}.\nNothing else happened here on that day, which is fine.", "clash", True) for i in range(30)]
    rows += [(i, t, "clash", True) for i, t in enumerate(ODD, 100)] + [(None, None, None, None), (1, rows[1][1], "again", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = supervision.judged(docs, keep=("kept", "n_words")).collect()
    assert len(got) == len(rows) and all(0 <= r.probability <= 1 for r in got)
    assert {"other_kept", "other_n_words"} <= set(got[0].asDict())
    assert all(not r.kept and r.base_failed for r in got if r.doc_id is None)
    assert all(r.kept for r in got if r.doc_id is not None and r.doc_id < 30)
    assert len({(r.kept, r.probability) for r in got if r.doc_id == 1}) == 1
    assert supervision.judged(docs.limit(0)).collect() == []


def test_rounds_find_planted_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(40_000) < 0.8
    says_good = np.where(good[:, None], 0.99, [0.4, 0.5, 0.6, 0.3, 0.45])
    votes = np.where(rng.random(says_good.shape) < 0.1, 0, np.where(rng.random(says_good.shape) < says_good, 1, -1))
    patterns, where, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = supervision.maximised(patterns, n.astype(float))
    assert abs(model.good - 0.8) < 0.02
    assert np.allclose(model.right_bad, [0.6, 0.5, 0.4, 0.7, 0.55], atol=0.05)
    z = math.log(model.good / (1 - model.good)) + sum((patterns[:, i] == 1) * up + (patterns[:, i] == -1) * down for i, (up, down) in enumerate(model.weights()))
    assert ((z[where.ravel()] >= 0) == good).mean() > 0.95


def test_too_many_rules(spark):
    with pytest.raises(ValueError, match="at most"):
        supervision.fit(spark.range(0).select(*(F.lit(0).alias(c) for c in supervision.COUNTS)), supervision.RULES * 2)


# --- periodic runs


def plain_runs(s, least, times):
    found = set()
    for p in range(1, len(s) // times + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            size = j + p - i
            if j > i and size >= max(least, times * p) and not any((i, size, q) in found for q in range(1, p)):
                found.add((i, size, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@given(st.lists(st.integers(1, 3), min_size=1, max_size=60))
@settings(max_examples=400, deadline=None)
def test_runs_of_short_sequences(s):
    start, length, period = (x.tolist() for x in maximal_runs(s, 3))
    assert list(zip(start, length, period, strict=True)) == plain_runs(s, 2, 2)


def looped(rng):
    kinds, s = rng.choice([1, 2, 3, 8, 400]), []
    while rng.random() < 0.85:
        kind = rng.random()
        if kind < 0.5:
            s += ([f"w{rng.randint(1, kinds)}" for _ in range(rng.randint(1, 14))] * 20)[: rng.randint(1, 90)]
        elif kind < 0.8:
            s += [f"w{rng.randint(1, kinds)}" for _ in range(rng.randint(1, 60))]
        elif s:
            at = rng.randrange(len(s))
            s += s[at : at + rng.randint(10, 60)]
    return s


@pytest.mark.parametrize("least,times", [(24, 3), (8, 2), (9, 4)])
def test_runs_and_collapse_are_exact(spark, least, times):
    rng = random.Random(least)
    rows = [(i, rng.choice([" ", "\n  "]).join(looped(rng)), "clash", True) for i in range(250)]
    rows += [(1000 + i, t, "clash", True) for i, t in enumerate(ODD)] + [(None, rows[3][1], None, None), (3, rows[3][1], "again", None)]
    got = periodic.collapsed(spark.createDataFrame(rows, SCHEMA), keep=("n_words",), least=least, times=times).collect()
    want = []
    for i, t, other, _ in rows:
        words = WORD.findall(t or "")
        runs = plain_runs(words, least, times)
        gone = {k for a, n, p in runs for k in range(a + p, a + n)}
        want.append((i, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone), other))
    assert sum(len(w[2]) for w in want) > 100
    assert sorted((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept_text, r.other_n_words) for r in got if r.doc_id is not None) == sorted(w for w in want if w[0] is not None)
    assert [tuple(x) for x in next(r for r in got if r.doc_id is None).runs] == want[-2][2]


def test_runs_of_an_empty_table_and_bad_limits(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert periodic.collapsed(docs).collect() == []
    with pytest.raises(ValueError, match="two periods"):
        periodic.collapsed(docs, least=5, times=3)


def test_a_long_text_with_one_long_run(spark):
    words = [f"w{i}" for i in range(9000)]
    text = " ".join(words[:50] + words * 3 + ["end"])
    (row,) = periodic.collapsed(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(50, 27_000, 9000)] and row.kept_text == " ".join(words[:50] + words + ["end"])


def test_strongest_run_is_exact(spark):
    runs = spark.sql("SELECT array(struct(5L AS start, 30L AS length, 10L AS period), struct(9L AS start, 60L AS length, 20L AS period), struct(1L AS start, 29L AS length, 10L AS period)) AS runs")
    assert runs.select(periodic.strongest("runs").alias("x")).first().x.start == 5
    assert runs.limit(1).select(F.expr("filter(runs, r -> false)").alias("runs")).select(periodic.strongest("runs").alias("x")).first().x is None


# --- spelling variants


def plain_variants(words, times=5):
    at = {}
    for w in words:
        for i in range(len(w)):
            at.setdefault((len(w), i, w[:i] + w[i + 1 :]), []).append(w)
    near = {w: set() for w in words}
    for (size, _, rest), group in at.items():
        for w in group:
            near[w] |= {x for x in group if x != w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    rows = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= times * n else None
        rows[w] = (n, len(near[w]), form, words[form] if form else None)
    out = []
    for w, row in rows.items():
        root = w
        while rows[root][2] is not None:
            root = rows[root][2]
        out.append((w, *row, root))
    return sorted(out)


def some_words(rng, n):
    words = {}
    while len(words) < n:
        w = "".join(rng.choice("abeéñz") for _ in range(rng.randint(6, 11)))
        words[w] = 5 * rng.choice([1, 1, 2, 40, 900])
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abeéñz") + w[i:], w[:i] + rng.choice("abeéñz") + w[i + 1 :]])
            words.setdefault(v, 5 * rng.choice([1, 7, 30]))
    return words


@pytest.mark.parametrize("sample,cell", [(1 << 16, 4096), (300, 32), (40, 16)])
def test_near_words_are_exact_over_many_cells(spark, sample, cell):
    words = some_words(random.Random(cell), 1500) | {w * 40: 5 for w in ("ab", "ba")} | {"ab" * 40 + "b": 500, "q" * 300: 9, "q" * 301: 50}
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    near = {r.word: r for r in variants.near_words(table, sample, cell).collect()}
    for w, n, n_near, form, form_n, _ in plain_variants(words):
        assert (near[w].n_near if w in near else 0) == n_near, w
        if form:
            assert (near[w].best, near[w].best_n) == (form, form_n)


def test_forms_and_roots(spark):
    words = some_words(random.Random(8), 800) | {"chooooin": 5, "choooin": 25, "chooin": 125, "chooins": 700, "choins": 3500}
    got = variants.grouped(spark.createDataFrame(list(words.items()), "word string, n long")).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got)) == plain_variants(words)
    assert next(r.root for r in got if r.word == "chooooin") == "choins"


def test_vocabulary_and_odd_rows(spark):
    texts = ["Colour colour COLOUR, colour-colour 3colour", None, "", "Énorme énorme ×÷×÷×÷ " * 5, "short " * 9, "colourācolour" + " x" * 50]
    rows = [(i, t, "clash", True) for i, t in enumerate(texts)] + [(None, "colour colour", None, None)]
    got = {r.word: r.n for r in variants.vocabulary(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"colour": 10, "Énorme": 5, "énorme": 5, "×÷×÷×÷": 5}
    assert variants.grouped(variants.vocabulary(spark.createDataFrame([], SCHEMA))).collect() == []
