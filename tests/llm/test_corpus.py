"""Near duplicates, decontamination, top-k, scores, quality and the pipeline against plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.llm import brown, components, decontam, omh, pivot, rlz, rulefit

WORDS = [f"w{i}" for i in range(400)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance():
    r = random.Random(1)
    for _ in range(800):
        a = [r.randint(0, 3) for _ in range(r.randint(0, 25))]
        b = list(a) if r.random() < 0.5 else [r.randint(0, 3) for _ in range(r.randint(0, 25))]
        for _ in range(r.randint(0, 5)):
            b.insert(r.randint(0, len(b)), r.randint(0, 3))
        band, d = r.randint(0, max(len(a), len(b), 1)), edit_distance(a, b)
        assert omh.banded_distance(np.array(a, np.uint32), np.array(b, np.uint32), band) == (d if d <= band else None)


def test_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {x.node: x.root for x in components.components(spark.createDataFrame(links, "a long, b long").where("a <> b")).collect()}
    assert all(find(n) == r for n, r in got.items())
    assert set(got) == {n for n in root if find(n) != n}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    r = random.Random(3)
    text = lambda n: [r.choice(WORDS) for _ in range(n)]
    rows, want = [], []
    for g in range(6):
        base = text(120)
        ids = []
        for _ in range(5):
            copy = list(base)
            for _ in range(3):
                copy[r.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy)))
            ids.append(len(rows) - 1)
        rows.append((len(rows), "! " + "  ".join(base).upper()))
        want.append([*ids, len(rows) - 1])
    alone = len(rows)
    for _ in range(20):
        rows.append((len(rows), " ".join(text(80))))
    for _ in range(12):  # different texts with one much repeated phrase
        rows.append((len(rows), " ".join(text(40) + ["is", "onhe"] * 60)))
    half = text(200)
    rows += [(len(rows), " ".join(half)), (len(rows) + 1, " ".join(half[:100] + text(100)))]
    odd = len(rows)
    rows += [(odd, None), (odd + 1, ""), (odd + 2, "***"), (odd + 3, "two words"), (odd + 4, "Two words!"), (odd + 5, "two other"), (odd + 6, "x " * 9000), (odd + 6, "x " * 9000), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("keys", F.lit(1)).repartition(3)
    got = [(x.doc_id, x.class_id) for x in omh.classes(docs).collect()]
    assert len(got) == len(rows) and (None, None) in got
    of = dict(got)
    for ids in want:
        assert {of[i] for i in ids} == {ids[0]}
    assert all(of[i] == i for i in range(alone, odd))
    assert (of[odd], of[odd + 1], of[odd + 2], of[odd + 3], of[odd + 4], of[odd + 5]) == (odd, odd, odd + 2, odd + 3, odd + 3, odd + 5)
    assert omh.classes(docs.limit(0)).count() == 0


def test_one_shared_sample_is_enough(spark):
    r = random.Random(5)
    base = [r.choice(WORDS) for _ in range(100)]
    # one order gives one sample; whichever it is, a text of just these five words has a lower id and is the bucket's least
    texts = [*((i, base[i : i + 5]) for i in range(96)), (200, base), (201, [*base[:99], "changed"])]
    of = dict(omh.classes(spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string"), orders=1, least=1).collect())
    assert of[200] == of[201] == 200


def changed(r, words, share, in_block):
    """The words with that share of them replaced, spread evenly or in one stretch."""
    n = round(share * len(words))
    at = r.randrange(len(words) - n + 1)
    places = range(at, at + n) if in_block else r.sample(range(len(words)), n)
    out = list(words)
    for i in places:
        out[i] = f"new{r.randrange(10**9)}"
    return out


def test_near_duplicates_are_found(spark):
    """Recall against all pairs that are similar, at every share of changed words that the threshold allows."""
    r = random.Random(12)
    rows, pairs = [], {}
    for share in (0.05, 0.10, 0.15, 0.19):
        for in_block in (False, True):
            for _ in range(100):
                base = [f"w{r.randrange(20000)}" for _ in range(r.choice((60, 300)))]
                copy = changed(r, base, share, in_block)
                if omh.similar(*(np.array([zlib.crc32(w.encode()) for w in t], np.uint32) for t in (base, copy)), 0.8):
                    pairs.setdefault((share, in_block), []).append(len(rows))
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    of = dict(omh.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    found = {k: sum(of[i] == of[i + 1] for i in v) / len(v) for k, v in pairs.items()}
    assert all(len(v) > 20 for v in pairs.values()) and min(found.values()) >= 0.9, found
    assert sum(of[i] != i for i in of) == sum(of[i] == of[i + 1] for i in range(0, len(rows), 2))  # nothing else is joined


def test_links_are_those_of_all_pairs(spark):
    """Classes equal the components of all similar pairs, where a shared passage fills buckets with texts that are none."""
    r = random.Random(13)
    passage = [f"p{i}" for i in range(40)]
    texts = [passage + [f"w{r.randrange(10**6)}" for _ in range(40)] for _ in range(60)]
    texts += [changed(r, texts[i], 0.05, False) for i in range(20)] + [changed(r, texts[i], 0.1, True) for i in range(20)]
    r.shuffle(texts)
    codes = [np.array([zlib.crc32(w.encode()) for w in t], np.uint32) for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if omh.similar(codes[i], codes[j], 0.8):
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    of = dict(omh.classes(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect())
    assert [of[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("others", [0, 300])
def test_unlike_texts_of_a_shared_passage_undo_no_links(spark, others):
    """40 texts that are alike in a passage only, beside many that hold it and are not like them."""
    r = random.Random(14)
    passage = [f"p{i}" for i in range(250)]
    own = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    rows = [(i + 1, own(200) + passage + own(200)) for i in range(others)] + [(1000 + i, own(30) + passage + own(25)) for i in range(40)]
    rows += [(2000, rows[-1][1][:120] + own(3) + rows[-1][1][120:])]
    of = dict(omh.classes(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")).collect())
    assert {c for i, c in of.items() if i >= 1000} == {1000}
    assert all(of[i] == i for i in range(1, others + 1))


def test_classes_of_shared_ids_do_not_hang_on_partitions(spark):
    r = random.Random(15)
    a, b = ([f"w{r.randrange(10**6)}" for _ in range(90)] for _ in range(2))
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join(changed(r, a, 0.05, True))), (9, " ".join(changed(r, b, 0.05, True)))]
    found = {str(sorted(omh.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect())) for n in (1, 2, 3, 4)}
    found |= {str(sorted(omh.classes(spark.createDataFrame(rows[::-1], "doc_id long, text string").coalesce(n)).collect())) for n in (1, 3)}
    assert len(found) == 1


def test_decontamination(spark):
    r = random.Random(4)
    item = [r.choice(WORDS) for _ in range(30)]
    near = [w if i % 6 else "replaced" for i, w in enumerate(item)]
    far = [w if i % 3 else "replaced" for i, w in enumerate(item)]
    pad = lambda: [f"p{r.randrange(10**6)}" for _ in range(40)]
    texts = [pad() + item + pad(), near + pad(), pad() + far, pad(), pad() + item[:13], pad() + item[:9] + pad(), [w.upper() + "," for w in item]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(50, None), (51, ""), (None, " ".join(item)), (52, "a b c d"), (53, "a " * 20000 + " ".join(item)), (0, " ".join(texts[0]))]
    items = [(1, " ".join(item)), (2, None), (3, "a b c"), (4, " ".join(f"q{i}" for i in range(40))), (5, " ".join(item)), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("region", F.lit("clash")).withColumn("item_id", F.lit(7))
    tests = spark.createDataFrame(items, "item_id long, text string").withColumn("seed", F.lit("clash"))
    got = sorted(((x.doc_id, x.item_id) for x in decontam.overlaps(docs, tests).collect()), key=str)
    want = sorted([(d, i) for d in (0, 1, 4, 6, 53, None) for i in (1, 5)] + [(52, 3)], key=str)
    assert got == want
    assert decontam.overlaps(docs.limit(0), tests).count() == 0 and decontam.overlaps(docs, tests.limit(0)).count() == 0


@pytest.mark.parametrize("n", range(1, 14))
def test_masks_reach_every_tolerated_change(n):
    """Whichever words of an item (or of a window of 13) differ, some mask selects only others."""
    masks = decontam.short_masks(n, 0.8) if n < decontam.WINDOW else decontam.MASKS
    spans = [{at + i for i, c in enumerate(m) if c == "1"} for m in masks for at in range(n - len(m) + 1)]
    for differ in range(int(n * 0.2 + 1e-9) + 1):
        for gone in combinations(range(n), differ):
            assert any(span and not span & set(gone) for span in spans), gone


def test_decontamination_against_all_pairs(spark):
    """Items of every length from one word on, with words replaced, held against a comparison along every diagonal."""
    r = random.Random(11)
    pad = lambda n: [f"p{r.randrange(10**6)}" for _ in range(n)]
    items, docs = [(0, ""), (1, None)], [(0, ""), (1, None), (2, " ".join(pad(60)))]
    for n in [*range(1, 17), 20, 31, 60]:
        item = [f"q{n}x{r.randrange(50)}" for _ in range(n)]
        items += [(len(items), " ".join(item)), (len(items) + 1, " ".join(item))]
        for change in (0, 0.1, 0.15, 0.2, 0.25, 0.35):
            text = [w if r.random() >= change else "other" for w in item]
            docs += [(len(docs), " ".join(pad(r.randrange(20)) + text + pad(r.randrange(20))))]
            docs += [(len(docs), " ".join(text[: r.randint(1, n)]))]
    want = set()
    for d, text in docs:
        doc = np.array((text or "").split())
        for i, words in items:
            item = np.array((words or "").split())
            need = min(decontam.WINDOW, len(item))
            for lag in range(1 - len(doc), len(item)) if need else ():
                lo, hi = max(0, -lag), min(len(doc), len(item) - lag)
                if hi - lo >= need and decontam.best_window(doc[lo:hi] == item[lo + lag : hi + lag], need)[1] >= 0.8 * need - 1e-9:
                    want.add((d, i))
    got = decontam.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)
    words, tests = ({k: (t or "").split() for k, t in rows} for rows in (docs, items))
    for x in got:
        a, b = words[x.doc_id][x.doc_start :][: x.n_words], tests[x.item_id][x.item_start :][: x.n_words]
        assert x.n_same == sum(map(str.__eq__, a, b)) >= 0.8 * x.n_words - 1e-9


@pytest.mark.parametrize("k", [3, 10])
def test_top_k_is_exact(spark, k):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(400, 12)).round(2)
    vectors[50:80] = vectors[50]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (901, []), (902, [float("nan")] * 12), (903, [None] + [1.0] * 11), (904, [math.inf] * 12), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("label", F.lit(1))
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in pivot.top_k(df, F.col("vec_id") % 10 == 0, k=k, pivots=5, annuli=4, block=16).collect())
    q = np.floor(1024 * vectors).astype(np.int64)
    want = []
    for i in range(0, 400, 10):
        s = q @ q[i]
        order = [j for j in sorted(range(400), key=lambda j: (-s[j], j)) if j != i][:k]
        want += [(i, n + 1, j, int(s[j])) for n, j in enumerate(order)]
    assert got == want
    assert pivot.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert pivot.top_k(df.where("vec_id < 3"), F.col("vec_id") == 0, k=k).count() == 2


def test_top_k_of_odd_vectors(spark):
    """Huge components, other lengths, empty vectors and shared ids: every row takes part, each as a row of its own."""
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 2)).round(2))]
    rows += [(60, [5e12, 1.0]), (61, [-3e14, 2.0]), (62, [3.0]), (63, []), (64, [1.0, 2.0, 3.0]), (10, [0.5, 0.5]), (10, [0.5, 0.5]), (65, [1e308, 1.0]), (66, [1e15, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in pivot.top_k(df, F.col("vec_id") % 10 == 0, k=5, block=8).collect())
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i != 65]
    cut = lambda x: max(-(2**63), min(2**63 - 1, x))
    want = []
    for a, (i, q) in enumerate(whole):
        if i % 10 == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), j) for b, (j, v) in enumerate(whole) if b != a)[:5]
            want += [(i, n + 1, j, cut(-s)) for n, (s, j) in enumerate(scores)]
    assert got == sorted(want)


def test_top_k_stops_early(spark):
    """In clusters, most annuli are never visited."""
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(25, 8))[rng.integers(0, 25, 2500)] + rng.normal(size=(2500, 8)) * 0.03
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    report: list = []
    got = [(x.query_id, x.score) for x in pivot.top_k(df, F.col("vec_id") % 100 == 0, block=25, report=report).collect()]
    q = np.floor(1024 * vectors).astype(np.int64)
    scores = q[::100] @ q.T
    scores[np.arange(25), np.arange(25) * 100] = np.iinfo(np.int64).min
    assert sorted(got) == sorted((int(i) * 100, int(s)) for i in range(25) for s in np.sort(scores[i])[-10:])
    assert len(report) > 1 and sum(report) < 0.4 * 25 * 2500, report


def test_class_scores(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(WORDS[: r.choice((5, 50, 400))]) for _ in range(r.randint(0, 60)))) for i in range(200)]
    rows += [(200, None), (201, "New UNSEEN Éa"), (None, "w1 w2"), (202, "w3 " * 20000), (203, "w1"), (203, "w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    got = brown.scored(docs, classes=4, rounds=3).collect()
    low = {i: i + 32 for i in range(65, 91)}
    tokens = [(d, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [None]) for d, t in rows]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, t in tokens if not held(d) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted([(d, held(d), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for d, t in tokens], key=str)
    assert sorted([(x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got], key=str) == want
    assert all(x.score < 0 for x in got)
    assert brown.scored(docs.limit(0)).count() == 0
    assert {x.n_known for x in brown.scored(docs.where("doc_id = 201").withColumn("doc_id", F.lit(4).cast("long")), folds=1, held=0).collect()} == {0}


def test_class_model_predicts_better_than_the_base(spark):
    r = random.Random(9)
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(i, " ".join(r.choice((a, b)[j % 2]) for j in range(60))) for i in range(150)]
    got = brown.scored(spark.createDataFrame(rows, "doc_id long, text string"), classes=4, rounds=6).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1] * 0.97  # less than the base's log loss


@pytest.mark.parametrize("frequent", [1e-6, 5e-3])
def test_words_of_few_tokens_get_classes_too(spark, monkeypatch, frequent):
    r = random.Random(11)
    # two sides by turns; three in four tokens are of words too rare for the rounds, all of one shape
    sides = [([f"{s}{chr(97 + i)}" for i in range(8)], [f"{s}{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(5)]) for s in "xy"]
    rows = [(i, " ".join(r.choice(sides[j % 2][r.random() < 0.75]) for j in range(60))) for i in range(300)]
    monkeypatch.setattr(brown, "CLUSTERED", 0.01)
    monkeypatch.setattr(brown, "FREQUENT", frequent)
    got = brown.scored(spark.createDataFrame(rows, "doc_id long, text string"), classes=4).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] - got[1] > 0.25 * got[2]  # knowing the side is worth log10(2) = 0.30 a token


def test_rule_ensemble(spark):
    r = random.Random(10)
    rows, labels = [], []
    for i in range(300):
        junk = i % 3 == 0
        words = [r.choice(WORDS) for _ in range(r.randint(5, 60))]
        rows.append((i, " ".join((w + "%%%").upper() if junk else w for w in words)))
        labels.append((i, 0 if junk else 1))
    rows += [(900, None), (901, ""), (None, "w1 w2"), (902, "w3 " * 20000), (0, rows[0][1])]
    labels += [(None, 1), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("stats", F.lit("clash")).withColumn("label", F.lit(1)).withColumn("score", F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int").withColumn("text", F.lit("clash"))
    model = rulefit.fit(docs, marks)
    got = rulefit.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 300]
    assert held and all(x.predicted == (x.doc_id % 3 > 0) for x in held)
    assert len(model.weights) < 40
    one = rulefit.fit(docs, marks.where("quality = 1"))
    assert {x.score for x in rulefit.scored(docs, one).collect()} == {1.0}
    assert {x.score for x in rulefit.scored(docs, rulefit.fit(docs, marks.limit(0))).collect()} == {0.5}
    assert rulefit.scored(docs.limit(0), model).count() == 0


def test_tree_paths(spark):
    """Rules of a fitted forest's nodes, held against what its trees print."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    r = random.Random(4)
    rows = [(float(i % 7), r.random() * 1e-5, float(i % 7 > 3 or r.random() > 0.8)) for i in range(300)]
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, label double"))
    want = set()
    forest = RandomForestClassifier(numTrees=3, maxDepth=3, seed=1).fit(rows)
    for tree in forest.trees:
        above: list = []
        for line in tree.toDebugString.splitlines():
            m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.Ee]+)\)", line)
            if m:
                above = [x for x in above if x[0] < len(m[1])] + [(len(m[1]), ("ab"[int(m[2])], m[3], float(m[4])))]
                want.add(rulefit.simplified(tuple(x[1] for x in above)))
    assert {r.tests for t in forest.trees for r in rulefit.paths(t._call_java("rootNode"), ["a", "b"])} == want and len(want) > 8


def test_stages_hand_over_small_batches_of_texts(spark, sf_dir):
    """After any stage, texts reach Python a few MB at a time; a limit of the user's own stays."""
    import corpus_pipeline as cp

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("word "), 1000).alias("text"))
    for name, stage in cp.STAGES:
        spark.conf.unset(key)
        stage(spark, docs, sf_dir)
        got = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
        assert sum(got) >= 4000 * 5000 and max(got) < 5 << 20, name
    try:
        spark.conf.set(key, "1000000")
        cp.encode(spark, docs, sf_dir)
        assert spark.conf.get(key) == "1000000"
    finally:
        spark.conf.unset(key)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        after_rows = stage(spark, docs, sf_dir)
        assert after_rows.columns == list(cp.COLUMNS) and [f.dataType for f in after_rows.schema] == [f.dataType for f in docs.schema]
        docs = cp.stored(after_rows, f"test-{name}")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "near_dedup":
            texts = Counter(after.values())
            assert set(texts.values()) <= {1}
        if name == "substring_dedup":
            assert all(len(t.split()) <= len(before[d].split()) for d, t in after.items())
        else:
            assert all(before[d] == t for d, t in after.items())
        before = after
    assert cp.STAGES[-1][1](spark, docs, sf_dir).count() == len(before)
    empty = docs.limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_crowded_texts_are_joined_exactly(spark):
    """Pairs of texts that a crowded bucket holds are all found, by rare runs or, where there are none, block by block."""
    r = random.Random(16)
    passage = [f"p{i}" for i in range(60)]
    texts = [passage + [f"w{r.randrange(10**6)}" for _ in range(n)] for n in (12, 17, 20, 40, 90, 300) for _ in range(12)]
    texts += [changed(r, t, 0.12, False) for t in texts[::3]] + [["a", "b", "c", "d"], ["a", "b", "c", "d", "e"], ["z"], ["z", "y"]]
    texts += [[f"p{i}" for i in r.sample(range(60), 60)] for _ in range(6)]  # the same words in other orders
    codes = [np.array([zlib.crc32(w.encode()) for w in t], np.uint32) for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if omh.similar(codes[i], codes[j], 0.8)}
    rows = spark.createDataFrame([(i, i, bytearray(c.tobytes())) for i, c in enumerate(codes)], "node long, root long, words binary")
    lengths = spark.createDataFrame([(i, len(c)) for i, c in enumerate(codes)], "node long, n int")
    for hot in (16, 2):
        pairs, held = omh._across(rows, lengths, 0.8, hot)
        got = set(map(tuple, pairs.collect()))
        sure = set(map(tuple, held.collect())) if held is not None else set()
        assert want <= got | sure and sure <= want, hot
        assert (held is not None) == (hot == 2)
    assert set(map(tuple, omh._block_pairs(rows, 0.8, 7).collect())) == want


def test_runs_that_similar_texts_share():
    """No similar pair has fewer runs in common than the bound says."""
    r = random.Random(17)
    for _ in range(300):
        a = [r.randrange(40) for _ in range(r.randrange(1, 40))]
        b = list(a)
        for _ in range(r.randrange(0, len(a) // 4 + 1)):
            at = r.randrange(len(b))
            b[at : at + r.choice((0, 1, 1))] = [r.randrange(40)]
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        if not omh.similar(x, y, 0.8):
            continue
        for q in omh.RUNS:
            if min(len(a), len(b)) <= omh.not_by_runs(q, 0.8):
                continue
            (u, u_most), (v, v_most) = omh.rare_runs(x, q, 0.8), omh.rare_runs(y, q, 0.8)
            both = len(np.intersect1d(u, v))
            assert both >= max(len(u) - u_most, len(v) - v_most) + 1


def test_a_crowd_of_texts_with_a_passage_joins_few_runs(spark, monkeypatch):
    """What many unlike texts share is counted and set aside; it isn't joined again with every text."""
    r = random.Random(18)
    passage = [f"p{i}" for i in range(12)]
    texts = [passage + [f"w{r.randrange(10**6)}" for _ in range(80)] for _ in range(150)]
    texts += [changed(r, t, 0.1, False) for t in texts[:5]]
    codes = [np.array([zlib.crc32(w.encode()) for w in t], np.uint32) for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if omh.similar(codes[i], codes[j], 0.8)}
    rows = spark.createDataFrame([(i, i, bytearray(c.tobytes())) for i, c in enumerate(codes)], "node long, root long, words binary")
    lengths = spark.createDataFrame([(i, len(c)) for i, c in enumerate(codes)], "node long, n int")
    joined = []

    def kept(df, name, stored=omh.stored):
        if name == "rare":
            joined.append(df._jdf.queryExecution())
        return stored(df, name)

    monkeypatch.setattr(omh, "stored", kept)
    pairs, held = omh._across(rows, lengths, 0.8, 2)
    assert want and held is None and want <= set(map(tuple, pairs.collect()))
    plan = joined[0].analyzed()
    joins = [n for n in _nodes(plan) if n.nodeName() == "Join"]
    frame = spark._jvm.org.apache.spark.sql.classic.Dataset
    assert frame.ofRows(spark._jsparkSession, joins[0]).count() < 6 * len(texts)


def test_a_passage_is_counted_once_a_task(spark):
    """The count of runs has a row for each run of a task's texts, not for each text that has it, and says the same."""
    r = random.Random(19)
    passage = [f"p{i}" for i in range(40)]
    texts = [passage + [f"w{r.randrange(10**6)}" for _ in range(10)] for _ in range(300)]
    codes = [np.array([zlib.crc32(w.encode()) for w in t], np.uint32) for t in texts]
    rows = spark.createDataFrame([(i, i // 2, bytearray(c.tobytes())) for i, c in enumerate(codes)], "node long, root long, words binary").coalesce(2)
    for q in omh.RUNS:
        want = {}
        for i, c in enumerate(codes):
            for key in omh.rare_runs(c, q, 0.8)[0].view(np.int64).tolist():
                n, lo, hi = want.get(key, (0, i // 2, i // 2))
                want[key] = (n + 1, min(lo, i // 2), max(hi, i // 2))
        for at_once in (omh.AT_ONCE, 700):
            made = rows.mapInArrow(omh._counted(q, 0.8, at_once), "key long, n long, lo long, hi long").collect()
            got = {}
            for key, n, lo, hi in made:
                m, a, b = got.get(key, (0, lo, hi))
                got[key] = (m + n, min(a, lo), max(b, hi))
            assert got == want, q
            assert len(made) < (2 * len(want) if at_once == omh.AT_ONCE else 0.6 * sum(n for n, _, _ in want.values()))


def test_runs_of_one_component_are_not_counted(spark, monkeypatch):
    """The count of runs has rows for those that texts of several components have, and hardly any for the rest, which is most of a text."""
    r = random.Random(20)
    passage = [f"p{i}" for i in range(12)]
    texts = [passage + [f"w{r.randrange(10**6)}" for _ in range(80)] for _ in range(150)]
    texts += [changed(r, t, 0.1, False) for t in texts[:5]]
    codes = [np.array([zlib.crc32(w.encode()) for w in t], np.uint32) for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if omh.similar(codes[i], codes[j], 0.8)}
    rows = spark.createDataFrame([(i, i, bytearray(c.tobytes())) for i, c in enumerate(codes)], "node long, root long, words binary")
    lengths = spark.createDataFrame([(i, len(c)) for i, c in enumerate(codes)], "node long, n int")
    counted = []

    def kept(df, name, stored=omh.stored):
        if name == "spread":
            counted.append(df._jdf.queryExecution())
        return stored(df, name)

    monkeypatch.setattr(omh, "stored", kept)
    pairs, held = omh._across(rows, lengths, 0.8, 2)
    assert want and held is None and want <= set(map(tuple, pairs.collect()))
    made = [n for n in _nodes(counted[0].analyzed()) if n.nodeName() == "MapInArrow"]
    frame = spark._jvm.org.apache.spark.sql.classic.Dataset
    assert 0 < frame.ofRows(spark._jsparkSession, made[0]).count() < 10 * len(texts)


@pytest.mark.parametrize("bits", [1 << 20, 1 << 15])
def test_no_run_of_several_components_is_ruled_out(spark, bits):
    """What passes the map and is counted holds every run of several roots with its full count, wherever its texts lie; also in a map too small for them."""
    r = random.Random(21)
    texts = [[f"w{r.randrange(3000)}" for _ in range(60)] for _ in range(200)]
    texts += [changed(r, texts[0], 0.2, False) for _ in range(40)]  # one component
    codes = [np.array([zlib.crc32(w.encode()) for w in t], np.uint32) for t in texts]
    roots = [i if i < 200 else 0 for i in range(len(texts))]
    rows = spark.createDataFrame([(i, roots[i], bytearray(c.tobytes())) for i, c in enumerate(codes)], "node long, root long, words binary")
    for q, parts, at_once in ((2, 1, 100), (2, 1, 1 << 18), (2, 5, 700), (5, 3, 1 << 18), (1, 3, 1000)):
        all_ = {}
        for root, c in zip(roots, codes, strict=True):
            for key in omh.rare_runs(c, q, 0.8)[0].view(np.int64).tolist():
                all_.setdefault(key, []).append(root)
        some = rows.repartition(parts)
        owned = omh.Owned(some.mapInArrow(omh._marked(q, 0.8, bits, at_once), omh.MARKS), bits)
        counted = some.mapInArrow(omh._counted(q, 0.8, at_once, spark.sparkContext.broadcast(owned)), "key long, n long, lo long, hi long")
        got = {x.key: (x.n, x.lo, x.hi) for x in counted.groupBy("key").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
        assert all(got[k] == (len(v), min(v), max(v)) for k, v in all_.items() if len(set(v)) > 1)
        assert all(k in all_ and x[0] == len(all_[k]) for k, x in got.items())
        if bits == 1 << 20 and q == 2:
            single = sum(len(v) == 1 for v in all_.values())
            assert sum(x[0] == 1 for x in got.values()) < 0.1 * single


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def test_rounds_of_a_period_are_one_row(spark, monkeypatch):
    """Places that repeat in equal steps are one row, and all of their words go."""
    sizes = {}

    def kept(df, name, stored=rlz.stored):
        out = stored(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(rlz, "stored", kept)
    rows = [(i, " ".join([f"h{i}", *[f"a{i}", f"b{i}"] * 300, f"m{i}", *[f"c{i}", f"d{i}", f"e{i}"] * 50, "end"])) for i in range(6)]
    got = rlz.dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()
    # the first round of each period stays
    assert {r.n_removed for r in got} == {(600 - 2) + (150 - 3)}
    assert sizes["runs"] <= 6 * 6


def test_rounds_keep_every_run():
    r = np.random.default_rng(19)
    for _ in range(200):
        m = int(r.integers(1, 40))
        runs = sorted({(int(a), int(b), 0, int(c), int(d)) for a, b, c, d in zip(r.integers(0, 2, m), r.integers(0, 30, m), r.integers(0, 2, m), r.integers(1, 3, m), strict=True)})
        out = zip(*(x.tolist() for x in rlz._rounds(*(np.array(c, np.int64) for c in zip(*runs, strict=True)))), strict=True)
        assert sorted((doc, start + k * step, ref, at, n) for doc, start, ref, at, n, times, step in out for k in range(times)) == runs
