"""Each stage of the pipeline against plain Python, on rows with every oddity."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import regex
from test_text import brute_spans

from quernstone.llm import decontam, omh, rulefit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, number string, kept_text string, row int, score string, n_removed int"
ITEM = [f"q{i}" for i in range(25)]


def prose(r, n):
    words = [f"{r.choice('abcdefgh')}{r.choice(['ing', 'er', 'and', 'oth'])}{r.randrange(3000)}" for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, n, 12))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Rows, their table, and a folder with labels and benchmark items."""
    r = random.Random(21)
    texts = [prose(r, r.randrange(60, 160)) for _ in range(70)]
    texts += [t.replace(texts[i].split()[5], "changed") for i, t in enumerate(texts[:8])]  # near copies
    junk = [" ".join(f"{w}{r.choice(['***', '$$$', '%%%'])}" for w in prose(r, 60).split()) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate([*texts, *junk])]
    shared = " ".join(f"s{i}" for i in range(45))
    rows += [(200, shared + "\n" + prose(r, 60)), (201, prose(r, 50) + "\n" + shared), (202, prose(r, 70) + " " + " ".join(ITEM) + " " + prose(r, 30))]
    rows += [(203, " ".join([*ITEM[:6], "other", *ITEM[7:]])), (204, prose(r, 30_000)), (205, None), (206, ""), (207, prose(r, 80)), (207, prose(r, 80)), (208, texts[3]), (208, texts[3])]
    rows += [(None, prose(r, 90)), (None, prose(r, 90)), (None, rows[-1][1]), (None, None)]
    rows.append((None, rows[-3][1]))
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, int(i < 78), 0) for i in range(108)], "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(ITEM)), (2, None), (3, "one two")], "item_id long, text string").write.parquet(f"file://{folder}/benchmark.parquet")
    full = [(i, t, "en", "src", len(t or ""), "clash", "clash", 1, "clash", 9) for i, t in rows]
    return rows, spark.createDataFrame(full, SCHEMA).repartition(3), f"file://{folder}"


def of(df):
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def plain_statistics(text):
    text = text or ""
    words, lines = [w for w in re.split(r"[ \t-\r]+", text) if w], [x for x in text.split("\n") if x]
    over = lambda x, y: x / y if y else 0.0
    found = lambda pattern: len(regex.findall(pattern, text))
    n = len(words)
    return {
        "log_words": math.log1p(n), "mean_word": over(len(text), n), "long_words": over(sum(len(w) > 9 for w in words), n), "distinct_words": over(len(set(words)), n),
        "distinct_lines": over(len(set(lines)), len(lines)), "words_a_line": over(n, len(lines)), "upper": over(found(r"\p{Lu}"), len(text)), "digits": over(found("[0-9]"), len(text)),
        "stops": over(found("[.,;:]"), n), "symbols": over(found(r"[^\p{L}\p{N} \t\n\x0b\f\r.,;:'\"()-]"), len(text)), "bars": over(found(r"\|"), n), "marks": over(found("[!?]"), n),
    }


def plain_score(model, text):
    stats = plain_statistics(text)
    holds = lambda rule: all(stats[n] <= x if sign == "<=" else stats[n] > x for n, sign, x in rule.tests)
    return 1 / (1 + math.exp(-(model.bias + sum(w for rule, w in model.weights if holds(rule)))))


def test_quality(spark, corpus):
    import corpus_pipeline as cp

    rows, docs, folder = corpus
    model = rulefit.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert len(model.weights) > 0
    want = [(i, t) for i, t in rows if plain_score(model, t) >= 0.7]
    assert of(cp.quality(spark, docs, folder)) == sorted(want, key=str)
    kept = {i for i, _ in want}
    assert set(range(78)) <= kept and not kept & set(range(78, 108))
    scores = {r.doc_id: r.score for r in rulefit.scored(docs, model).collect() if r.doc_id is not None and r.doc_id < 207}
    assert all(abs(scores[i] - plain_score(model, t)) < 1e-9 for i, t in rows if i in scores)


def test_near_dedup(spark, corpus):
    import corpus_pipeline as cp

    rows, docs, folder = corpus
    words = lambda t: re.findall(r"[a-z0-9_]+", (t or "").lower())
    named = {}
    for i, t in rows:  # one text of an id, the least; those of no id by their text
        if i is not None:
            named[i] = min(named.get(i, (t or "")), t or "") if i in named else t
    texts = [(i, t) for i, t in sorted(named.items())] + [(None, t) for t in sorted({t for i, t in rows if i is None and t})] + [(None, None)]
    codes = [np.array([zlib.crc32(w.encode()) for w in words(t)], np.uint32) for _, t in texts]
    want = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            alike = words(texts[a][1]) == words(texts[b][1]) if len(codes[a]) < 5 else len(codes[b]) >= 5 and omh.similar(codes[a], codes[b], 0.8)
            if alike and (len(codes[a]) or (texts[a][1] or "") == (texts[b][1] or "")):
                lo, hi = sorted((want[a], want[b]))
                want = [lo if x == hi else x for x in want]
    stay = [texts[i] for i in range(len(texts)) if want[i] == i]
    assert [(i, t or "") for i, t in of(cp.near_dedup(spark, docs, folder))] == sorted(((i, t or "") for i, t in stay), key=str)


def test_substring_dedup(spark, corpus):
    import corpus_pipeline as cp

    rows, docs, folder = corpus
    want = [(d, digest) for d, n, gone, digest in brute_spans(rows, 20) if gone == 0 or gone < n]
    digest = lambda t: hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest()
    assert sorted(((i, digest(t)) for i, t in of(cp.substring_dedup(spark, docs, folder))), key=str) == sorted(want, key=str)


def test_decontaminate(spark, corpus):
    import corpus_pipeline as cp

    rows, docs, folder = corpus
    tests = [np.array(t.split()) for t in (" ".join(ITEM), "one two")]
    bad = set()
    for i, t in rows:
        doc = np.array(re.findall(r"\w+", (t or "").lower()))
        for item in tests:
            need = min(decontam.WINDOW, len(item))
            for lag in range(1 - len(doc), len(item)):
                lo, hi = max(0, -lag), min(len(doc), len(item) - lag)
                if hi - lo >= need and decontam.best_window(doc[lo:hi] == item[lo + lag : hi + lag], need)[1] >= 0.8 * need - 1e-9:
                    bad.add(i if i is not None else t)
    assert bad == {202, 203}
    assert of(cp.decontaminate(spark, docs, folder)) == sorted(((i, t) for i, t in rows if i not in bad), key=str)


def test_encode(spark, corpus):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    import corpus_pipeline as cp

    rows, docs, folder = corpus
    library = Tokenizer.from_file(str(path("word_bpe_49k.json")))
    library.no_truncation()
    library.no_padding()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in cp.encode(spark, docs, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
