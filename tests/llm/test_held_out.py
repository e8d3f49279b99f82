"""The trained models on rows that they didn't learn from."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quernstone.llm import queries

#: large enough for some hundred rows held out
SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs its tables")


def test_quality_of_held_out_rows(spark):
    scored = queries.op9_rule_ensemble_quality(spark, SF).where("held_out")
    rows = scored.join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality"), "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    ordered = sum((g > b) + (g == b) / 2 for g in good for b in bad)
    assert len(good) > 50 and len(bad) > 10
    assert ordered / (len(good) * len(bad)) > 0.95
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_class_model_beats_the_base_on_held_out_texts(spark):
    name = next(n for n in vars(queries) if n.startswith("op7_"))
    held = getattr(queries, name)(spark, SF).where("held_out")
    n, base, score = held.agg(F.sum("n_tokens"), F.sum("base_score"), F.sum("score")).first()
    # log10 a token: the classes are worth a quarter of the base's perplexity
    assert (score - base) / n > 0.12
