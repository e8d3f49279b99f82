"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of a text are Spark columns (shares of characters, words and lines).
2. A forest of shallow trees is fitted on labelled rows; every path from a root to a node is a
   conjunction of comparisons, that is, a rule.
3. A lasso logistic regression over the rules' truth values keeps few of them.
4. The rules kept are compiled into one column expression, so scoring is a single pass of
   generated code over the texts.

Only the fit looks at a sample: the ``sample`` labelled rows with the least hash of their
doc_id (default 20,000), so at most that many rows are broadcast to find their texts.

Defined results: null and empty texts have all statistics 0 and get a score like any other;
rows with a null quality or doc_id are not learned from; a null doc_id isn't held out; labels
of one class only give that class's share as everyone's score, no labels 0.5; repeated
rows get equal scores; other columns are carried only if named.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored

SAMPLE = 20_000
THRESHOLD = 0.7
TREES = 24
DEPTH = 3
LASSO = 0.002


def prepared(docs: DataFrame, *others: Column) -> DataFrame:
    """The given columns with the text, its words and its lines, each made once for all statistics."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(*others, text.alias("stat_text"))
    words = F.filter(F.split("stat_text", r"[ \t-\r]+"), lambda w: w != "")
    lines = F.filter(F.split("stat_text", "\n"), lambda x: x != "")
    return rows.withColumns({"stat_words": words, "stat_lines": lines})


def statistics() -> dict[str, Column]:
    """Named statistics of a prepared row; 0 where there is nothing to count."""
    text, words, lines = F.col("stat_text"), F.col("stat_words"), F.col("stat_lines")
    chars, n, n_lines = F.length(text), F.size(words), F.size(lines)
    over = lambda x, y: F.coalesce(x / F.nullif(y.cast("double"), F.lit(0.0)), F.lit(0.0))
    return {
        "log_words": F.log1p(n.cast("double")),
        "mean_word": over(chars, n),
        "long_words": over(F.size(F.filter(words, lambda w: F.length(w) > 9)), n),
        "distinct_words": over(F.size(F.array_distinct(words)), n),
        "distinct_lines": over(F.size(F.array_distinct(lines)), n_lines),
        "words_a_line": over(n, n_lines),
        "upper": over(F.regexp_count(text, F.lit(r"\p{Lu}")), chars),
        "digits": over(F.regexp_count(text, F.lit("[0-9]")), chars),
        "stops": over(F.regexp_count(text, F.lit("[.,;:]")), n),
        "symbols": over(F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:'\"()-]")), chars),
        "bars": over(F.regexp_count(text, F.lit(r"\|")), n),
        "marks": over(F.regexp_count(text, F.lit("[!?]")), n),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, "<=" or ">", limit)."""

    tests: tuple[tuple[str, str, float], ...]

    def column(self, stats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, sign, limit in self.tests:
            out = out & (stats[name] <= limit if sign == "<=" else stats[name] > limit)
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self, stats: dict[str, Column]) -> Column:
        z = F.lit(self.bias)
        for rule, weight in self.weights:
            z = z + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))


def paths(node, names: list[str], above: tuple[tuple[str, str, float], ...] = ()) -> set[Rule]:
    """Rules of all nodes below a fitted tree's node (of the JVM)."""
    if not node.getClass().getSimpleName() == "InternalNode":
        return set()
    split, found = node.split(), set()
    for sign, child in (("<=", node.leftChild()), (">", node.rightChild())):
        tests = (*above, (names[split.featureIndex()], sign, float(split.threshold())))
        found |= {Rule(simplified(tests))} | paths(child, names, tests)
    return found


def simplified(tests: tuple[tuple[str, str, float], ...]) -> tuple[tuple[str, str, float], ...]:
    """The tightest limit for each statistic and side, in a fixed order."""
    tight: dict[tuple[str, str], float] = {}
    for name, sign, limit in tests:
        have = tight.get((name, sign), limit)
        tight[name, sign] = min(have, limit) if sign == "<=" else max(have, limit)
    return tuple(sorted((n, s, x) for (n, s), x in tight.items()))


def learnable(doc_id: Column, folds: int, held: int) -> Column:
    """Is the row outside the held-out fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) != held


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2, sample: int = SAMPLE) -> RuleEnsemble:
    """Learn from the labelled rows outside the held-out fold."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
        .where("doc_id is not null and label is not null")
        .where(learnable(F.col("doc_id"), folds, held))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(sample)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    made = stored(prepared(texts, F.col("label")).select(*(c.alias(n) for n, c in statistics().items()), "label"), "statistics").coalesce(1)
    names = made.columns[:-1]
    n, share = made.agg(F.count("*"), F.avg("label")).first()
    if not n or share in (0.0, 1.0):
        return RuleEnsemble(math.inf if share == 1.0 else -math.inf if n else 0.0, ())
    made = made.orderBy(*made.columns)  # the same order whatever the files' order
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(made).select("features", "label").persist()
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, subsamplingRate=0.5, featureSubsetStrategy="onethird").fit(vectors)
    vectors.unpersist()
    rules = sorted({r for t in forest.trees for r in paths(t._call_java("rootNode"), names)}, key=lambda r: r.tests)
    truth = made.select("label", *(r.column({c: F.col(c) for c in names}).cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    truth = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(truth).select("features", "label").persist()
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(truth)
    truth.unpersist()
    kept = tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if abs(w) > 1e-9)
    return RuleEnsemble(float(lasso.intercept), kept)


def scored(docs: DataFrame, model: RuleEnsemble, threshold: float = THRESHOLD, folds: int = 4, held: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns to keep, one row per row."""
    stats = statistics()
    rows = prepared(docs, F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).alias(f"other_{c}") for c in keep))
    rows = rows.withColumn("stats", F.struct(*(c.alias(n) for n, c in stats.items())))
    score = model.score({n: F.col(f"stats.{n}") for n in stats})
    out = rows.select("doc_id", F.coalesce(~learnable(F.col("doc_id"), folds, held), F.lit(False)).alias("held_out"), score.alias("score"), *(f"other_{c}" for c in keep))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnsRenamed({f"other_{c}": c for c in keep})
