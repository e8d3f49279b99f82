"""A corpus pipeline: five stages over ``documents``, each one operator of the llm subpackage.

Every stage takes all documents its predecessor kept and returns documents in the same columns
(the last: the encoded documents).  ``run`` writes each stage's result to the folder that
the executors share and reads it again for the next.

Defined results of every stage: an empty table gives an empty result; null text counts as empty; columns beyond those
of documents are dropped, whatever their names; texts are read whole.  A document without an id is known by its text
(its number is a hash of it), so its copies are copies of one document.  Rows that repeat or share an id:
quality and encode judge each row by its text; near_dedup keeps one row of an id (the least by text, then the other columns);
substring_dedup cuts each row's own text; decontaminate drops an id's rows if any of their texts overlaps an item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import bpe, decontam, omh, rlz, rulefit
from quernstone.llm.scratch import stored
from quernstone.plans.session import ship_package, small_batches

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def prepare(spark: SparkSession) -> None:
    """The executors stay the same from stage to stage, and don't give memory back: batches of texts are kept small."""
    ship_package(spark)
    small_batches(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts."""
    prepare(spark)
    model = rulefit.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rulefit.scored(docs, model, keep=COLUMNS[1:]).where("predicted = 1").select(*COLUMNS)


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents with their number: the id, or a hash of the text (beyond 2**62) where there is none."""
    return docs.select(*COLUMNS, rlz.document_number().alias("number"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least number of each class of near duplicates, one row of it."""
    prepare(spark)
    rows = _numbered(docs)
    firsts = omh.classes(rows.select(F.col("number").alias("doc_id"), "text")).where("doc_id = class_id").select(F.col("doc_id").alias("number")).distinct()
    one = rows.join(firsts, "number", "left_semi").groupBy("number").agg(F.min(F.struct("text", "doc_id", *COLUMNS[2:])).alias("row"))
    return one.select(*[F.col(f"row.{c}").alias(c) for c in COLUMNS])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less their repeated spans; documents of which nothing is left go."""
    prepare(spark)
    cut = rlz.dedup(docs, keep=("lang", "source", "n_chars")).where("n_removed = 0 or n_removed < n_words")
    text = F.col("kept_text")
    return cut.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    prepare(spark)
    rows = _numbered(docs)
    found = decontam.overlaps(rows.select(F.col("number").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(found.select(F.col("doc_id").alias("number")).distinct(), "number", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, digests and ids of the documents left."""
    prepare(spark)
    return bpe.encode(docs, bpe.tokenizer_file("word_bpe_49k.json")).drop("decoded")


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: A trained model, sampled candidates and a tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
