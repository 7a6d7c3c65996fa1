"""From raw documents to token ids: five stages, each a written table and the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatflow.llm import deobfuscate, mixing, ngram_join, pieces, quality
from seatflow.llm.common import remainder, stored, table

#: Near duplicates: five-word shingles, 80 percent of them in common.
SHINGLE_WORDS, SHARED_PERCENT = 5, 80


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learned from."""
    return table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 5) != 0)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.train(docs, _labels(spark, sf_dir)))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deobfuscate.accepted(docs, deobfuscate.train(docs, _labels(spark, sf_dir)))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.first_of_groups(docs, SHARED_PERCENT, SHINGLE_WORDS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = pieces.encode(docs, pieces.Vocabulary.load(merges=True))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", without_copies),
    ("mixing", mixed),
    ("pieces", encoded),
]

#: SQL can neither train nor apply the models, nor find the pieces: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
