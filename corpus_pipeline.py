"""Documents through toxicity, line, near-duplicate and benchmark filters into token ids.

Each stage takes the documents that the one before it kept, and is written before the
next reads it. Null and empty texts pass the filters; near-duplicate removal keeps one
document without words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from landcompare.llm import decontamination, linetemplates, sentencepieces, simhash, toxicity
from landcompare.llm.common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on this run's documents and labels; what scores as toxic goes."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but the first; every document stays."""
    return linetemplates.drop_recurring_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def drop_leaking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontamination.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, checked and decoded again."""
    import public_tokenizers

    return sentencepieces.encode(docs, public_tokenizers.path(sentencepieces.MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaking),
    ("SentencePiece", encode),
]

# Learnt weights, fingerprints and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
