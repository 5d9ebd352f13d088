"""Corpus preparation in five stages over the ``documents`` table.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next stage's ``docs``.  All stages but the last
return the columns they were given; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.llm import langid
from tradelens.llm.common import cut, held_out_fold
from tradelens.llm.decontam import drop_contaminated
from tradelens.llm.exact_dedup import exact_dedup
from tradelens.llm.packing import pack
from tradelens.llm.queries import table, vocabulary
from tradelens.llm.simhash import simhash_dedup


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: null texts and texts without any letter."""
    model = langid.train(docs, ~F.coalesce(held_out_fold(F.col("doc_id")), F.lit(False)))
    if model is None:  # no label to learn from: nothing to reject a document by but its text
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return langid.predict(docs, model, carry=True).filter(F.col("lang_pred") != langid.UNDETERMINED).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    return exact_dedup(docs, carry=True).filter("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash class (3-word shingles, at most 3 differing bits) the row with the smallest id stays."""
    return simhash_dedup(docs, shingle=3, distance=3, carry=True).filter("kept").select("row.*")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents in windows of 2048 tokens."""
    return pack(docs, vocabulary(), size=2048, end_id=1)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_windows),
]

# Language models and tokenisation are beyond SQL; tests/llm checks the pipeline by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
