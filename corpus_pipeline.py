"""Documents to training windows: language, toxicity, near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quizlake.llm import stages
from quizlake.llm.tables import table
from quizlake.session import materialise

STAGES = [
    ("language_id", stages.known_language),
    ("toxicity", stages.not_toxic),
    ("ngram_jaccard_join", stages.one_of_each),
    ("substring_dedup", stages.without_repeats),
    ("packing", stages.packed),
]
#: SQL cannot express trained models, alignment or differencing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
