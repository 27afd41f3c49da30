"""Filtering, deduplication, cleaning and mixing of a document corpus, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of documents. The first stage rests on a trained model, so SQL
can't express the whole; tests hold it against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessarine.llm import _run, decontaminate, language_id, mixing, ngram_join, secrets

STAGES = [
    ("language_id", language_id.stage),
    ("near_duplicates", ngram_join.stage),
    ("decontamination", decontaminate.stage),
    ("secrets", secrets.stage),
    ("mixing", mixing.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents table; each stage reads what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = _run.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
