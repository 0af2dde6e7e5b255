"""A training corpus out of raw documents, in five stages; each works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from melisma.llm import jaccard, langid, mixing, packing, secrets
from melisma.llm.common import written

STAGES = [
    ("language_id", langid.stage_language_id),
    ("near_duplicates", jaccard.stage_near_duplicates),
    ("secret_scan", secrets.stage_secrets),
    ("mixing", mixing.stage_mixing),
    ("packing", packing.stage_packing),
]

#: The stages learn models, round at random and tokenize: SQL can't express their rows. Tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents; every stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
