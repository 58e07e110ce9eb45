"""The corpus pipeline: documents in, packed token sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shotloom.llm import stages
from shotloom.llm.common import table
from shotloom.session import stage

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line dedup", stages.dedup_lines),
    ("MinHash near-dedup", stages.dedup_near),
    ("benchmark decontamination", stages.drop_contaminated),
    ("best-fit packing", stages.pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
