"""Stages of the corpus pipeline: (spark, docs, sf_dir) to a DataFrame with the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.llm import decontaminate, line_dedup, minhash, token_packing, toxicity
from shotloom.llm.common import keyed, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their frequent lines; every document stays, ``n_chars`` follows its text."""
    kept = line_dedup.dedup_lines(docs, keep=("lang", "source"))
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the labelled rows among ``docs``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    toxic = toxicity.score(docs, model, keep=COLUMNS).filter("predicted = 0")
    return toxic.select("_keep.*")


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id; identical rows become one."""
    keepers = minhash.near_duplicates(docs).filter("keeper").select("_d", "_t").distinct()
    rows = keyed(docs, keep=COLUMNS).join(keepers, ["_d", "_t"], "left_semi")
    return rows.groupBy("_d", "_t").agg(F.first("_keep").alias("_keep")).select("_keep.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    bad = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("_d", "_t").distinct()
    return keyed(docs, keep=COLUMNS).join(bad, ["_d", "_t"], "left_anti").select("_keep.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, ids included."""
    return token_packing.pack_documents(docs)
