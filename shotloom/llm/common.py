"""Helpers that the training-data operators share: row keys, span positions, staged intermediates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, ``text`` (null: empty), two join keys that are never null, and ``_keep``, a struct of columns.

    ``_d`` and ``_t`` are the id and a hash of the text, so rows with a null id or with one id
    and several texts stay apart, and repeated rows share a key.  Other columns are left behind:
    none of them can clash with a name used inside an operator.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = F.col(id_col).cast("bigint")
    kept = F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]) if keep else F.lit(None)
    return docs.select(doc.alias("doc_id"), text.alias("text"), F.coalesce(doc, F.lit(NO_ID)).alias("_d"),
                       F.xxhash64(text).alias("_t"), kept.alias("_keep"))


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches with their code point spans: array of (start, stop, value).

    Text pieces between the matches come from ``split``; running lengths give the places.  The
    pattern must not match an empty string.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    seed = F.struct(F.lit(0).cast("bigint").alias("at"),
                    F.array().cast("array<struct<start:bigint,stop:bigint,value:string>>").alias("out"))

    def step(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        stop = start + F.length(pair["value"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(
            start.alias("start"), stop.alias("stop"), pair["value"].alias("value")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values,
                       lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.aggregate(pairs, seed, step, lambda acc: acc["out"])
