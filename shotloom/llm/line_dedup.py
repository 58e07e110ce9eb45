"""Line dedup: lines that recur in many documents are dropped from every document.

Lines are exploded with their position, normalised and hashed to 128 bits; the documents per
hash are counted; lines over the threshold are dropped and the rest is put together by position.
Only built-in functions run on the data.

Defined cases: a null or empty text is one empty line, which has no key and stays; each row is a
document of its own, so repeated rows count each; null ids are allowed; extra columns are ignored.
A document that loses all lines has the empty text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.llm.common import keyed
from shotloom.session import stage

BLANKS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SALTS = 16


def line_key(line: Column) -> Column:
    """The line without outer blanks, A-Z in lower case; other letters keep their case."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("_a"), F.xxhash64(F.lit(1), key).alias("_b")]


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int = 1) -> DataFrame:
    """Hashes (``_a``, ``_b``) of the keys found in at least ``min_docs`` documents, with ``n_docs``.

    A document counts once per key, as its keys are made distinct before they are exploded; the
    counts are then combined before the shuffle, so a line found everywhere is no hot key.
    """
    keys = F.array_distinct(F.transform(F.split("text", "\n", -1), line_key))
    lines = docs.select(F.explode(keys).alias("_k")).filter(F.length("_k") >= min_chars).select(*_hashes(F.col("_k")))
    return lines.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id",
                text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``doc_id``, the remaining ``text``, ``n_lines`` before dropping, ``n_dropped`` and the columns in ``keep``.

    Only hashes and positions are shuffled to find the dropped lines; each text moves once, to
    meet its own dropped positions.  The frequent hashes are written first, so that the join with
    them is planned on their real size; its keys are salted and a larger part is split by AQE.
    """
    base = keyed(docs, id_col, text_col, keep)
    frequent = stage(frequent_lines(base, min_docs, min_chars).select("_a", "_b"))
    salted = frequent.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lines = (base.select("_d", "_t", F.posexplode(F.split("text", "\n", -1)).alias("_pos", "_line"))
             .select("_d", "_t", "_pos", line_key(F.col("_line")).alias("_k")).filter(F.length("_k") >= min_chars)
             .select("_d", "_t", "_pos", *_hashes(F.col("_k")),
                     F.pmod(F.xxhash64("_d", "_t", "_pos"), F.lit(SALTS)).cast("int").alias("_s")))
    dropped = (lines.join(salted, ["_a", "_b", "_s"], "left_semi").groupBy("_d", "_t")
               .agg(F.collect_set("_pos").alias("_drop")))
    whole = base.join(dropped, ["_d", "_t"], "left").select(
        "doc_id", "text", F.split("text", "\n", -1).alias("_lines"), "_drop", "_keep")
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    rest = F.array_join(F.transform(places, lambda i: F.get("_lines", i)), "\n")
    n_dropped = F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.size("_drop"))
    return whole.select(
        "doc_id", F.when(F.col("_drop").isNull(), F.col("text")).otherwise(rest).alias("text"),
        F.size("_lines").cast("bigint").alias("n_lines"), n_dropped.cast("bigint").alias("n_dropped"),
        *[F.col("_keep")[c].alias(c) for c in keep])
