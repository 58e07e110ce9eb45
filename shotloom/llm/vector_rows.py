"""Rows of (id, label, vector) for the vector operators: which take part, and their matrices in tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, id_col: str, vec_col: str, label: Column | None = None) -> DataFrame:
    """``id``, ``label`` (only if given) and ``vec`` (doubles) of the rows that take part, one row per id.

    Rows with a null id, label or vector or a null or non-finite component are left out.  Of rows
    that share an id the one with the smallest label, then the smallest vector counts.
    """
    vec = F.col(vec_col).cast("array<double>")
    sound = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = rows.select(F.col(id_col).cast("bigint").alias("id"), (F.lit(0) if label is None else label).alias("label"), vec.alias("vec"))
    one = own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & sound)
    one = one.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row"))
    return one.select("id", *(["row.label"] if label is not None else []), "row.vec")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column; shorter rows end in zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, sizes = flat.flatten().to_numpy(zero_copy_only=False), np.diff(flat.offsets.to_numpy())
    width = int(sizes.max()) if len(sizes) else 0
    if width and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), values.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def cells(left: DataFrame, right: DataFrame, left_blocks: int, right_blocks: int, fn: Callable, schema: str,
          right_block: Column | None = None) -> DataFrame:
    """Call ``fn(left block, right block)`` on Arrow tables for every pair of blocks of two tables.

    Blocks are made by a hash of ``id``, so their sizes follow from their number; ``right_block`` names
    blocks that are there already.  A row is copied once per block of the other side; nothing is broadcast.
    """
    def block(n: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("_l", block(left_blocks)).withColumn("_r", every(right_blocks))
    b = right.withColumn("_r", block(right_blocks) if right_block is None else right_block).withColumn("_l", every(left_blocks))
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # both sides may stem from one table
    return a.groupBy("_l", "_r").cogroup(b.groupBy("_l", "_r")).applyInArrow(fn, schema)
