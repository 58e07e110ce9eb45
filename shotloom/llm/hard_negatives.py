"""Hard negatives by a secondary sort: scores of pairs in (anchor, descending score, id) order.

Anchors and rows are cut into blocks of bounded size, and every pair of blocks is one cell.  A first
pass keeps, per cell, the best rows of an anchor's own label; merged, they are its positives.  A
second pass knows the score windows that these positives open and keeps, per cell and window, only
the rows that can be among its first negatives.  What is kept of both goes as keys through one
``repartitionAndSortWithinPartitions``: partitioned by anchor, sorted by descending score, positives
before negatives, id.  An iterator then reads each partition once: a positive opens its window, a
negative is given to every open window that reaches down to it, a full window closes.  It holds
at most ``positives`` windows, whatever the number of rows of an anchor.

Scores are integers: components are scaled and rounded down, and products are exact while they
fit 53 bits in floating point, beyond that in 64 bit integers (a sum beyond 64 bits wraps around).

Defined cases: rows with a null id, label or vector or a null or non-finite component take no part;
of rows that share an id the one with the smallest label, then the smallest vector counts; vectors
of unequal length count as filled with zeros; equal scores go by the smaller id; an anchor without
positives or without a row in a window gives no rows for it; a window of a negative positive score is
empty; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotloom.llm.vector_rows import cells, matrix, same_width, usable
from shotloom.session import stage

ROWS, ANCHORS = 1 << 15, 1 << 11   # rows and anchors of a block
SLICE = 1 << 21                    # scores held at a time
SCHEMA = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
_LOW = np.iinfo(np.int64).min


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices."""
    a, b = same_width(a, b)
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if top < 2**53 else a @ b.T


def first_columns(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest allowed scores of each row; of equal ones the earlier columns."""
    n = scores.shape[1]
    k = min(k, n)
    if int(np.abs(scores).max(initial=0)) < 2**62 // max(n, 1):  # score and column fit one number
        key = np.where(allowed, scores * n + (n - 1 - np.arange(n)), _LOW)
        at = np.argpartition(key, n - k, axis=1)[:, n - k:]
    else:
        key = np.where(allowed, scores, _LOW)
        at = n - 1 - np.argsort(key[:, ::-1], axis=1, kind="stable")[:, n - k:]
    row, col = np.repeat(np.arange(len(scores)), k), at.ravel()
    keep = allowed[row, col]
    return row[keep], col[keep]


def _scored(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the anchors with their scores against all rows by id; are ids and labels the same; the ids."""
    ids = rows["id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, labels, right = ids[order], rows["label"].to_numpy()[order], matrix(rows["vec"])[order]
    own, own_label, left = anchors["id"].to_numpy(), anchors["label"].to_numpy(), matrix(anchors["vec"])
    step = max(1, SLICE // max(1, len(ids)))
    for at in range(0, len(own), step):
        part = slice(at, at + step)
        yield part, products(left[part], right), own_label[part, None] == labels, own[part, None] == ids, ids


def _positives(k: int):
    def best(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        if len(anchors) and len(rows):
            own = anchors["id"].to_numpy()
            for part, score, alike, same, ids in _scored(anchors, rows):
                row, col = first_columns(score, alike & ~same, k)
                out.append((own[part][row], ids[col], score[row, col]))
        return pa.table([np.concatenate(x) for x in zip(*out)], ["anchor", "id", "score"])
    return best


def _negatives(k: int, low: int):
    def near(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        if len(anchors) and len(rows):
            own, tops = anchors["id"].to_numpy(), matrix(anchors["tops"])
            many = np.diff(anchors["tops"].combine_chunks().offsets.to_numpy())
            for part, score, alike, _, ids in _scored(anchors, rows):
                wanted = set()
                for j in range(tops.shape[1]):
                    top = np.where(j < many[part], tops[part, j], -1)[:, None]
                    row, col = first_columns(score, ~alike & (score <= top) & (low * top <= 100 * score), k)
                    wanted.update((row * len(ids) + col).tolist())
                at = np.array(sorted(wanted), np.int64)
                row, col = at // len(ids), at % len(ids)
                out.append((own[part][row], ids[col], score[row, col]))
        return pa.table([np.concatenate(x) for x in zip(*out)], ["anchor", "id", "score"])
    return near


def _stream(k: int, low: int):
    """Windows over keys (anchor, -score, is it a negative, id), in this order."""
    def run(keys: Iterable) -> Iterator[tuple]:
        anchor, windows = None, []
        for (a, down, negative, other), _ in keys:
            score = -down
            if a != anchor:
                anchor, windows = a, []
            if not negative:
                windows.append([other, score, 0])
                continue
            windows = [w for w in windows if w[2] < k and low * w[1] <= 100 * score]
            for w in windows:
                w[2] += 1
                yield a, w[0], w[2], other, w[1], score
    return run


def mine_hard_negatives(rows: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding",
                        positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256,
                        row_block: int = ROWS, anchor_block: int = ANCHORS) -> DataFrame:
    """Per anchor and positive the first ``negatives`` rows of other labels with low % to 100 % of its score.

    ``is_anchor`` is a condition over ``id``; ``label`` is an expression over the columns of ``rows``.
    """
    spark = rows.sparkSession
    whole = F.transform("vec", lambda x: F.floor(x * F.lit(float(scale))).cast("bigint"))
    base = stage(usable(rows, id_col, vec_col, label.cast("bigint")).select("id", "label", whole.alias("vec")))
    anchors = base.filter(is_anchor)
    n_rows, n_anchors = (max(1, -(-df.count() // size)) for df, size in ((base, row_block), (anchors, anchor_block)))
    kept = "anchor long, id long, score long"
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    best = stage(cells(anchors, base, n_anchors, n_rows, _positives(positives), kept)
                 .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives).drop("place"))
    tops = best.groupBy(F.col("anchor").alias("id")).agg(F.collect_list("score").alias("tops"))
    near = cells(anchors.join(tops, "id"), base, n_anchors, n_rows, _negatives(negatives, low), kept)
    pairs = best.withColumn("negative", F.lit(0)).unionByName(near.withColumn("negative", F.lit(1)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = pairs.rdd.map(lambda r: ((r["anchor"], -r["score"], r["negative"], r["id"]), None))
    # An odd factor spreads ids that share a divisor.
    dealt = keys.repartitionAndSortWithinPartitions(parts, lambda key: (key[0] * 0x9E3779B97F4A7C15 >> 32) % parts)
    return spark.createDataFrame(dealt.mapPartitions(_stream(negatives, low)), SCHEMA, verifySchema=False)
