"""Group-wise vector similarity without emitting pairs.

Both sides of a group are cut into blocks of bounded size.  A task scores one block
against one block with a matrix product and emits only a bounded summary per anchor
(top-k, a count per bin), so no group is collected whole and no row per pair exists.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotloom.operators.ordered import attach_stats
from shotloom.session import stage

BLOCK = 4096
MOST_CELLS = 1024        # pivots that go to every task
ERROR = 1e-9             # more than a matrix product or an angle can be off
SIM_SCALE = 10_000_000   # similarities are compared at 1e-7, the precision of a float32 product
RADIX = 272              # RADIX ** 3 covers the 2 * SIM_SCALE + 1 values a similarity can take
LEVELS = (RADIX * RADIX, RADIX, 1)


def unit_rows(vectors: Sequence[np.ndarray], eps: float = 1e-8) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), eps)


def quantise(sims: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(sims * SIM_SCALE), -SIM_SCALE, SIM_SCALE).astype(np.int64)


def block_join(left: DataFrame, right: DataFrame, group: Sequence[str], left_key: str, right_key: str,
               fn: Callable, schema: str, block: int = BLOCK, right_sizes: DataFrame | None = None,
               left_block: int | None = None, left_most: int | None = None) -> DataFrame:
    """Call ``fn(left_block, right_block)`` for every pair of blocks in a group.

    A row is copied once per block of the other side; block counts come from group sizes, so a
    group that fits one block is not copied at all.  Without a group both sides are counted once
    and rows find their blocks by themselves.  ``right_sizes`` are the group sizes ``_n`` of the right side,
    where they are known; ``left_block`` bounds blocks of the left side where they differ.  With ``left_most``
    a group has no more left blocks than that, each larger instead, so that the copies of the right side
    do not grow with the group.
    """
    group = list(group)

    left_block = left_block or block

    def sized(df: DataFrame, name: str, most: int) -> DataFrame:
        return df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))

    if group:
        others = (sized(right, "_nr", block) if right_sizes is None else
                  right_sizes.select(*group, F.ceil(F.col("_n") / block).cast("int").alias("_nr")))
        # Written, so that the planner knows how small it is and need not shuffle the vectors for it.
        mine = sized(left, "_nl", left_block)
        if left_most is not None:
            mine = mine.withColumn("_nl", F.least("_nl", F.lit(left_most)))
        sizes = stage(mine.join(others, group))
    else:
        n_left, n_right = (max(1, -(-df.count() // most)) for df, most in ((left, left_block), (right, block)))

    def with_sizes(df: DataFrame) -> DataFrame:
        if group:
            return attach_stats(df, sizes, group)
        return df.withColumns({"_nl": F.lit(n_left), "_nr": F.lit(n_right)})

    def place(df: DataFrame, key: str, own: str, other: str, own_n: str, other_n: str) -> DataFrame:
        return (with_sizes(df)
                .withColumn(own, F.pmod(F.xxhash64(key), F.col(own_n)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)))
                .drop("_nl", "_nr"))

    keys = [*group, "_lb", "_rb"]
    a = place(left, left_key, "_lb", "_rb", "_nl", "_nr")
    b = place(right, right_key, "_rb", "_lb", "_nr", "_nl")
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # both sides may stem from one table
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(fn, schema)


def places(ids: np.ndarray) -> np.ndarray:
    """The place of each id in their order."""
    order = np.empty(len(ids), np.int64)
    order[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    return order


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first component to the last: equal rows give equal sums anywhere."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def best_rows(left: np.ndarray, right: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left row, right row and score of the ``k`` best right rows per left row; ties go by ``order``.

    A matrix product finds what can be among them within its error; only that is summed exactly.
    """
    rough = left @ right.T
    n = rough.shape[1]
    least = np.partition(rough, n - k, axis=1)[:, n - k, None] if n > k else np.full((len(left), 1), -np.inf)
    row, col = np.nonzero(rough >= least - ERROR)
    score = exact_products(left[row], right[col])
    by = np.lexsort((order[col], -score, row))
    row, col, score = row[by], col[by], score[by]
    many = np.bincount(row, minlength=len(left))
    keep = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) < k
    return row[keep], col[keep], score[keep]


def _pivots(df: DataFrame, key: str, vec: str, n: int) -> np.ndarray:
    """``n`` vectors, at most MOST_CELLS, that fall first in a hashed order of their keys."""
    rows = df.select(vec).orderBy(F.xxhash64(F.col(key).cast("string")), vec).limit(n).collect()
    return unit_rows([r[0] for r in rows], 1e-12) if rows else np.zeros((1, 1))


def _angles(vectors: pd.Series, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit_rows(vectors, 1e-12) @ pivots.T, -1.0, 1.0))


def cells_of(right: DataFrame, group: Sequence[str], vec: str, pivots: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """``right`` with the cell of its nearest pivot, and the radius of every cell of a group."""
    @F.pandas_udf("struct<cell int, angle double>")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        if not len(vectors):
            return pd.DataFrame({"cell": pd.Series([], dtype="int32"), "angle": pd.Series([], dtype="float64")})
        angle = _angles(vectors, pivots)
        return pd.DataFrame({"cell": angle.argmin(axis=1).astype("int32"), "angle": angle.min(axis=1)})

    rows = stage(right.withColumn("_at", nearest(vec)).select(*right.columns, F.col("_at.cell").alias("_cell"), F.col("_at.angle").alias("_angle")))
    return rows.drop("_angle"), stage(rows.groupBy(*group, "_cell").agg(F.max("_angle").alias("_radius")))


def visits(left: DataFrame, cells: DataFrame, group: Sequence[str], key: str, vec: str, pivots: np.ndarray) -> DataFrame:
    """Keys of left rows with the cells of their group: the best similarity that a cell can hold, and its turn by that.

    A vector at angle a from a pivot is at least a - r from all that lie within r of it.
    """
    @F.pandas_udf("array<double>")
    def angles(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(_angles(vectors, pivots)) if len(vectors) else [], dtype="object")

    near = left.select(*group, key, angles(vec).alias("_angles"))
    if group:
        near = near.join(cells, list(group))
    else:  # at most MOST_CELLS cells, one row of them
        few = F.broadcast(cells.agg(F.collect_list(F.struct("_cell", "_radius")).alias("_all")).withColumn("_one", F.lit(1)))
        near = near.withColumn("_one", F.lit(1)).join(few, "_one").withColumn("_c", F.explode("_all")).select(
            *near.columns, "_c.*")
    apart = F.get("_angles", F.col("_cell")) - F.col("_radius") - ERROR
    bound = F.cos(F.least(F.greatest(apart, F.lit(0.0)), F.lit(float(np.pi)))) + ERROR
    best = F.row_number().over(Window.partitionBy(*group, key).orderBy(F.desc("_bound"), "_cell"))
    return near.select(*group, key, "_cell", bound.alias("_bound")).withColumn("_turn", best)


def block_topk(left: DataFrame, right: DataFrame, group: Sequence[str], left_id: str, left_vec: str, right_id: str,
               right_vec: str, k: int, id_type: str = "string", right_type: str = "string", slice_rows: int = 512,
               block: int = BLOCK) -> DataFrame:
    """left_id, right_id, score (cosine), rank: the k best right rows of the group per left row, ties by id.

    A left row meets a group of up to ``block`` right rows at once.  A larger right side is cut into as many cells
    as it has blocks, each around one of its own vectors.  A left row first meets the cell that can hold its best
    match; the k-th score found there rules out every cell whose bound is lower, and it meets only the rest.
    Scores are full doubles, so the result is that of all pairs.
    """
    group = list(group)
    schema = f"{left_id} {id_type}, {right_id} {right_type}, score double"
    w = Window.partitionBy(left_id).orderBy(F.desc("score"), right_id)

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def local(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({left_id: [], right_id: [], "score": []})]
        if not (a.empty or b.empty):
            targets, ids = unit_rows(b[right_vec], 1e-12), b[right_id].to_numpy()
            order = places(ids)
            for s in range(0, len(a), slice_rows):
                part = a.iloc[s:s + slice_rows]
                row, col, score = best_rows(unit_rows(part[left_vec], 1e-12), targets, order, k)
                out.append(pd.DataFrame({left_id: part[left_id].to_numpy()[row], right_id: ids[col], "score": score}))
        return pd.concat(out[1:] or out, ignore_index=True)

    direct = None
    if group:
        sizes = stage(right.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")))
        large = sizes.filter(F.col("_n") > block).select(*group)
        if large.isEmpty():
            return ranked(block_join(left, right, group, left_id, right_id, local, schema, block, sizes))
        few = [side.join(large, group, "left_anti") for side in (left, right)]
        direct = block_join(*few, group, left_id, right_id, local, schema, block)
        left, right = (side.join(large, group, "left_semi") for side in (left, right))
    pivots = _pivots(right, right_id, right_vec, max(1, min(MOST_CELLS, -(-right.count() // block))))
    placed, cells = cells_of(right, group, right_vec, pivots)

    def met(some: DataFrame) -> DataFrame:
        rows = left.join(some.select(*group, left_id, "_cell"), [*group, left_id])
        return block_join(rows, placed, [*group, "_cell"], left_id, right_id, local, schema, block)

    every = stage(visits(left, cells, group, left_id, left_vec, pivots))
    found = stage(met(every.filter("_turn = 1")))
    floor = found.groupBy(left_id).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_floor")).filter(F.col("_n") >= k)
    rest = every.filter("_turn > 1").join(floor.drop("_n"), left_id, "left")
    rest = rest.filter(F.col("_floor").isNull() | (F.col("_bound") >= F.col("_floor")))
    merged = found.unionByName(met(rest))
    return ranked(merged if direct is None else merged.unionByName(direct))
