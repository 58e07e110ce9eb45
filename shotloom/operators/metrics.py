"""Ranking metrics, contrastive losses, run leaderboards and corpus statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotloom.functions import vectors as V
from shotloom.operators.pairs import BLOCK, SIM_SCALE, block_join, quantise, unit_rows
from shotloom.session import stage

SLICE = 512


def corpus_distribution(rows: DataFrame) -> DataFrame:
    """rows(split, drama, episode), one per frame → episodes, frames and episodes per drama for each split."""
    episodes = rows.groupBy("split", "drama", "episode").agg(F.count(F.lit(1)).alias("frames"))
    dramas = episodes.groupBy("split", "drama").agg(F.count(F.lit(1)).alias("eps"), F.sum("frames").alias("frames"))
    return dramas.groupBy("split").agg(F.sum("eps").alias("episodes"), F.sum("frames").alias("frames"),
                                       F.min("eps").alias("min_episodes"), F.max("eps").alias("max_episodes"))


# ---------------------------------------------------------------- recall

def ranks_in_batch(pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """pairs(batch, id, text, image) → id, rank, pos (own similarity × 1e7).

    The rank of the own image is one plus the number of better images of the batch.  Blocks
    of a batch count on their own and the counts add up, so a batch may be of any size.
    """
    ids = pairs.schema["id"].dataType.simpleString()
    eps = 1e-12
    own = F.round(V.dot(V.l2_normalize(F.col("text"), eps), V.l2_normalize(F.col("image"), eps)) * SIM_SCALE).cast("bigint")
    left = pairs.select("batch", "id", "text", own.alias("pos"))
    right = pairs.select("batch", F.col("id").alias("other"), "image")

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"id": [], "pos": [], "better": []})]
        if not (a.empty or b.empty):
            images, other = unit_rows(b["image"], eps), b["other"].to_numpy()
            for s in range(0, len(a), SLICE):
                part = a.iloc[s:s + SLICE]
                q, me, pos = quantise(unit_rows(part["text"], eps) @ images.T), part["id"].to_numpy(), part["pos"].to_numpy()
                better = (q > pos[:, None]) | ((q == pos[:, None]) & (other[None, :] < me[:, None]))
                better &= other[None, :] != me[:, None]
                parts.append(pd.DataFrame({"id": me, "pos": pos, "better": better.sum(axis=1)}))
        return pd.concat(parts, ignore_index=True)

    counts = block_join(left, right, ["batch"], "id", "other", count, f"id {ids}, pos bigint, better bigint", block)
    return counts.groupBy("id").agg((F.sum("better") + 1).alias("rank"), F.any_value("pos").alias("pos"))


def recall_at_k(pairs: DataFrame, ks: Sequence[int] = (1, 5, 10, 20), block: int = BLOCK) -> DataFrame:
    """One row: share of texts whose own image ranks within k in its batch, and the mean own similarity."""
    r = ranks_in_batch(pairs, block)
    return r.agg(F.count(F.lit(1)).alias("n"), *[F.avg((F.col("rank") <= k).cast("double")).alias(f"recall_{k}") for k in ks],
                 F.avg(F.col("pos") / SIM_SCALE).alias("mean_pos_score"))


# ---------------------------------------------------------------- losses

def contrastive_loss(candidates: DataFrame, temperature: float = 0.07) -> DataFrame:
    """candidates(anchor, direction, sim, positive) → anchor, direction, loss.

    Cross entropy of the positive among an anchor's candidates, shifted by the maximum.  An
    anchor's list is as long as its draw of negatives.
    """
    w = Window.partitionBy("anchor", "direction")
    logit = F.col("sim") / temperature
    shifted = candidates.withColumn("_l", logit).withColumn("_m", F.max("_l").over(w))
    return shifted.groupBy("anchor", "direction").agg(
        (F.max("_m") + F.log(F.sum(F.exp(F.col("_l") - F.col("_m")))) - F.max(F.when(F.col("positive"), F.col("_l"))))
        .alias("loss"))


def negative_candidates(shots: DataFrame, negatives: DataFrame) -> DataFrame:
    """Candidates in both directions: text against images and image against texts.

    shots(shot_id, text, image) with unit vectors, negatives(anchor, neg).  Either way the text travels to the
    image, as it is the vector with more zeros; the pairs are written once and read from both ends.
    """
    negatives = stage(negatives.select("anchor", "neg"))

    def texts(key: str) -> DataFrame:
        return shots.select(F.col("shot_id").alias(key), F.col("text").alias("_t"))

    def images(key: str) -> DataFrame:
        return shots.select(F.col("shot_id").alias(key), F.col("image").alias("_i"))

    def sims(text: str, image: str, direction: str) -> DataFrame:
        return negatives.join(texts(text), text).join(images(image), image).select(
            "anchor", F.lit(direction).alias("direction"), V.dot(F.col("_t"), F.col("_i")).alias("sim"),
            F.lit(False).alias("positive"))

    own = shots.select(F.col("shot_id").alias("anchor"), F.explode(F.array(F.lit("t2i"), F.lit("i2t"))).alias("direction"),
                       V.dot(F.col("text"), F.col("image")).alias("sim"), F.lit(True).alias("positive"))
    return own.unionByName(sims("anchor", "neg", "t2i")).unionByName(sims("neg", "anchor", "i2t"))


def in_batch_loss(pairs: DataFrame, temperature: float = 0.07, block: int = BLOCK) -> DataFrame:
    """pairs(batch, id, text, image) → batch, n, loss: symmetric, every other member of the batch is a negative.

    Blocks return the maximum and the shifted sum per anchor, which merge into the log-sum-exp.
    """
    ids = pairs.schema["id"].dataType.simpleString()
    batches = pairs.schema["batch"].dataType.simpleString()
    eps = 1e-12
    own = V.dot(V.l2_normalize(F.col("text"), eps), V.l2_normalize(F.col("image"), eps)) / temperature
    total = None
    for direction, mine, theirs in (("t2i", "text", "image"), ("i2t", "image", "text")):
        left = pairs.select("batch", "id", F.col(mine).alias("mine"), own.alias("pos"))
        right = pairs.select("batch", F.col("id").alias("other"), F.col(theirs).alias("theirs"))

        def partial(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            parts = [pd.DataFrame({"batch": [], "id": [], "pos": [], "m": [], "s": []})]
            if not (a.empty or b.empty):
                targets = unit_rows(b["theirs"], eps)
                for at in range(0, len(a), SLICE):
                    part = a.iloc[at:at + SLICE]
                    logits = unit_rows(part["mine"], eps) @ targets.T / temperature
                    m = logits.max(axis=1)
                    parts.append(part[["batch", "id", "pos"]].assign(m=m, s=np.exp(logits - m[:, None]).sum(axis=1)))
            return pd.concat(parts, ignore_index=True)

        blocks = block_join(left, right, ["batch"], "id", "other", partial,
                            f"batch {batches}, id {ids}, pos double, m double, s double", block)
        w = Window.partitionBy("batch", "id")
        merged = blocks.withColumn("_m", F.max("m").over(w)).groupBy("batch", "id").agg(
            (F.max("_m") + F.log(F.sum(F.col("s") * F.exp(F.col("m") - F.col("_m")))) - F.max("pos")).alias("loss"))
        merged = merged.withColumn("direction", F.lit(direction))
        total = merged if total is None else total.unionByName(merged)
    return total.groupBy("batch").agg((F.count(F.lit(1)) / 2).cast("bigint").alias("n"), F.avg("loss").alias("loss"))


def loss_report(hard: DataFrame, infonce: DataFrame, lambda_hard: float = 1.0, lambda_infonce: float = 1.0) -> DataFrame:
    """One row: mean symmetric losses and their weighted sum."""
    none = F.lit(None).cast("double")
    both = hard.select(F.col("loss").alias("h"), none.alias("i")).union(infonce.select(none, F.col("loss")))
    total = lambda_infonce * F.col("infonce_loss") + lambda_hard * F.col("hard_loss")
    return (both.agg(F.avg("h").alias("hard_loss"), F.avg("i").alias("infonce_loss"))
            .select("hard_loss", "infonce_loss", total.alias("total")))


def bce(p: Column, y: Column) -> Column:
    """Binary cross entropy; logarithms are limited to −100 from below."""
    def log(x: Column) -> Column:
        return F.greatest(F.coalesce(F.log(F.when(x > 0, x)), F.lit(-100.0)), F.lit(-100.0))

    return -(y * log(p) + (1.0 - y) * log(1.0 - p))


# ---------------------------------------------------------------- runs

def grid_leaderboard(runs: DataFrame, metric: str, top: int = 10) -> DataFrame:
    """Finished runs by falling metric, best first; ties by signature and sequence."""
    order = [F.desc(metric), F.col("signature"), F.col("seq")]
    best = runs.filter((F.col("status") == "done") & F.col(metric).isNotNull()).orderBy(*order).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # at most ``top`` rows
