"""Packing of short samples, pack offsets, masks and summaries.

First-fit decreasing treats samples of one length alike, and there are at most
``max_length`` lengths.  So the plan is made on counts per (task, length), which is a
bounded table whatever the number of samples, and every sample then finds its pack from
its rank among the samples of its length.  The result is exactly that of packing one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotloom.functions.text import let, running_totals
from shotloom.operators.ordered import CHUNK, attach_stats, rank_in_group
from shotloom.session import stage

_WORD = r"[^ \t\n\r\f]+"
SHORT_TASKS = ("single_shot", "multifield", "ordering", "summary_compress")


def drop_too_long(items: DataFrame, max_length: int) -> tuple[DataFrame, DataFrame]:
    """Items within ``max_length``, and per task the number of all and of too long ones."""
    counts = items.groupBy("task_type").agg(F.count(F.lit(1)).alias("raw_samples"),
                                            F.count_if(F.col("length") > max_length).alias("too_long"))
    return items.filter(F.col("length") <= max_length), counts


class _Bins:
    """Bins in the order they were opened, as runs of equal (free length, samples)."""

    def __init__(self, max_length: int, cap: int):
        self.max_length, self.cap = max_length, cap
        self.free, self.used, self.width = (np.empty(0, dtype=np.int64) for _ in range(3))

    def _fit(self, length: int, free, used):
        room = free // length if length else np.full_like(free, np.iinfo(np.int32).max)
        return np.minimum(room, np.maximum(self.cap - used, 0)) if self.cap else room

    def place(self, length: int, count: int) -> list[tuple[int, int, int]]:
        """Put ``count`` samples into the first bins that fit; (first rank, first bin, samples per bin) per run used."""
        fit = self._fit(length, self.free, self.used)
        start = np.concatenate(([0], np.cumsum(self.width)))[:-1].astype(np.int64)
        able = fit * self.width
        before = np.minimum(np.cumsum(able) - able, count)
        take = np.minimum(able, count - before)
        plan = [(int(before[i]), int(start[i]), int(fit[i])) for i in np.nonzero(take)[0]]
        touched = np.nonzero(take)[0]
        partial = touched[take[touched] < able[touched]]
        whole = touched[take[touched] == able[touched]]
        self.free[whole] -= fit[whole] * length
        self.used[whole] += fit[whole]
        for i in partial[::-1]:
            full, rest = divmod(int(take[i]), int(fit[i]))
            runs = [(self.free[i] - fit[i] * length, self.used[i] + fit[i], full),
                    (self.free[i] - rest * length, self.used[i] + rest, 1 if rest else 0),
                    (self.free[i], self.used[i], self.width[i] - full - (1 if rest else 0))]
            self._replace(int(i), [r for r in runs if r[2] > 0])
        left = count - int(take.sum())
        if left > 0:
            opened = int(self.width.sum())
            per = int(self._fit(length, np.array([self.max_length]), np.array([0]))[0])
            per = max(1, min(per, left))
            plan.append((count - left, opened, per))
            full, rest = divmod(left, per)
            runs = [(self.max_length - per * length, per, full)] + ([(self.max_length - rest * length, rest, 1)] if rest else [])
            for free, used, width in runs:
                self.free, self.used = np.append(self.free, free), np.append(self.used, used)
                self.width = np.append(self.width, width)
        return plan

    def _replace(self, i: int, runs: list[tuple[int, int, int]]) -> None:
        for name, k in (("free", 0), ("used", 1), ("width", 2)):
            old = getattr(self, name)
            setattr(self, name, np.concatenate((old[:i], [int(r[k]) for r in runs], old[i + 1:])).astype(np.int64))


def ffd_plan(histogram: DataFrame, max_length: int, max_samples: int = 0) -> DataFrame:
    """histogram(task_type, length, n) → task_type, length, plan: where the samples of a length go, by rank."""
    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, rows = _Bins(max_length, max_samples), []
        for length, n in pdf.sort_values("length", ascending=False)[["length", "n"]].itertuples(index=False):
            steps = bins.place(int(length), int(n))
            rows.append((pdf["task_type"].iloc[0], length, [{"rank": r, "bin": b, "per": p} for r, b, p in steps]))
        return pd.DataFrame(rows, columns=["task_type", "length", "plan"])

    return histogram.groupBy("task_type").applyInPandas(
        plan, "task_type string, length bigint, plan array<struct<rank:bigint,bin:bigint,per:bigint>>")


def assign_packs(items: DataFrame, max_length: int, max_samples: int = 0,
                 short_tasks: Sequence[str] = SHORT_TASKS) -> DataFrame:
    """items(sample_index, task_type, length) within ``max_length`` → with ``pack``, a number per task.

    A task that is not short keeps one sample per pack.
    """
    short = items.filter(F.col("task_type").isin(*short_tasks)).withColumn("length", F.col("length").cast("bigint"))
    histogram = short.groupBy("task_type", "length").agg(F.count(F.lit(1)).alias("n"))
    plan = stage(ffd_plan(histogram, max_length, max_samples))
    ranked = rank_in_group(short, ["task_type", "length"], [F.col("sample_index")], F.floor(F.col("sample_index") / CHUNK), "r")
    planned = attach_stats(ranked, plan, ["task_type", "length"])
    step = F.element_at(F.filter("plan", lambda s: s["rank"] <= F.col("r")), -1)
    pack = step["bin"] + F.floor((F.col("r") - step["rank"]) / step["per"])
    columns = ["sample_index", "task_type", "length", "pack"]
    alone = items.filter(~F.col("task_type").isin(*short_tasks)).select(
        "sample_index", "task_type", F.col("length").cast("bigint").alias("length"), F.col("sample_index").alias("pack"))
    return planned.withColumn("pack", pack).select(*columns).unionByName(alone)


def ffd_pack(items: DataFrame, max_length: int = 8192, max_samples: int = 0,
             short_tasks: Sequence[str] = SHORT_TASKS) -> DataFrame:
    """task_type, pack, sample_indices (ascending), total_length, first_index; a pack is at most ``max_length`` long."""
    kept = items.filter(F.col("length") <= max_length)
    return assign_packs(kept, max_length, max_samples, short_tasks).groupBy("task_type", "pack").agg(
        F.array_sort(F.collect_list("sample_index")).alias("sample_indices"), F.sum("length").alias("total_length"),
        F.min("sample_index").alias("first_index"))


def pack_summary(counts: DataFrame, packs: DataFrame, max_length: int) -> DataFrame:
    """Per task and over all: samples, packs, savings, sizes and fill; a task without packs gets zeros.

    counts(task_type, raw_samples, too_long), packs(task_type, n, total_length).
    """
    grouped = packs.groupBy("task_type").agg(
        F.count(F.lit(1)).alias("packed_items"), F.count_if(F.col("n") > 1).alias("multi_sample_packs"),
        F.max("n").alias("max_pack_size"), F.sum("total_length").alias("_tokens"),
        F.max("total_length").alias("max_pack_length"))
    joined = counts.join(grouped, "task_type", "left").na.fill(0)
    packed = F.col("packed_items")
    tasks = joined.select(
        "task_type", "raw_samples", "packed_items", F.when(packed > 0, F.col("raw_samples") - packed).otherwise(0).alias("saved_items"),
        F.col("too_long").alias("too_long_singletons"), "multi_sample_packs",
        F.coalesce(F.try_divide(F.col("raw_samples"), packed), F.lit(0.0)).alias("avg_pack_size"), "max_pack_size",
        F.coalesce(F.try_divide(F.col("_tokens"), packed * max_length), F.lit(0.0)).alias("avg_pack_fill_ratio"), "max_pack_length")
    overall = tasks.agg(*[F.sum(c).alias(c) for c in ("raw_samples", "packed_items", "multi_sample_packs")]).select(
        F.lit("(all)").alias("task_type"), "raw_samples", "packed_items",
        (F.col("raw_samples") - F.col("packed_items")).alias("saved_items"), "multi_sample_packs")
    return tasks.unionByName(overall, allowMissingColumns=True)


def pack_offsets(members: DataFrame) -> DataFrame:
    """members(task_type, pack, sample_index, length) → place and start of each sample in its concatenated pack."""
    w = Window.partitionBy("task_type", "pack").orderBy("sample_index")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return members.withColumn("place", F.row_number().over(w) - 1).withColumn(
        "offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def completion_mask(ends: Column, response_start: Column) -> Column:
    """1 for tokens whose end offset lies beyond the start of the response."""
    return F.transform(ends, lambda e: (e > response_start).cast("int"))


def word_ends(text: Column) -> Column:
    """End offsets of white-space tokens, for corpora without tokenizer offsets."""
    def ends(words: Column) -> Column:
        gaps = F.slice(F.split(text, _WORD, -1), F.lit(1), F.size(words))
        steps = F.zip_with(gaps, words, lambda g, w: (F.length(g) + F.length(w)).cast("bigint"))
        return F.transform(running_totals(steps), lambda n: n.cast("int"))

    return let(F.coalesce(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.array().cast("array<string>")), ends)
