"""Work that is pending, in flight, done or stale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.functions.fixed_text import RUNNING_STATES, SUCCESS_STATES


def pending_work(inputs: DataFrame, outputs: DataFrame, keys: Sequence[str], valid: Column | None = None) -> DataFrame:
    """Inputs without an output; an output that fails ``valid`` counts as none."""
    done = outputs if valid is None else outputs.filter(valid)
    return inputs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def latest_events(events: DataFrame, order: Sequence[str], key: str = "task") -> DataFrame:
    """Last event per task and whether any succeeded; combined before the shuffle, so a busy task is cheap."""
    return events.groupBy(key).agg(
        F.max(F.struct(*order, "status"))["status"].alias("last_status"),
        F.max(F.upper("status").isin(*SUCCESS_STATES)).alias("has_result"), F.count(F.lit(1)).alias("events"))


def task_ledger_actions(tasks: DataFrame, events: DataFrame, order: Sequence[str], key: str = "task") -> DataFrame:
    """skip a task that has a result, resume one that is running, submit the others."""
    last = latest_events(events, order, key)
    action = (F.when(F.coalesce("has_result", F.lit(False)), "skip")
              .when(F.upper("last_status").isin(*RUNNING_STATES), "resume").otherwise("submit"))
    return (tasks.join(last, key, "left")
            .select(key, F.coalesce("events", F.lit(0)).alias("events"), "last_status", action.alias("action")))


def task_outcomes(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("events").alias("events"),
        F.count_if(F.col("last_status") == "SUCCESS").alias("success"),
        F.count_if(F.col("last_status") == "FAILED").alias("error"))


def stale_partitions(current: DataFrame, stored: DataFrame, keys: Sequence[str], versions: Sequence[str]) -> DataFrame:
    """Keys whose stored version columns differ from the current ones, or that are not stored."""
    old = stored.select(*keys, *[F.col(v).alias(f"_old_{v}") for v in versions])
    same = F.lit(True)
    for v in versions:
        same = same & F.col(v).eqNullSafe(F.col(f"_old_{v}"))
    joined = current.join(old.withColumn("_stored", F.lit(True)), list(keys), "left")
    reason = F.when(F.col("_stored").isNull(), "absent").when(~same, "changed")
    return joined.withColumn("reason", reason).filter("reason is not null").select(*keys, *versions, "reason")
