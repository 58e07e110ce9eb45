"""Streams over the same tables; each equals its batch query."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shotloom.functions.vectors import r6
from shotloom.operators.rewards import negative_episodes
from shotloom.plans import bindings as B
from shotloom.plans.bindings import sql
from shotloom.plans.registry import query
from shotloom.plans.reward_queries import END_TO_END, SEED, _frames, stub_embed, stub_judge
from shotloom.session import stage
from shotloom.sources.sinks import new_path
from shotloom.streaming import incremental as S


def dealt_files(table, spark, name, key, shares):
    """The table in several shares, which a stream takes one by one; a share is a file per core, so no task holds one whole."""
    path, cores = new_path(spark, name), spark.sparkContext.defaultParallelism
    table.repartition(shares * cores, key).write.parquet(path)
    return S.file_stream(spark, path, table.schema, files_per_batch=cores)


@query("stream_pending", sql("""
    select distinct task from ledger where task not in (select task from ledger where status = 'SUCCESS' and event_no % 3 <> 0)"""))
def _pending(spark, sf):
    orders = B.table(spark, sf, "orders").select(F.col("o_custkey").alias("task"), "o_orderkey")
    tasks = dealt_files(orders, spark, "orders", "o_orderkey", 4).select("task")
    finished = B.ledger(spark, sf).filter("status = 'SUCCESS' and event_no % 3 <> 0").select("task")
    out, result = new_path(spark, "pending"), StructType().add("task", orders.schema["task"].dataType)
    S.stream_pending(tasks, ["task"], lambda df: df, out, new_path(spark, "checkpoint"), finished).awaitTermination()
    return S.read_log(spark, out, result).select("task")


# Sums are made of unrounded scores, so the twin keeps more digits before it averages.
@query("stream_rewards", sql(f"""with r as ({END_TO_END.replace(", 6)", ", 12)")})
    select completion % 20 as step, count(*) as completions, round(avg(x), 6) as reward, round(avg(f), 6) as r_format, sum(n_shots)::bigint as n_shots
    from (select *, reward as x, r_format as f from r) group by 1"""))
def _rewards(spark, sf):
    docs = dealt_files(B.table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), spark, "documents", "doc_id", 2)
    plots = B.plots(spark, sf)
    m = B.outputs_of(docs, plots)
    c = m.select(F.col("sample_index").alias("completion"), (F.col("sample_index") % 20).alias("step"), (F.col("sample_index") % 10).alias("drama"),
                 (F.floor(F.col("sample_index") / 10) % 3).alias("episode"), F.col("model_output").alias("text"))
    frames = stage(_frames(spark, sf))
    out, sums = new_path(spark, "rewards"), new_path(spark, "sums")
    negatives = stage(negative_episodes(frames, SEED))
    S.stream_rewards(c, frames, stub_embed, stub_judge, out, new_path(spark, "checkpoint"), seed=SEED, negatives=negatives,
                     sums=sums).awaitTermination()
    return S.merge_steps(spark.read.parquet(sums)).select("step", "completions", r6(F.col("reward")).alias("reward"), r6(
        F.col("r_format")).alias("r_format"), F.col("n_shots").cast("bigint").alias("n_shots"))
