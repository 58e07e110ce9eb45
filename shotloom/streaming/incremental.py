"""Incremental work with Structured Streaming.

Each micro-batch writes its own ``batch_id`` partition with dynamic overwrite, so a batch
that is replayed after a failure replaces what it wrote and nothing is done twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from shotloom.operators.ledger import pending_work
from shotloom.operators.rewards import negative_episodes, reward_completions
from shotloom.session import stage


def file_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", pattern: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def read_log(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of all batches; empty before the first batch."""
    full = StructType([*schema.fields, StructField("batch_id", LongType())])
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    exists = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(full).parquet(path) if exists else spark.createDataFrame([], full)


def _write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    (rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def start_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run ``handle`` over everything available, then stop; a later start takes up where this ended."""
    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_pending(inputs: DataFrame, keys: Sequence[str], work: Callable[[DataFrame], DataFrame], output: str,
                   checkpoint: str, finished: DataFrame | None = None) -> StreamingQuery:
    """Run ``work`` once per key on inputs that neither ``finished`` nor an earlier batch has covered.

    The keys seen so far are the state of the stream, split by key; a batch looks up its own keys there and
    never reads what earlier batches wrote.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        todo = stage(batch)  # the state is read once
        _write_batch(work(pending_work(todo, finished, keys) if finished is not None else todo), batch_id, output)

    return start_batches(inputs.dropDuplicates(list(keys)), handle, checkpoint)


def stream_rewards(completions: DataFrame, episode_vectors: DataFrame, embed: Callable, judge: Callable, output: str,
                   checkpoint: str, carry: Sequence[str] = ("step",), key: str = "completion",
                   negatives: DataFrame | None = None, sums: str | None = None, step: str = "step", **options) -> StreamingQuery:
    """Score completions as they arrive and append them to the log at ``output``.

    ``sums`` is a folder for the sums per training step of each batch, which ``merge_steps`` adds up: a report costs
    a row per step and batch, and a replayed batch replaces its own sums.

    A score depends on the completion and static tables alone, so a batch gives what the batch
    job gives.  The contrast episodes are chosen once, from all episodes; a batch reads only the
    frames of its own episodes and of those they are contrasted with.
    """
    episode = ["drama", "episode"]
    pairs = negatives if negatives is not None else stage(negative_episodes(episode_vectors, options.get("seed", 0)))

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = stage(batch)
        own = rows.select(*episode).distinct()
        against = pairs.join(own, episode, "left_semi").select(F.col("neg_drama").alias("drama"), F.col("neg_episode").alias("episode"))
        frames = episode_vectors.join(own.unionByName(against).distinct(), episode, "left_semi")
        scored = reward_completions(rows, frames, embed, judge, key=key, negatives=pairs, **options)
        _write_batch(scored.join(rows.select(key, *carry), key), batch_id, output)
        if sums is not None:
            written = batch.sparkSession.read.parquet(f"{output}/batch_id={batch_id}")
            _write_batch(step_sums(written, step), batch_id, sums)

    return start_batches(completions, handle, checkpoint)


def step_sums(log: DataFrame, step: str = "step") -> DataFrame:
    """Completions and sums of reward, format reward and shots per training step."""
    return log.groupBy(step).agg(F.count(F.lit(1)).alias("completions"), *[F.sum(c).alias(c) for c in ("reward", "r_format", "n_shots")])


def merge_steps(sums: DataFrame, step: str = "step") -> DataFrame:
    """Mean reward and parts per training step, from ``step_sums`` of any number of batches."""
    n = F.sum("completions")
    return sums.groupBy(step).agg(n.alias("completions"), (F.sum("reward") / n).alias("reward"),
                                  (F.sum("r_format") / n).alias("r_format"), F.sum("n_shots").alias("n_shots"))


def step_report(log: DataFrame, step: str = "step") -> DataFrame:
    """``merge_steps`` of a whole log."""
    return merge_steps(step_sums(log, step), step)
