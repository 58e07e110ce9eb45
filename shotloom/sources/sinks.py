"""Sinks: documents, manifests and partitioned tables.  Spark's commit protocol publishes each write at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.session import shared_dir


def new_path(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def hard_negative_documents(negatives: DataFrame) -> DataFrame:
    """anchor, negs: the ordered id list of each anchor, at most top-k long."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "neg")))
    return negatives.groupBy("anchor").agg(F.transform(ordered, lambda x: x["neg"]).alias("negs"))


def write_presample(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Presample table partitioned by parameter combination; only the partitions present are replaced."""
    path = path or new_path(rows.sparkSession, "presample")
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("num_neg", "infonce_neg").parquet(path))
    return rows.sparkSession.read.parquet(path)


def write_manifest_errors(inputs: DataFrame, manifest: DataFrame, errors: DataFrame, path: str) -> None:
    """Manifest and error lines as JSONL below ``path``; ``inputs`` should be staged, as both read it."""
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    errors.write.mode("overwrite").json(f"{path}/errors")


def write_documents(documents: DataFrame, path: str, by: str = "source_file") -> None:
    """One line per sample, one folder per source."""
    documents.write.mode("overwrite").partitionBy(by).text(path)


def append_runs(rows: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """Append run rows under a fixed column order; read back all of them."""
    rows.select(*columns).write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(rows.select(*columns).schema).parquet(path)


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite only the partitions present in ``rows``."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))
