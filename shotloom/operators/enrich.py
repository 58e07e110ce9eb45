"""Batched calls of a user function over distinct payloads."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.session import stage


def enrich_memoised(df: DataFrame, payload: str, fn: Callable[[Sequence[str]], Sequence], result_type: str,
                    batch: int = 16, retries: int = 3, delay: float = 0.0, memo: DataFrame | None = None,
                    default: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Add ``result`` and ``error``; return the rows and the memo table (payload, result, error).

    Each distinct payload not in ``memo`` is sent once, ``batch`` at a time, with up to
    ``retries`` attempts and a delay that grows with each.  A batch that still fails gives
    the default and an error.  The answers are written before they are joined back, so
    no lost executor or second read repeats a call.
    A payload of very many rows is a skewed join, which Spark splits by itself.
    """
    def call(items: list[str]) -> tuple[list, str | None]:
        error = None
        for attempt in range(1, retries + 1):
            try:
                answers = list(fn(items))
                if len(answers) != len(items):
                    raise ValueError(f"{len(answers)} results for {len(items)} payloads")
                return answers, None
            except Exception as exc:
                error = f"{type(exc).__name__}: {exc}"
                if attempt < retries:
                    time.sleep(delay * attempt)
        return [None] * len(items), error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            items = frame["payload"].tolist()
            for s in range(0, len(items), batch):
                part = items[s:s + batch]
                answers, error = call(part)
                yield pd.DataFrame({"payload": part, "result": answers, "error": [error] * len(part)})

    wanted = df.select(F.col(payload).alias("payload")).filter(F.col("payload").isNotNull()).distinct()
    known = memo.select("payload", "result", "error").filter(F.col("error").isNull()) if memo is not None else None
    todo = wanted.join(known, "payload", "left_anti") if known is not None else wanted
    answers = stage(todo.mapInPandas(run, f"payload string, result {result_type}, error string"))
    table = answers if known is None else known.unionByName(answers)
    # Digests stand for the payloads, so that neither side sends texts that nobody asks for.
    back = table.select(F.sha2("payload", 256).alias("_h"), "result", "error")
    rows = df.withColumn("_h", F.sha2(payload, 256)).join(back, "_h", "left").drop("_h")
    if default is not None:
        rows = rows.withColumn("result", F.coalesce("result", default))
    return rows, table
