"""Nearest shots for a query, and the package of rows made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.operators.pairs import BLOCK, block_topk


def retrieve_topk(queries: DataFrame, index: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """queries(query_id, vec) × index(item_id, vec) → query_id, item_id, score, rank."""
    left, right = queries.select("query_id", "vec"), index.select("item_id", F.col("vec").alias("item_vec"))
    found = block_topk(left, right, [], "query_id", "vec", "item_id", "item_vec", k,
                       queries.schema["query_id"].dataType.simpleString(),
                       index.schema["item_id"].dataType.simpleString(), block=block)
    return found.select("query_id", "item_id", "score", "rank")
