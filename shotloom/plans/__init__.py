"""Importing this package fills the query registry."""

import importlib

from shotloom.plans.registry import ORACLES, QUERIES

for _module in ("vector_queries", "frame_queries", "negative_queries", "corpus_queries", "text_queries", "reward_queries",
                "packaging_queries", "packing_queries", "metric_queries", "stream_queries", "file_queries"):
    importlib.import_module(f"shotloom.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
