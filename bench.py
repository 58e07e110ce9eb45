"""Wall-clock of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from shotloom.plans import QUERIES
from shotloom.session import local_session, remove_staged

HEADLINE = (
    "retrieve_topk", "mine_hard_negatives", "sample_hard_negatives", "sample_infonce_negatives", "presample_grid",
    "assemble_training_rows", "recall_at_k", "contrastive_loss", "contrastive_loss_in_batch", "detect_scene_cuts",
    "detect_flash_cuts", "build_segments", "reconcile_counts", "backfill_dialogue_duration", "json_repair_truncated",
    "normalize_shots", "tmpl_visual_query", "format_score", "retrieval_reward", "reward_completions", "enrich_memoised",
    "export_prompt_text", "match_plot_episode", "match_character_refs", "ffd_pack", "completion_mask",
    "task_ledger_actions", "retrieval_package", "score_two_tower",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    names = sys.argv[1:] or HEADLINE
    spark.range(8).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        remove_staged(spark)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
