import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from shotloom.operators import corpus as C
from shotloom.operators import ledger as L
from shotloom.operators import negatives as N
from shotloom.operators import packaging as K
from shotloom.operators import rewards as R
from shotloom.plans import QUERIES
from shotloom.plans import bindings as B
from shotloom.plans import file_queries, stream_queries
from shotloom.session import shared_dir, stage
from shotloom.sources import documents as D
from shotloom.sources import sinks
from shotloom.streaming import incremental as S

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().toString()


def _write(root, files):
    for name, body in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body if isinstance(body, str) else json.dumps(body, ensure_ascii=False), encoding="utf-8")


# ---------------------------------------------------------------- files

def test_listing_reads_no_contents(spark, tmp_path):
    _write(tmp_path, {"a/1.mp4": "x", "a/10.MP4": "x", "a/2.mkv": "x", "a/z.mp4": "x", "a/note.txt": "x", "b/intro.ts": "x"})
    files = D.list_files(spark, str(tmp_path))
    scan = re.search(r"ReadSchema: (\S+)", files._jdf.queryExecution().executedPlan().toString()).group(1)
    assert "content" not in scan
    got = sorted((r["drama"], r["episode"], r["path"].rsplit("/", 1)[1]) for r in D.episode_paths(files).collect())
    assert got == [("a", 1, "1.mp4"), ("a", 2, "2.mkv"), ("a", 4, "z.mp4"), ("a", 10, "10.MP4"), ("b", 1, "intro.ts")]


def test_shot_documents(spark, tmp_path):
    shots = [{"index": 0, "description_visual": " v "}, {"index": 1, "description": "d", "dialogue": None},
             {"description": "no index"}, {"index": 3, "description": "  "}]
    _write(tmp_path, {"x/shot/1.json": shots, "x/shot/2.json": "{broken", "x/shot/3.json": []})
    docs = D.with_episode_parts(D.read_texts(spark, str(tmp_path))).withColumnRenamed("stem", "episode").select("drama", "episode", "value")
    got = sorted((r["episode"], r["index"], r["description"]) for r in D.valid_shots(D.parse_shots(docs)).collect())
    assert got == [("1", 0, "v"), ("1", 1, "d")]


def test_infer_results_and_runs(spark, tmp_path):
    _write(tmp_path, {"in/test_a.json": [{"sample_index": 1, "user": "u", "model_output": "[]"}, {"sample_index": "2", "user": "w"}],
                      "runs.csv": "signature,status,elapsed_s,timestamp,test_R@10\na,failed,1,t,\na,done,2,t,0.5\nb,failed,1,t,\n"})
    got = [(r["source"], r["sample_index"], r["user"]) for r in D.read_infer_results(spark, str(tmp_path / "in")).orderBy("user").collect()]
    assert got[0] == ("test_a", 1, "u") and len(got) == 2
    runs = D.read_runs(spark, str(tmp_path / "runs.csv"), ["test_R@10"]).withColumn("seq", F.monotonically_increasing_id())
    last = {r["signature"]: (r["status"], r["test_R@10"]) for r in D.last_per_signature(runs, "seq").collect()}
    assert last == {"a": ("done", 0.5), "b": ("failed", None)}


@pytest.mark.parametrize("name", ["read_transcript_files", "read_timeline_files"])
def test_written_documents_share_files(spark, name):
    before = set(Path(shared_dir(spark)).rglob("*.txt"))
    sf = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, sf)
    source = B.transcripts(spark, sf).select("idx", "text", "drama", "episode") if "transcript" in name else None
    files = set(Path(shared_dir(spark)).rglob("*.txt")) - before
    assert 0 < len(files) <= 10 * spark.sparkContext.defaultParallelism < got.select("episode").distinct().count()
    if source is not None:
        kept = got.select(F.col("idx").cast("bigint").alias("idx"), "text", "drama", "episode")
        assert kept.exceptAll(source).isEmpty() and source.exceptAll(kept).isEmpty()


def test_documents_of_episodes_read_back_as_they_were(spark):
    text = json.dumps({"0": "tab\t, line\nend \u2028 \r \\ \"q\"", "1": ""})
    rows = [(1, 2, text), (1, 3, "{}"), (-4, 2, text)]
    docs = spark.createDataFrame(rows, "drama long, episode long, value string")
    assert sorted(map(tuple, file_queries._as_files(docs, "odd").collect())) == sorted(rows)


def test_vector_layouts(spark):
    files = spark.createDataFrame([("e/depth_emb/d/1/keyframe_002.npy",), ("e/depth_emb/depth_emb/d/1/keyframe_002.npy",),
                                   ("e/pose_emb/d/1/keyframe_010.npy",), ("e/pose_emb/d/1/other.npy",)], "path string")
    got = {(r["modality"], r["shot_index"]): r["path"] for r in D.resolve_embedding_layout(files).collect()}
    assert got == {("depth", 2): "e/depth_emb/depth_emb/d/1/keyframe_002.npy", ("pose", 10): "e/pose_emb/d/1/keyframe_010.npy"}


def test_manifest_round_trip(spark):
    rows = spark.createDataFrame([("r/a.json", 7, "【剧情摘要】\n戏\n\n【出场角色】\n甲", '[{"index": 1, "duration": "2"}]'),
                                  ("r/a.json", 8, "", "x" * 1500)], "source_file string, sample_index int, user string, model_output string")
    inputs = stage(K.video_inputs(rows))
    path = sinks.new_path(spark, "m")
    sinks.write_manifest_errors(inputs, K.manifest_rows(inputs, "out"), K.error_rows(inputs), path)
    good, bad = spark.read.json(f"{path}/manifest").first(), spark.read.json(f"{path}/errors").first()
    assert good["video_input_path"] == "out/video_inputs/a/sample_007.json" and good["num_shots"] == 1
    assert bad["sample_index"] == 8 and len(bad["model_output_preview"]) == 1000
    text = K.prompt_text(inputs).first()["text"]
    assert text.startswith("Source File: a\nSample Index: 7\n\nStory Summary:\n戏\n") and text.endswith("- Shot 1 | 2.0s\n。\n")


def test_replaced_partitions_leave_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, d string"), path, ["d"])
    sinks.replace_partitions(spark.createDataFrame([(9, "b")], "v int, d string"), path, ["d"])
    assert sorted((r["d"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 9)]


def test_shared_dir_is_the_named_one_or_local_only(spark):
    class Conf:
        def __init__(self, named):
            self.named = named

        def get(self, key, default):
            assert key == "spark.checkpoint.dir"
            return self.named or default

    class Fake:
        def __init__(self, named, master):
            self.conf = Conf(named)
            self.sparkContext = type("Context", (), {"master": master, "applicationId": "fake"})

    assert shared_dir(Fake("s3://bucket/x", "yarn")) == "s3://bucket/x"
    with pytest.raises(ValueError):
        shared_dir(Fake(None, "yarn"))
    assert shared_dir(spark) == shared_dir(spark)


# ---------------------------------------------------------------- reconcile

def test_reconcile_actions(spark):
    def rows(counts, extra=""):
        return spark.createDataFrame([("d", e, i) for e, n in counts.items() for i in range(n)], "drama string, episode int, i int")

    got = {r["episode"]: (r["status"], r["action"]) for r in C.reconcile_counts(
        rows({1: 3, 2: 2, 3: 3, 5: 1}), rows({1: 3, 2: 3, 3: 3, 4: 2, 5: 1}), rows({1: 3, 2: 3, 3: 2, 4: 2, 6: 1})).collect()}
    assert got == {1: ("OK", "none"), 2: ("分镜数量不一致", "drop_shot"), 3: ("分镜数量不一致", "drop_transcript_and_shot"),
                   4: ("shot文件缺失（分析失败或未运行）", "none"), 5: ("文件缺失", "none")}


def test_ledger_actions(spark):
    events = spark.createDataFrame([("a", 1, "RUNNING"), ("a", 2, "SUCCESS"), ("b", 1, "FAILED"), ("b", 2, "QUEUED"), ("c", 3, "FAILED"),
                                    ("e", 1, "SUCCESS"), ("e", 2, "FAILED")], "task string, n int, status string")
    tasks = spark.createDataFrame([(t,) for t in "abcde"], "task string")
    got = {r["task"]: r["action"] for r in L.task_ledger_actions(tasks, events, ["n"]).collect()}
    assert got == {"a": "skip", "b": "resume", "c": "submit", "d": "submit", "e": "skip"}


# ---------------------------------------------------------------- streams

def test_stream_pending_resumes_and_does_nothing_twice(spark, tmp_path):
    schema = StructType().add("task", LongType()).add("note", StringType())
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    finished = spark.createDataFrame([(3,)], "task long")

    def run():
        S.stream_pending(S.file_stream(spark, src, schema, files_per_batch=1), ["task"], lambda df: df, out, ck, finished).awaitTermination()
        return sorted(r["task"] for r in S.read_log(spark, out, schema).collect())

    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], schema).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([(2, "again"), (4, "d")], schema).coalesce(1).write.mode("append").parquet(src)
    assert run() == [1, 2, 4]
    spark.createDataFrame([(1, "again"), (5, "e")], schema).coalesce(1).write.mode("append").parquet(src)
    assert run() == [1, 2, 4, 5]
    assert forget_last_batch(ck) == 2
    assert run() == [1, 2, 4, 5] == run()  # the replayed batch replaces what it wrote
    import shutil
    shutil.rmtree(out)  # the state knows the keys, not the output
    spark.createDataFrame([(5, "again"), (6, "f"), (3, "x")], schema).coalesce(1).write.mode("append").parquet(src)
    assert run() == [6]


def forget_last_batch(checkpoint):
    """Remove the commit of the last batch, as if the job had stopped before it."""
    commits = Path(checkpoint) / "commits"
    last = max(int(f.name) for f in commits.iterdir() if f.name.isdigit())
    for f in commits.glob(f"*{last}*"):
        f.unlink()
    return last


def test_shares_of_a_stream_are_dealt_to_all_cores(spark):
    rows = spark.range(4000).withColumnRenamed("id", "k")
    stream = stream_queries.dealt_files(rows, spark, "shares", "k", 2)
    seen = []
    S.start_batches(stream, lambda batch, i: seen.append((batch.count(), batch.select(F.input_file_name()).distinct().count())),
                    sinks.new_path(spark, "checkpoint")).awaitTermination()
    cores = spark.sparkContext.defaultParallelism
    assert [files for _, files in seen] == [cores, cores] and sum(n for n, _ in seen) == 4000


def test_streamed_rewards_equal_the_batch(spark, tmp_path):
    schema = StructType().add("completion", LongType()).add("step", LongType()).add("drama", StringType()).add("episode", StringType()).add("text", StringType())
    rows = [(i, i % 2, "d", str(i % 2), f'[{{"index": 1, "background": "b{i}", "description_narrative": "n{i}"}}]') for i in range(6)]
    frames = spark.createDataFrame([("a", "d", "0", [1.0, 0.2]), ("b", "d", "1", [0.1, 1.0])], "item string, drama string, episode string, vec array<double>")
    src = str(tmp_path / "in")
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)

    def embed(texts):
        return [[float(len(t) % 7), 1.0 + sum(map(ord, t)) % 5] for t in texts]

    def judge(texts):
        return [sum(map(ord, t)) % 10 / 10 for t in texts]

    out, sums, ck = (str(tmp_path / n) for n in ("out", "sums", "ck"))

    def run():
        S.stream_rewards(S.file_stream(spark, src, schema, files_per_batch=1), frames, embed, judge, out, ck, sums=sums).awaitTermination()
        return sorted(map(tuple, S.merge_steps(spark.read.parquet(sums)).collect()))

    report = run()
    assert report == [pytest.approx(r) for r in sorted(map(tuple, S.step_report(spark.read.parquet(out)).collect()))]
    forget_last_batch(ck)
    assert run() == report and spark.read.parquet(sums).select("batch_id").distinct().count() == 2
    log = spark.read.parquet(out)
    assert log.select("batch_id").distinct().count() == 2
    got = {r["completion"]: r["reward"] for r in log.collect()}
    batch = R.reward_completions(spark.createDataFrame(rows, schema), frames, embed, judge)
    assert got == pytest.approx({r["completion"]: r["reward"] for r in batch.collect()})
    assert {r["step"]: r["completions"] for r in S.step_report(log).collect()} == {0: 3, 1: 3}


# ---------------------------------------------------------------- plans

@pytest.mark.parametrize("name", ["neg_sample_cross_drama", "sample_infonce_negatives", "match_plot_episode", "match_character_refs",
                                  "random_split", "loss_report", "match_rate", "retrieval_package", "retrieve_topk", "recall_at_k", "backfill_dialogue_duration"])
def test_no_cross_joins(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_columns_and_filters_reach_the_scan(spark):
    plan = B.ledger(spark, SF).filter("event_no > 5").select("task")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan and "GreaterThan(o_orderkey,5)" in plan


def test_sampling_joins_on_positions(spark):
    s = B.shots(spark, SF)
    laid = stage(N.lay_out(s))
    plan = N.resolve_positions(N.draw_positions(laid, "cross_drama", 3, 1), laid)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1


def test_functions_carry_the_package_to_executors(spark):
    from pyspark import cloudpickle
    from shotloom.operators import packing
    body = cloudpickle.dumps(packing.ffd_plan)
    assert b"sort_values" in body      # the code itself, not a reference


def test_staged_folders_are_removed(spark):
    import os

    from shotloom import session
    kept = session.stage(spark.range(5))
    assert kept.count() == 5
    path = session._STAGED[-1]
    assert os.path.isdir(path) and session.remove_staged(spark) >= 1
    assert not os.path.exists(path) and not session._STAGED
