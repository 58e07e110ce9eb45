import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotloom.operators import enrich, packaging, rewards, scoring
from shotloom.operators import packing as P


def _first_fit(items, max_length, cap):
    bins = []
    for idx, n in sorted(items, key=lambda x: (-x[1], x[0])):
        for b in bins:
            if b[1] + n <= max_length and (not cap or len(b[0]) < cap):
                b[0].append(idx)
                b[1] += n
                break
        else:
            bins.append([[idx], n])
    return sorted((tuple(sorted(b[0])), b[1]) for b in bins)


@pytest.mark.parametrize("cap", [0, 1, 2, 5])
def test_packing_equals_first_fit_decreasing(spark, cap):
    rng = random.Random(cap)
    items = {t: [(i * 3 + k, rng.choice([0, 1, 7, 20, 33, 34, 50, 66, 99, 100, rng.randint(1, 100)])) for i in range(150)]
             for k, t in enumerate(("ordering", "multifield"))}
    items["long_form"] = [(2 + 3 * i, 40) for i in range(5)]
    rows = [(i, t, n) for t, xs in items.items() for i, n in xs]
    df = spark.createDataFrame(rows, "sample_index long, task_type string, length long")
    got = {}
    for r in P.ffd_pack(df, 100, cap).collect():
        got.setdefault(r["task_type"], []).append((tuple(r["sample_indices"]), r["total_length"]))
        assert r["first_index"] == min(r["sample_indices"])
    for t in ("ordering", "multifield"):
        assert sorted(got[t]) == _first_fit(items[t], 100, cap), t
    assert len(got["long_form"]) == 5


def test_too_long_is_dropped_and_counted(spark):
    df = spark.createDataFrame([(1, "ordering", 100), (2, "ordering", 101)], "sample_index long, task_type string, length long")
    kept, counts = P.drop_too_long(df, 100)
    assert kept.count() == 1 and counts.first()["too_long"] == 1
    packs = P.ffd_pack(df, 100).select("task_type", F.size("sample_indices").alias("n"), "total_length")
    s = {r["task_type"]: r for r in P.pack_summary(counts, packs, 100).collect()}
    assert s["ordering"]["saved_items"] == 1 and s["ordering"]["avg_pack_fill_ratio"] == 1.0 and s["(all)"]["raw_samples"] == 2


def test_empty_packing(spark):
    df = spark.createDataFrame([], "sample_index long, task_type string, length long")
    assert P.ffd_pack(df, 10).count() == 0


def test_mask(spark):
    df = spark.createDataFrame([([2, 5, 9], 5)], "e array<int>, s int")
    assert df.select(P.completion_mask(F.col("e"), F.col("s"))).first()[0] == [0, 0, 1]


# ---------------------------------------------------------------- enrichment

def test_each_distinct_payload_is_called_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def fn(items):
        with open(log, "a") as f:
            f.writelines(x + "\n" for x in items)
        return [len(x) for x in items]

    df = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "bb", "a", "a", "ccc", None])], "i int, p string")
    rows, memo = enrich.enrich_memoised(df, "p", fn, "int", batch=2)
    assert {r["i"]: r["result"] for r in rows.collect()} == {0: 1, 1: 2, 2: 1, 3: 1, 4: 3, 5: None}
    more = spark.createDataFrame([(9, "a"), (10, "dddd")], "i int, p string")
    rows, _ = enrich.enrich_memoised(more, "p", fn, "int", memo=memo)
    assert {r["i"]: r["result"] for r in rows.collect()} == {9: 1, 10: 4}
    assert sorted(open(log).read().split()) == ["a", "bb", "ccc", "dddd"]


def test_retries_and_default(spark, tmp_path):
    tries = str(tmp_path / "tries")

    def flaky(items):
        with open(tries, "a") as f:
            f.write("x")
        with open(tries) as f:
            if len(f.read()) % 3:
                raise RuntimeError("busy")
        return ["ok" for _ in items]

    def broken(items):
        return items[:-1]

    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, p string").coalesce(1)
    rows, _ = enrich.enrich_memoised(df, "p", flaky, "string", batch=16)
    assert {r["result"] for r in rows.collect()} == {"ok"}
    rows, _ = enrich.enrich_memoised(df, "p", broken, "string", retries=2, default=F.lit("none"))
    assert {(r["result"], "1 results for 2" in r["error"] or "0 results for 1" in r["error"]) for r in rows.collect()} == {("none", True)}


def test_answers_are_not_copied_for_the_join(spark):
    """Answers join once, by a digest: no row of them is copied, and no text nobody asks for is sent."""
    df = spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)], "i int, p string")
    rows, _ = enrich.enrich_memoised(df, "p", lambda items: [x[-1] for x in items], "string")
    plan = rows.select("i", "result")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "_salt" not in plan
    assert {r["i"]: r["result"] for r in rows.collect()} == {i: str(i % 3) for i in range(9)}


def test_rewards_do_not_write_the_completions(spark, monkeypatch):
    written = []
    monkeypatch.setattr(rewards, "stage", lambda df: written.append(df.columns) or df)
    done = spark.createDataFrame([(1, 0, 0, "[{}]")], "completion int, drama int, episode int, text string")
    frames = spark.createDataFrame([("a", 0, 0, [1.0, 0.0])], "item string, drama int, episode int, vec array<double>")
    rewards.reward_completions(done, frames, lambda t: [[1.0, 0.0] for _ in t], lambda t: [0.5 for _ in t])
    assert not any(c in columns for columns in written for c in ("text", "items"))


# ---------------------------------------------------------------- rewards

def _vectors(spark, rows):
    return spark.createDataFrame(rows, "item string, drama string, episode string, vec array<double>")


def test_retrieval_reward_cases(spark):
    shots = spark.createDataFrame([(1, 0, "d", "1", [1.0, 0.0]), (1, 1, "d", "1", [0.0, 1.0]), (2, 0, "x", "9", [1.0, 0.0])],
                                  "completion long, pos int, drama string, episode string, vec array<double>")
    alone = _vectors(spark, [("a", "d", "1", [1.0, 0.0])])
    got = {r["completion"]: r["r_retrieval"] for r in rewards.retrieval_reward(shots, alone).collect()}
    assert got == {1: pytest.approx(0.75), 2: 0.5}                     # no contrast episode; no frames
    two = _vectors(spark, [("a", "d", "1", [1.0, 0.0]), ("b", "d", "2", [0.0, 1.0])])
    got = {r["completion"]: r["r_retrieval"] for r in rewards.retrieval_reward(shots, two).collect()}
    assert got[1] == pytest.approx(0.5 * (0.75 + 1 - 0.75))
    away = _vectors(spark, [("a", "d", "1", [1.0, 0.0]), ("b", "e", "1", [-1.0, 0.0])])
    got = {r["completion"]: r["r_retrieval"] for r in rewards.retrieval_reward(shots, away).collect()}
    assert got[1] == pytest.approx(0.5 * (0.75 + 1 - 0.25))


def test_no_shots_score_minus_one(spark):
    df = spark.createDataFrame([(1, "d", "1", "no json"), (2, "d", "1", '[{"index": 1, "description_narrative": "x"}]')],
                               "completion long, drama string, episode string, text string")
    frames = _vectors(spark, [("a", "d", "1", [1.0, 0.0])])
    got = {r["completion"]: r for r in rewards.reward_completions(
        df, frames, lambda ts: [[1.0, 0.0] for _ in ts], lambda ts: [None for _ in ts], 0.5, 0.3, 0.2).collect()}
    assert got[1]["reward"] == -1.0 and got[1]["r_video"] is None and got[1]["r_format"] == -1.0
    fmt = 2 * (0.6 * 2 / 11 + 0.3 / 6) - 1
    assert got[2]["reward"] == pytest.approx(0.5 * 1.0 + 0.3 * 0.5 + 0.2 * fmt)


def test_judge_answers(spark):
    texts = ['[{"index": 1, "score": 1.5}, {"index": 2, "score": -1}]', '[{"index": 1, "score": 0.2}]', "?",
             '[{"index": 2, "score": 0.3}, {"index": 1}, {"index": 1, "score": "0.4"}]']
    df = spark.createDataFrame([(i, 2, t) for i, t in enumerate(texts)], "chunk int, expected int, response string")
    got = {(r["chunk"], r["index"]): (r["score"], r["fallback"]) for r in rewards.validate_indexed_scores(df).collect()}
    assert got == {(0, 1): (1.0, False), (0, 2): (0.0, False), (1, 1): (0.5, True), (1, 2): (0.5, True), (2, 1): (0.5, True),
                   (2, 2): (0.5, True), (3, 1): (0.4, False), (3, 2): (0.3, False)}


# ---------------------------------------------------------------- references and images

def test_a_name_that_starts_another_matches_both(spark):
    shots = spark.createDataFrame([("s", 1, "李雷雷来了"), ("s", 2, "无人"), ("t", 1, "李雷")], "sample string, shot int, search string")
    refs = spark.createDataFrame([("s", 1, "李雷雷"), ("s", 0, "李雷"), ("s", 2, "")], "sample string, place int, name string")
    got = {(r["sample"], r["shot"]): r["refs"] for r in packaging.match_character_refs(shots, refs).collect()}
    assert got == {("s", 1): ["李雷", "李雷雷"], ("s", 2): [], ("t", 1): []}


def test_image_candidates_in_order(spark):
    items = spark.createDataFrame([(1, "depth_emb/d/#U4e2d.npy"), (2, "d/x.npy")], "item int, rel string")
    files = spark.createDataFrame([("d/中.PNG",), ("d/中_generated.png",), ("d/x.webp",), ("d/x.jpg",)], "path string")
    got = {r["item"]: r["image"] for r in packaging.resolve_image_path(items, files).collect()}
    assert got == {1: "d/中.PNG", 2: "d/x.jpg"}


# ---------------------------------------------------------------- two-tower score

def test_two_tower_matches_a_row_at_a_time(spark):
    import math
    from shotloom.plans.metric_queries import weights
    table = weights(spark, None, dim=6, hidden=8)
    w = scoring.load_weights(table)
    rng = np.random.default_rng(1)
    rows = [(i, *[rng.normal(size=6).tolist() for _ in range(3)]) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, text array<double>, depth array<double>, pose array<double>")
    got = {r["id"]: r for r in scoring.score_two_tower(df, table, heads=2).collect()}

    def norm(x, n):
        return (x - x.mean()) / math.sqrt(x.var() + 1e-5) * w[f"{n}.weight"] + w[f"{n}.bias"]

    def tower(x, n):
        h = norm(w[f"{n}.in.weight"] @ x + w[f"{n}.in.bias"], f"{n}.norm")
        g = np.array([0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in h])
        return w[f"{n}.out.weight"] @ g + w[f"{n}.out.bias"]

    for i, text, depth, pose in rows:
        tok = [tower(np.array(depth), "depth"), tower(np.array(pose), "pose")]
        qkv = [w["fuse.qkv.weight"] @ t + w["fuse.qkv.bias"] for t in tok]
        mixed = []
        for a in range(2):
            out = np.zeros(8)
            for h in range(2):
                sl = slice(4 * h, 4 * h + 4)
                s = np.array([qkv[a][:8][sl] @ qkv[b][8:16][sl] / 2.0 for b in range(2)])
                p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
                out[sl] = sum(p[b] * qkv[b][16:][sl] for b in range(2))
            mixed.append(norm(tok[a] + w["fuse.attn_out.weight"] @ out + w["fuse.attn_out.bias"], "fuse.norm"))
        image = w["fuse.out.weight"] @ np.mean(mixed, axis=0) + w["fuse.out.bias"]
        t = tower(np.array(text), "text")
        want = t @ image / np.linalg.norm(t) / np.linalg.norm(image)
        assert got[i]["score"] == pytest.approx(want, abs=1e-5)


def test_oversized_weights_are_refused(spark, monkeypatch):
    monkeypatch.setattr(scoring, "MAX_WEIGHTS", 10)
    df = spark.createDataFrame([("a", [11], [0.0] * 11)], "name string, shape array<int>, vals array<float>")
    with pytest.raises(ValueError):
        scoring.load_weights(df)
