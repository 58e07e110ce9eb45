from functools import reduce

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shotloom.operators import metrics as M
from shotloom.operators import negatives as N
from shotloom.operators import pairs
from shotloom.operators.pairs import quantise, unit_rows
from shotloom.operators.retrieval import retrieve_topk

VEC = "vec array<double>"


def _corpus(spark, sizes, dim=6, seed=0, copies=0):
    """sizes: drama → list of episode lengths; ``copies`` shots of the first drama share one vector."""
    rng, rows = np.random.default_rng(seed), []
    for drama, eps in sizes.items():
        for e, n in enumerate(eps):
            for i in range(n):
                v = rng.normal(size=dim) if len(rows) >= copies else np.ones(dim)
                rows.append((f"{drama}|{e}|{i}", drama, e, i, v.tolist()))
    return rows, spark.createDataFrame(rows, f"shot_id string, drama string, episode long, shot_index long, {VEC}")


def _brute(rows, topk, pct=90.0, other_episode=False):
    out = {}
    unit = unit_rows([np.array(r[4]) for r in rows])
    q = quantise(unit @ unit.T)
    for a, r in enumerate(rows):
        cand = [b for b, s in enumerate(rows) if s[1] == r[1] and a != b and not (other_episode and s[2] == r[2])]
        if not cand:
            continue
        sims = q[a, cand]
        limit = np.percentile(sims.astype(float), pct)
        keep = sorted((b for b, s in zip(cand, sims) if s < limit), key=lambda b: (-q[a, b], rows[b][0]))[:topk]
        if keep:
            out[r[0]] = [(rows[b][0], int(q[a, b])) for b in keep]
    return out


def _lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["anchor"], r["rank"])):
        out.setdefault(r["anchor"], []).append((r["neg"], r["q"]))
    return out


@pytest.mark.parametrize("block", [4096, 8])
@pytest.mark.parametrize("other", [False, True])
def test_mining_equals_brute_force_on_both_paths(spark, block, other):
    rows, df = _corpus(spark, {"hot": [9, 14, 7], "small": [5], "pair": [2], "one": [1]}, copies=9)
    got = _lists(N.mine_hard_negatives(df, topk=4, exclude_same_episode=other, block=block))
    assert got == _brute(rows, 4, other_episode=other)


def test_equal_similarities_leave_nothing(spark):
    _, df = _corpus(spark, {"same": [6]}, copies=6)
    for block in (4096, 2):
        assert N.mine_hard_negatives(df, topk=3, block=block).count() == 0


def _plain_topk(vectors, k):
    """Per row the k best of all, by sums from the first component to the last."""
    unit = unit_rows([np.array(v) for v in vectors.values()], 1e-12)
    names, out = list(vectors), set()
    for a, u in enumerate(unit):
        score = [reduce(lambda t, xy: t + float(xy[0]) * float(xy[1]), zip(u, v), 0.0) for v in unit]
        order = sorted(range(len(names)), key=lambda b: (-score[b], names[b]))[:k]
        out |= {(names[a], names[b], r + 1, score[b]) for r, b in enumerate(order)}
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_topk_in_blocks(spark, block):
    rows, _ = _corpus(spark, {"a": [30], "b": [12]}, copies=8)
    vectors = {r[0]: r[4] for r in rows}
    for n in range(6):  # ties that only full doubles tell apart
        vectors[f"near{n}"] = [x + (1e-10 * n if j == 2 else 0.0) for j, x in enumerate(rows[20][4])]
    df = spark.createDataFrame(list(vectors.items()), f"item_id string, {VEC}")
    got = retrieve_topk(df.withColumnRenamed("item_id", "query_id"), df, 5, block)
    assert {(r["query_id"], r["item_id"], r["rank"], r["score"]) for r in got.collect()} == _plain_topk(vectors, 5)


def test_cells_out_of_reach_are_not_visited(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 4
    vectors = {f"v{i:03d}": (centres[i % 12] + rng.normal(size=16) * 0.3).tolist() for i in range(360)}
    df = spark.createDataFrame(list(vectors.items()), f"item_id string, {VEC}")
    pivots = pairs._pivots(df, "item_id", "vec", 36)
    _, cells = pairs.cells_of(df, [], "vec", pivots)
    every = pairs.visits(df, cells, [], "item_id", "vec", pivots)
    got = retrieve_topk(df.withColumnRenamed("item_id", "query_id"), df, 5, 10)
    assert {(r["query_id"], r["item_id"], r["rank"], r["score"]) for r in got.collect()} == _plain_topk(vectors, 5)
    floor = {q: min(s for p, _, _, s in _plain_topk(vectors, 5) if p == q) for q in list(vectors)[:1]}
    reach = every.filter(F.col("item_id") == "v000").filter(F.col("_bound") >= floor["v000"]).count()
    assert every.count() == 360 * cells.count() and reach < cells.count() / 2


def test_topk_of_a_small_index(spark):
    _, df = _corpus(spark, {"a": [3]})
    got = retrieve_topk(df.select(F.col("shot_id").alias("query_id"), "vec"), df.select(F.col("shot_id").alias("item_id"), "vec"), 10)
    assert got.count() == 9


def test_zero_vector_scores_zero(spark):
    q = spark.createDataFrame([("z", [0.0, 0.0])], f"query_id string, {VEC}")
    i = spark.createDataFrame([("a", [1.0, 0.0])], f"item_id string, {VEC}")
    assert retrieve_topk(q, i, 1).first()["score"] == 0.0


@pytest.mark.parametrize("block", [4096, 5])
def test_recall_and_in_batch_loss_do_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(3)
    text = rng.normal(size=(24, 5))
    image = text + rng.normal(size=(24, 5))
    rows = [(i // 12, f"i{i:02d}", text[i].tolist(), image[i].tolist()) for i in range(24)]
    df = spark.createDataFrame(rows, "batch long, id string, text array<double>, image array<double>")
    got = M.recall_at_k(df, (1, 5), block).first()
    t, m = unit_rows(list(text), 1e-12), unit_rows(list(image), 1e-12)
    ranks, losses = [], []
    for b in (0, 1):
        s = t[b * 12:b * 12 + 12] @ m[b * 12:b * 12 + 12].T
        ranks += [(s[i] > s[i, i]).sum() + 1 for i in range(12)]
        lse = [np.log(np.exp(x / 0.07).sum(axis=1)) - np.diag(s) / 0.07 for x in (s, s.T)]
        losses.append(np.mean(lse))
    assert got["recall_1"] == pytest.approx(np.mean(np.array(ranks) <= 1))
    assert got["recall_5"] == pytest.approx(np.mean(np.array(ranks) <= 5))
    loss = {r["batch"]: r["loss"] for r in M.in_batch_loss(df, 0.07, block).collect()}
    assert [loss[0], loss[1]] == pytest.approx(losses)


# ---------------------------------------------------------------- sampling

def _check_tiers(rows, draws, n, window):
    info = {r[0]: r for r in rows}
    seen = {}
    for d in draws:
        a, b = info[d["anchor"]], info[d["neg"]]
        assert a[0] != b[0]
        if d["tier"] == "windowed":
            assert (a[1], a[2]) == (b[1], b[2]) and abs(a[3] - b[3]) > window
        elif d["tier"] == "cross_episode":
            assert a[1] == b[1] and a[2] != b[2]
        else:
            assert a[1] != b[1]
        seen.setdefault(a[0], []).append(b[0])
    for a, got in seen.items():
        assert len(got) == len(set(got)) <= n
    return seen


def test_infonce_draws_obey_their_tiers(spark):
    rows, df = _corpus(spark, {"a": [30, 8, 3], "b": [4, 25], "c": [2]})
    draws = N.sample_infonce_negatives(df, 9, window=2, seed=4).collect()
    seen = _check_tiers(rows, draws, 9, 2)
    assert all(len(v) == 9 for v in seen.values()) and len(seen) == len(rows)
    assert all(d["short_by"] == 0 for d in draws)
    again = N.sample_infonce_negatives(df, 9, window=2, seed=4).collect()
    assert sorted(map(tuple, draws)) == sorted(map(tuple, again))


def test_gaps_in_shot_index_count_for_the_window(spark):
    rows = [(f"d|0|{i}", "d", 0, i, [1.0]) for i in (0, 1, 5, 6, 20)] + [("e|0|0", "e", 0, 0, [1.0])]
    df = spark.createDataFrame(rows, f"shot_id string, drama string, episode long, shot_index long, {VEC}")
    got = N.sample_pool(df, "windowed", 10, window=4).collect()
    pools = {}
    for d in got:
        pools.setdefault(d["anchor"], set()).add(d["neg"])
    assert pools["d|0|5"] == {"d|0|0", "d|0|20"} and pools["d|0|20"] == {f"d|0|{i}" for i in (0, 1, 5, 6)}
    assert pools["d|0|0"] == {"d|0|5", "d|0|6", "d|0|20"} and "e|0|0" not in pools


def test_short_pools_return_short(spark):
    rows, df = _corpus(spark, {"only": [4]})
    draws = N.sample_infonce_negatives(df, 9, window=1).collect()
    _check_tiers(rows, draws, 9, 1)
    assert {d["short_by"] for d in draws if d["anchor"] == "only|0|0"} == {7}


def test_hard_draws_prefer_the_list_then_the_drama(spark):
    rows, df = _corpus(spark, {"a": [6], "b": [3], "lone": [1]})
    hard = spark.createDataFrame([("a|0|0", "b|0|0"), ("a|0|0", "a|0|3"), ("a|0|0", "a|0|0"), ("a|0|0", "gone")], "anchor string, neg string")
    got = {}
    for r in N.sample_hard_negatives(df, hard, 4, seed=1).collect():
        got.setdefault(r["anchor"], []).append((r["rank"], r["neg"], r["tier"], r["short_by"]))
    first = sorted(got["a|0|0"])
    assert {x[1] for x in first[:2]} == {"b|0|0", "a|0|3"} and [x[2] for x in first] == ["listed"] * 2 + ["same_drama"] * 2
    assert len({x[1] for x in first}) == 4
    assert {x[2] for x in got["lone|0|0"]} == {"cross_drama"} and len(got["lone|0|0"]) == 4
    # Two other shots in its drama: the list is filled from other dramas.
    assert [x[2] for x in got["b|0|0"]] == ["same_drama"] * 2 + ["cross_drama"] * 2 and {x[3] for x in got["b|0|0"]} == {0}


def test_presample_prefixes_and_skips_done(spark):
    _, df = _corpus(spark, {"a": [12, 9], "b": [15]})
    hard = N.mine_hard_negatives(df, topk=3).select("anchor", "neg")
    pre = N.presample_grid(df, hard, (2, 4), (3, 6), window=2, done=[(4, 6)])
    rows = pre.collect()
    assert {(r["num_neg"], r["infonce_neg"]) for r in rows} == {(2, 3), (2, 6), (4, 3)}
    pick = {(r["anchor"], r["num_neg"], r["rank"]): r["neg"] for r in rows if r["kind"] == "hard" and r["infonce_neg"] == 3}
    assert all(pick[(a, 4, k)] == n for (a, m, k), n in pick.items() if m == 2)
    with pytest.raises(ValueError):
        N.presample_grid(df, hard, (2,), (3,), done=[(2, 3)])


def test_split_sizes(spark):
    _, df = _corpus(spark, {"a": [25]})
    n = {r["split"]: r["count"] for r in N.random_split(df, "shot_id", 0.01, 0.2).groupBy("split").count().collect()}
    assert n == {"test": 1, "val": 5, "train": 19}


def test_hard_negatives_are_topped_up_across_dramas(spark):
    shots = spark.createDataFrame([(f"{d}|0|{i}", d, 0, i) for d, n in ((1, 4), (2, 30)) for i in range(n)],
                                  "shot_id string, drama long, episode long, shot_index long")
    none = spark.createDataFrame([], "anchor string, neg string")
    rows = N.sample_hard_negatives(shots, none, 8, 3).collect()
    per = {}
    for r in rows:
        assert r.neg != r.anchor and r.short_by == 0
        per.setdefault(r.anchor, []).append(r)
    assert all(len({x.neg for x in v}) == 8 for v in per.values()) and len(per) == 34
    assert all(sum(x.tier == "same_drama" for x in per[f"1|0|{i}"]) == 3 for i in range(4))


def test_draws_are_uniform(spark):
    shots = spark.createDataFrame([(f"s{i}", 1, 0, i) for i in range(60)],
                                  "shot_id string, drama long, episode long, shot_index long")
    seen, pairs = {}, set()
    for seed in range(6):
        rows = N.sample_pool(shots, "same_drama", 5, seed=seed).collect()
        assert len({(r.anchor, r.neg) for r in rows}) == 300 and all(r.anchor != r.neg for r in rows)
        for r in rows:
            seen[r.neg] = seen.get(r.neg, 0) + 1
        for a in {r.anchor for r in rows}:
            at = sorted(int(r.neg[1:]) for r in rows if r.anchor == a)
            pairs |= {y - x for x, y in zip(at, at[1:])}
    chi = sum((seen.get(f"s{i}", 0) - 30) ** 2 / 30 for i in range(60))
    assert chi < 100 and len(pairs) > 25  # 59 degrees of freedom; steps of every length


def test_small_groups_meet_at_once(spark, monkeypatch):
    """Groups of up to a block are not cut into cells, however many rows the right side has in all."""
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(90, 4))
    rows = [(f"i{i:02d}", i % 9, vecs[i].tolist()) for i in range(90)]
    right = spark.createDataFrame(rows, "item string, g int, item_vec array<double>")
    left = spark.createDataFrame([(f"q{i}", g, v) for i, g, v in rows], "q string, g int, vec array<double>")
    monkeypatch.setattr(pairs, "visits", None)
    got = {(r["q"], r["rank"]): r["item"] for r in pairs.block_topk(left, right, ["g"], "q", "vec", "item", "item_vec", 2, block=10).collect()}
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    want = {}
    for i in range(90):
        own = [j for j in range(90) if j % 9 == i % 9]
        for rank, j in enumerate(sorted(own, key=lambda j: (-(unit[i] @ unit[j]), j))[:2], 1):
            want[f"qi{i:02d}", rank] = f"i{j:02d}"
    assert got == want


def test_small_and_large_groups_together(spark):
    rng = np.random.default_rng(6)
    vecs = rng.normal(size=(70, 4))
    rows = [(f"i{i:02d}", int(i >= 60), vecs[i].tolist()) for i in range(70)]
    right = spark.createDataFrame(rows, "item string, g int, item_vec array<double>")
    left = spark.createDataFrame([(f"q{i}", g, v) for i, g, v in rows], "q string, g int, vec array<double>")
    got = {r["q"]: r["item"] for r in pairs.block_topk(left, right, ["g"], "q", "vec", "item", "item_vec", 1, block=16).collect()}
    assert got == {f"qi{i:02d}": f"i{i:02d}" for i in range(70)}


def test_a_drama_beyond_4096_shots_is_one_pass(spark, monkeypatch):
    """No counts per bin travel: anchors meet the whole drama, a few rows at a time."""
    rng = np.random.default_rng(8)
    vecs = rng.normal(size=(4200, 3))
    df = spark.createDataFrame([(f"s{i:04d}", 1, i // 20, v.tolist()) for i, v in enumerate(vecs)],
                               "shot_id string, drama long, episode long, vec array<double>")
    monkeypatch.setattr(N, "_mine_blocks", None)
    got = _lists(N.mine_hard_negatives(df, topk=3).filter("anchor < 's0005'"))
    unit = unit_rows(vecs)
    for a in range(5):
        q = quantise(unit[a:a + 1] @ unit.T)[0]
        limit = np.percentile(np.delete(q, a).astype(float), 90.0)
        keep = sorted((b for b in range(4200) if b != a and q[b] < limit), key=lambda b: (-q[b], b))[:3]
        assert got[f"s{a:04d}"] == [(f"s{b:04d}", int(q[b])) for b in keep]


def test_copies_of_the_right_side_do_not_grow_with_the_group(spark):
    rows = [("a", i) for i in range(64)] + [("b", i) for i in range(6)]
    df = spark.createDataFrame(rows, "drama string, shot_id long")
    cands = df.select("drama", F.col("shot_id").alias("neg"))

    def seen(a, b):
        return pd.DataFrame({"drama": a["drama"][:1], "left": len(a), "right": len(b)})

    got = pairs.block_join(df, cands, ["drama"], "shot_id", "neg", seen, "drama string, left long, right long", 64,
                           left_block=4, left_most=3).groupBy("drama").agg(F.sum("left"), F.sum("right")).collect()
    assert sorted(map(tuple, got)) == [("a", 64, 192), ("b", 6, 12)]


@pytest.mark.parametrize("tasks, blocks", [(1, 2), (15, 5)])
def test_mining_in_few_blocks_of_anchors(spark, monkeypatch, tasks, blocks):
    rows, df = _corpus(spark, {"hot": [9, 14, 7], "small": [5], "pair": [2]}, copies=9)
    asked = []

    def watched(*args):
        asked.append(args[-1])
        return pairs.block_join(*args)

    for name, value in {"BLOCK": 3, "PARTS": 2, "TASKS": tasks, "block_join": watched}.items():
        monkeypatch.setattr(N, name, value)
    assert _lists(N.mine_hard_negatives(df, topk=4)) == _brute(rows, 4)
    assert asked == [blocks]


def test_losses_read_the_negatives_once(spark):
    rng = np.random.default_rng(8)
    text, image = unit_rows(list(rng.normal(size=(7, 5)))), unit_rows(list(rng.normal(size=(7, 5))))
    shots = spark.createDataFrame([(f"s{i}", text[i].tolist(), image[i].tolist()) for i in range(7)],
                                  "shot_id string, text array<double>, image array<double>")
    picks = [(a, (a + d) % 7) for a in range(6) for d in (1, 3)]
    made = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            made.add(len(part))
            yield part

    schema = "anchor string, neg string"
    negatives = spark.createDataFrame([(f"s{a}", f"s{b}") for a, b in picks], schema).mapInPandas(count, schema)
    got = {(r.anchor, r.direction): r.loss for r in M.contrastive_loss(M.negative_candidates(shots, negatives), 0.07).collect()}
    want = {}
    for i in range(7):
        for direction, mine, theirs in (("t2i", text, image), ("i2t", image, text)):
            logits = np.array([mine[i] @ theirs[j] for j in [i, *(b for a, b in picks if a == i)]]) / 0.07
            want[f"s{i}", direction] = np.log(np.exp(logits).sum()) - logits[0]
    assert got == pytest.approx(want) and made.value == len(picks)


def test_no_image_travels_with_the_pairs(spark):
    shots = spark.createDataFrame([(f"s{i}", [1.0, float(i)], [float(i), 1.0]) for i in range(1, 4)], "shot_id string, text array<double>, image array<double>")
    negatives = spark.createDataFrame([("s1", "s2"), ("s2", "s3")], "anchor string, neg string")
    plan = M.negative_candidates(shots, negatives)._jdf.queryExecution().optimizedPlan().toString()
    pairs_on_their_way = [line for line in plan.splitlines() if "Project [" in line and "anchor#" in line and "neg#" in line]
    assert pairs_on_their_way and not any("_i#" in line or "_ni#" in line for line in pairs_on_their_way)


def test_lists_are_collected_where_their_anchor_is(spark):
    vec = "text array<double>, depth array<double>, pose array<double>"
    shots = spark.createDataFrame([(f"s{i}", [float(i)], [i + 0.1], [i + 0.2]) for i in range(9)], f"shot_id string, {vec}")
    negatives = spark.createDataFrame([(f"s{a}", k, r, f"s{(a + r * s) % 9}") for a in range(8) for k, s in (("hard", 1), ("infonce", 2))
                                       for r in (3, 1, 2)], "anchor string, kind string, rank int, neg string")
    rows = N.assemble_training_rows(shots, negatives)
    got = {r.anchor: r for r in rows.collect()}
    assert got["s8"].hard_text is None and len(got) == 9
    for a in range(8):
        assert got[f"s{a}"].hard_depth == [[(a + r) % 9 + 0.1] for r in (1, 2, 3)]
        assert got[f"s{a}"].infonce_pose == [[(a + 2 * r) % 9 + 0.2] for r in (1, 2, 3)]
    lines = rows._jdf.queryExecution().executedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "partial_collect_list" in line)
    assert any("Exchange hashpartitioning(anchor" in line for line in lines[at + 1:at + 4])
