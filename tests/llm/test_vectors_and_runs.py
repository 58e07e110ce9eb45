import math
import random
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from helpers import DOCS, awkward, empty  # noqa: E402

from shotloom.llm import graph_search, hard_negatives, periodic_runs  # noqa: E402
from shotloom.llm.queries import QUERIES, _repeated  # noqa: E402

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


def plain_runs(words):
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        k = 0
        while k + p < n:
            start = k
            while k + p < n and words[k] == words[k + p]:
                k += 1
            if k > start and k + p - start >= max(12, 2 * p):
                out.setdefault((start, k + p - start), p)
            k += 1
    return sorted((s, n, p) for (s, n), p in out.items())


def plain_collapsed(words):
    drop = set()
    for s, n, p in plain_runs(words):
        drop.update(range(s + p, s + n))
    return " ".join(w for k, w in enumerate(words) if k not in drop)


def split(text):
    return (text or "").encode().split()


def test_runs_equal_plain_search(monkeypatch):
    rng = random.Random(3)
    for floor in (2, 8, 64):
        monkeypatch.setattr(periodic_runs, "FLOOR", floor)
        monkeypatch.setattr(periodic_runs, "LANES", 50 * floor)
        for _ in range(40):
            texts = []
            for _ in range(rng.randint(1, 6)):
                letters = rng.choice([1, 2, 3, 30])
                words = [rng.randrange(letters) for _ in range(rng.randint(0, 90))]
                if len(words) > 20 and rng.random() < 0.7:
                    at, p = rng.randrange(len(words)), rng.randint(1, 20)
                    for i in range(at + p, len(words)):
                        words[i] = words[i - p]
                texts.append(words)
            text, start, length, period = periodic_runs.runs_of([np.array(t, np.int64) for t in texts])
            for k, words in enumerate(texts):
                mine = text == k
                assert list(zip(start[mine], length[mine], period[mine])) == plain_runs(words)


def test_extension_equals_word_by_word(monkeypatch):
    monkeypatch.setattr(periodic_runs, "FLOOR", 4)
    rng = np.random.default_rng(5)
    words = np.concatenate([rng.integers(0, 2, 300), np.tile([1, 2, 3], 60), np.zeros(90, np.int64), rng.integers(0, 3, 200), [99]])
    levels = periodic_runs.compress(words)
    assert len(levels) > 8 and levels[-1].size.sum() == len(words)
    a, b = rng.integers(0, len(words) - 1, (2, 4000))
    a, b = a[a != b], b[a != b]
    got = periodic_runs.extend(levels, a.copy(), b.copy())
    for x, y, n in zip(a, b, got):
        want = 0
        while max(x, y) + want < len(words) and words[x + want] == words[y + want]:
            want += 1
        assert n == want


def test_periodic_runs_of_awkward_rows(spark):
    rows = [*DOCS, (20, "tick tock " * 6, ""), (21, "ab " * 12, ""), (22, "ab " * 11, ""), (23, "a b c\x85d " * 9, ""),
            (24, "x " + "p q r s t u v " * 3 + "y", "")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, tuple(map(tuple, r.runs)), r.collapsed)
                 for r in periodic_runs.periodic_runs(awkward(spark, rows)).collect())
    want = []
    for i, text, _ in rows:
        words = [w.decode() for w in split(text)]
        if i == 10:  # 320,000 words of one period
            want.append((False, 10, 320_000, ((0, 320_000, 8),), " ".join(words[:8])))
        else:
            want.append((i is None, i or 0, len(words), tuple(plain_runs(words)), plain_collapsed(words)))
    assert got == sorted(want)
    assert periodic_runs.periodic_runs(empty(spark)).count() == 0


def test_op12_edits_and_digests(spark):
    import hashlib
    import zlib
    rows = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        words, h = [w.decode() for w in split(text)], zlib.crc32(str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        elif n > 600:
            continue
        if n <= 2000:
            runs = plain_runs(words)
            assert rows[i].n_runs == len(runs)
            assert rows[i].runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
            assert rows[i].collapsed_sha256 == hashlib.sha256(plain_collapsed(words).encode()).hexdigest()
            if runs:
                s, n, p = min(runs, key=lambda r: (-r[1], r[0], r[2]))
                assert (rows[i].start, rows[i].length, rows[i].period, rows[i].exponent_milli) == (s, n, p, 1000 * n // p)
            else:
                assert rows[i].start is None and rows[i].exponent_milli is None


def test_op12_edit_of_empty_and_null_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (4, None), (5, "")] + [(i, "") for i in range(40)], "doc_id long, text string")
    assert {r.text for r in _repeated(docs).collect()} == {"a b", None, ""}


def plain_negatives(rows, anchors, low=80):
    """Per (anchor, positive) the first five, over every pair of rows."""
    out = []
    for a in anchors:
        label, vec = rows[a]
        score = {i: sum(x * y for x, y in zip(vec, v)) for i, (_, v) in rows.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if rows[i][0] == label][:5]:
            fits = [i for i in order if rows[i][0] != label and low * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fits[:5])]
    return sorted(out)


def test_hard_negatives_equal_all_pairs(spark):
    rng = np.random.default_rng(7)
    rows = {i: (int(rng.integers(0, 3)), rng.normal(0.1, 0.4, 6).astype(np.float32).tolist()) for i in range(400)}
    hot = rows[11][1]
    rows |= {i: (i % 2, hot) for i in range(400, 600)}  # a third share one vector, so scores tie
    rows[600] = (1, [0.5, 0.25])  # shorter
    odd = [(None, [1.0] * 6, 1), (601, None, 1), (602, [1.0, None], 1), (603, [math.nan] * 6, 1), (604, [math.inf] * 6, 1), (605, [1.0] * 6, None)]
    twice = [(7, rows[7][1], rows[7][0]), (7, [9.0] * 6, 9)]
    data = spark.createDataFrame([(i, v, g) for i, (g, v) in rows.items()] + odd + twice, VECTORS)
    data = data.withColumns({c: F.lit(3) for c in ("id", "vec", "_l", "_r", "anchor", "score", "negative", "row")})
    whole = {i: (g, [math.floor(256 * x) for x in v]) for i, (g, v) in rows.items()}
    anchors = [i for i in whole if i % 25 == 0]
    for block in (64, 1 << 15):
        got = hard_negatives.mine_hard_negatives(data, F.col("id") % 25 == 0, F.col("label"), row_block=block, anchor_block=9)
        assert sorted(map(tuple, got.collect())) == plain_negatives(whole, anchors)
    assert hard_negatives.mine_hard_negatives(data.filter("false"), F.col("id") >= 0, F.col("label")).count() == 0


def test_first_columns_beyond_one_number():
    score = np.array([[2**61, 5, 2**61, 2**61 - 1, 5], [1, 1, 1, 1, 1]])
    allowed = np.array([[True, True, True, True, True], [False, True, False, True, True]])
    row, col = hard_negatives.first_columns(score, allowed, 3)
    assert {(r, c) for r, c in zip(row, col)} == {(0, 0), (0, 2), (0, 3), (1, 1), (1, 3), (1, 4)}
    assert hard_negatives.products(np.array([[2**40, 1]]), np.array([[2**20, 3]]))[0, 0] == 2**60 + 3


def nearest(rows, queries, k):
    ids = sorted(rows)
    width = max(map(len, rows.values()))
    m = np.array([list(rows[i]) + [0.0] * (width - len(rows[i])) for i in ids])
    out = {}
    for q in queries:
        s = m @ m[ids.index(q)]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(ids[j], s[j]) for j in order]
    return out


def test_graph_search_recall_ties_and_awkward_rows(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    rows = {i: (centres[i % 40] + rng.normal(size=16) * 0.4).astype(np.float32).tolist() for i in range(1500)}
    rows |= {i: rows[3] for i in range(1500, 2200)}  # a third of all rows share one vector
    rows[2200] = [1.0, 2.0]
    odd = [(None, [1.0] * 16, 1), (2301, None, 1), (2302, [1.0, None], 1), (2303, [math.nan] * 16, 1), (2304, [0.0] * 16, 1), (2305, [], 1)]
    data = spark.createDataFrame([(i, v, None) for i, v in rows.items()] + odd + [(3, rows[3], 1)], VECTORS)
    data = data.withColumns({c: F.lit(3) for c in ("id", "vec", "_l", "_r", "ids", "shard", "near", "rank")})
    index = graph_search.build_index(data, copies=21, shard=400)
    assert index.agg(F.sum(F.size("ids"))).first()[0] == 1500 + 1 + 20
    want = nearest(rows, [i for i in rows if i % 20 == 0], 20)
    got = {q: [] for q in want}
    for r in graph_search.search_index(index, data.filter("vec_id % 20 = 0"), k=20, query_block=50).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    hits = 0
    for q, best in want.items():
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in got[q]} & {i for i, _ in best})
        if q >= 1500 and q < 2200:
            assert [i for i, _ in got[q]] == [i for i, _ in best]
    assert hits >= 0.95 * 20 * len(want)


def test_graph_search_of_few_rows(spark):
    data = spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(1, 6)] + [(0, [1.0, 1.0], 0)], VECTORS)
    found = graph_search.search_index(graph_search.build_index(data), data.filter("vec_id % 20 = 0"), k=20).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in found] == [(0, k + 1, 5 - k, 6.0 - k) for k in range(5)]
    none = data.filter("false")
    assert graph_search.search_index(graph_search.build_index(none), none).count() == 0
    assert graph_search.search_index(graph_search.build_index(none), data).count() == 0


def test_every_node_of_a_graph_can_be_reached():
    rng = np.random.default_rng(9)
    m = np.concatenate([rng.normal(size=(300, 8)), rng.normal(size=8) + rng.normal(size=(600, 8)) * 1e-3])
    near, starts = graph_search.build_graph(m, degree=8, beam=24)
    assert graph_search._reachable(near, starts).all()
