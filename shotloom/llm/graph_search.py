"""Approximate nearest neighbours by inner product on robust-pruned directed graphs, one per shard.

Equal vectors are one node that lists the smallest ids of its rows, as many as a query can ask for,
so a vector that a third of all rows share costs one node and its ties are answered exactly.  Nodes
are dealt to shards of bounded size by hash.  In a shard one more component turns inner
products into distances: with x' = (x, sqrt(m - |x|^2)) and q' = (q, 0) the nearest x' has the largest
product.  The graph of a shard grows by blocks of nodes: greedy searches on the graph so far
propose neighbours, relaxed pruning keeps a neighbour only if none kept before is, by the factor
``alpha``, closer to it than the node itself, and the edges are added in both directions.  The index is
a table, one row per node.  A beam search over each shard answers a query; scores are then computed
again in double precision from the original vectors, and the best of all shards are merged.

Every row is indexed and every query meets every shard; what is approximate is the walk on the
graph.  The smallest beam and degree are parameters.

Defined cases: rows with a null id or vector, a zero vector or a null or non-finite component take no
part; of rows that share an id the one with the smallest vector counts; vectors of unequal
length count as filled with zeros; equal scores go by the smaller id; with fewer candidates than k all are
returned; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shotloom.llm.vector_rows import cells, matrix, same_width, usable
from shotloom.session import stage

SHARD, QUERIES = 1 << 13, 1 << 12  # nodes of a shard, queries of a block
DEGREE, BEAM, WIDE, ALPHA = 32, 64, 96, 1.2  # WIDE: the beam of a query
EXPAND, STARTS = 6, 16             # nodes opened in a turn, and at first
BLOCK, SALTS, SHARE = 512, 16, 32  # nodes inserted together; one node of SHARE can begin a search
INDEX = "shard int, node int, entry boolean, vec array<double>, ids array<bigint>, near array<int>"


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one more component that makes all of them equally long, in single precision."""
    norm = (vectors * vectors).sum(axis=1)
    top = norm.max(initial=0.0)
    scale = np.sqrt(top) or 1.0
    return np.column_stack([vectors / scale, np.sqrt(np.maximum(top - norm, 0.0)) / scale]).astype(np.float32)


def beam_search(points: np.ndarray, near: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> np.ndarray:
    """The ``beam`` nodes nearest to each query that greedy walks from ``entries`` find, nearest first, -1 beyond.

    All points are equally long, so the largest product is the smallest distance.
    """
    n, width = len(queries), near.shape[1]
    ids = np.full((n, beam), -1, np.int32)
    value = np.full((n, beam), -np.inf, np.float32)
    done = np.ones((n, beam), bool)
    m = min(len(entries), beam, STARTS)
    first = queries @ points[entries].T
    best = np.argpartition(-first, m - 1, axis=1)[:, :m]
    ids[:, :m], value[:, :m], done[:, :m] = entries[best], np.take_along_axis(first, best, 1), False
    mark = np.full((n, len(points)), -1, np.int16)  # the column that proposed a node; -1: not seen yet
    np.put_along_axis(mark, ids[:, :m], 0, 1)
    live = np.arange(n)
    while len(live):
        ranked = np.where(done[live], -np.inf, value[live])
        pick = np.argpartition(-ranked, EXPAND - 1, axis=1)[:, :EXPAND]
        open_ = np.take_along_axis(ranked, pick, 1) > -np.inf
        go = open_.any(axis=1)
        live, pick, open_ = live[go], pick[go], open_[go]
        if not len(live):
            break
        done[live[:, None], pick] = True
        new = np.where(open_[:, :, None], near[np.take_along_axis(ids[live], pick, 1)], -1).reshape(len(live), -1)
        row, col = np.nonzero(new >= 0)
        new, own, col = new[row, col], live[row], col.astype(np.int16)
        fresh = mark[own, new] < 0
        row, col, new, own = row[fresh], col[fresh], new[fresh], own[fresh]
        mark[own, new] = col  # of equal proposals in one turn the last one stays
        last = mark[own, new] == col
        row, new, own = row[last], new[last], own[last]
        got = np.einsum("ij,ij->i", points[new], queries[own])
        better = got > value[live].min(axis=1)[row]
        row, new, got = row[better], new[better], got[better]
        many = np.bincount(row, minlength=len(live))
        col = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        wide = beam + int(many.max(initial=0))
        all_ids = np.full((len(live), wide), -1, np.int32)
        all_value = np.full(all_ids.shape, -np.inf, np.float32)
        all_done = np.ones(all_ids.shape, bool)
        all_ids[:, :beam], all_value[:, :beam], all_done[:, :beam] = ids[live], value[live], done[live]
        all_ids[row, beam + col], all_value[row, beam + col], all_done[row, beam + col] = new, got, False
        order = np.argpartition(-all_value, beam - 1, axis=1)[:, :beam]
        ids[live], value[live], done[live] = (np.take_along_axis(x, order, 1) for x in (all_ids, all_value, all_done))
    ids = np.take_along_axis(ids, np.argsort(-value, axis=1, kind="stable"), 1)
    return ids


def robust_prune(points: np.ndarray, nodes: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` neighbours per node out of ``proposed`` (-1: none), -1 beyond."""
    out = np.full((len(nodes), degree), -1, np.int32)
    step = max(1, (1 << 22) // max(1, proposed.shape[1] ** 2))
    for at in range(0, len(nodes), step):
        own, some = nodes[at:at + step], proposed[at:at + step]
        alive = (some >= 0) & (some != own[:, None])
        there = points[some]
        far = np.where(alive, 1.0 - np.einsum("ikj,ij->ik", there, points[own]), np.inf)
        order = np.argsort(far, axis=1, kind="stable")
        some, far, alive = (np.take_along_axis(x, order, 1) for x in (some, far, alive))
        there = np.take_along_axis(there, order[:, :, None], 1)
        apart = 1.0 - there @ there.transpose(0, 2, 1)  # half the squared distance
        row = np.arange(len(own))
        for k in range(degree):
            best = alive.argmax(axis=1)
            on = alive[row, best]
            if not on.any():
                break
            out[at + row[on], k] = some[row[on], best[on]]
            alive &= ~((alpha * alpha * apart[row, best] <= far) & on[:, None])
            alive[row, best] = False
    return out


def _add_back(points: np.ndarray, near: np.ndarray, nodes: np.ndarray, degree: int, alpha: float) -> None:
    """For every edge of ``nodes`` the opposite one; nodes with too many are pruned."""
    src = np.repeat(nodes, near.shape[1])
    dst = near[nodes].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    src, dst = src[~(near[dst] == src[:, None]).any(axis=1)], dst[~(near[dst] == src[:, None]).any(axis=1)]
    order = np.lexsort((src, dst))
    src, dst = src[order], dst[order]
    target, at, many = np.unique(dst, return_index=True, return_counts=True)
    have = (near[target] >= 0).sum(axis=1)
    rank = np.arange(len(dst)) - np.repeat(at, many)
    fits = np.repeat(have + many <= degree, many)
    near[dst[fits], (np.repeat(have, many) + rank)[fits]] = src[fits]
    full = np.flatnonzero(have + many > degree)
    full = full[np.argsort(many[full], kind="stable")]
    step = 256
    for k in range(0, len(full), step):
        some = full[k:k + step]
        wide = np.full((len(some), int(many[some].max())), -1, np.int32)
        row = np.repeat(np.arange(len(some)), many[some])
        col = np.arange(len(row)) - np.repeat(np.cumsum(many[some]) - many[some], many[some])
        wide[row, col] = src[at[some][row] + col]
        near[target[some]] = robust_prune(points, target[some], np.column_stack([near[target[some]], wide]), degree, alpha)


def _reachable(near: np.ndarray, entries: np.ndarray) -> np.ndarray:
    seen = np.zeros(len(near), bool)
    seen[entries] = True
    edge = entries
    while len(edge):
        edge = np.unique(near[edge])
        edge = edge[(edge >= 0)]
        edge = edge[~seen[edge]]
        seen[edge] = True
    return seen


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each node (-1 beyond) and the nodes where searches begin."""
    points = lifted(vectors)
    n = len(points)
    near = np.full((n, degree), -1, np.int32)
    centre = int(np.argmax(points @ points.mean(axis=0)))
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate(([centre], order[order != centre]))
    starts, at = order[:1], 1
    while at < n:
        some = order[at:at + min(max(at, 16), BLOCK)]
        found = beam_search(points, near, starts, points[some], beam)
        near[some] = robust_prune(points, some, found, degree, alpha)
        _add_back(points, near, some, degree, alpha)
        at += len(some)
        starts = order[:1 + at // SHARE]
    while not (seen := _reachable(near, starts)).all():  # a node that no edge leads to gets one from its nearest
        lost = np.flatnonzero(~seen)[:BLOCK]
        host, one = np.unique(beam_search(points, near, starts, points[lost], beam)[:, 0], return_index=True)
        more = np.full(n, -1, np.int32)
        more[host] = lost[one]
        near = np.column_stack([near, more])
    near = np.take_along_axis(near, np.argsort(near < 0, axis=1, kind="stable"), 1)
    return near[:, :max(1, int((near >= 0).sum(axis=1).max(initial=0)))], starts


def _build(degree: int, beam: int, alpha: float):
    def build(rows: pa.Table) -> pa.Table:
        vectors = matrix(rows["vec"])
        near, starts = build_graph(vectors, degree, beam, alpha)
        node = np.arange(len(rows), dtype=np.int32)
        many = (near >= 0).sum(axis=1)
        edges = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(many))).astype(np.int32), pa.array(near[near >= 0]))
        return pa.table([rows["shard"].combine_chunks(), pa.array(node), pa.array(np.isin(node, starts)), rows["vec"].combine_chunks(),
                         rows["ids"].combine_chunks(), edges], ["shard", "node", "entry", "vec", "ids", "near"])
    return build


def build_index(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", copies: int = 21, shard: int = SHARD,
                degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> DataFrame:
    """One row per different vector: ``shard``, ``node``, ``entry``, ``vec``, ``ids``, ``near``.

    ``ids`` are the ``copies`` smallest ids of the rows with this vector, taken first per salt so that
    no task meets all rows of a frequent vector.
    """
    nonzero = F.exists("vec", lambda x: x != 0)
    base = usable(rows, id_col, vec_col).filter(nonzero)
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("_salt")

    def first(df: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy("id")
        return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= copies).drop("_n")

    some = first(first(base.select("id", "vec", salt), "vec", "_salt"), "vec")
    nodes = stage(some.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    shards = max(1, -(-nodes.count() // shard))
    dealt = nodes.select(F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int").alias("shard"), "vec", "ids")
    return stage(dealt.groupBy("shard").applyInArrow(_build(degree, beam, alpha), INDEX))


def _search(k: int, beam: int):
    def search(queries: pa.Table, index: pa.Table) -> pa.Table:
        if not len(queries) or not len(index):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query_id", "id", "score"])
        index = index.sort_by("node")
        vectors, asked = same_width(matrix(index["vec"]), matrix(queries["vec"]))
        own, ids = queries["id"].to_numpy(), index["ids"].combine_chunks()
        first, every = ids.offsets.to_numpy(), ids.flatten().to_numpy()
        first = first - first[0]
        points = lifted(vectors)
        flat = np.column_stack([asked, np.zeros(len(asked))]).astype(np.float32)
        near = index["near"].combine_chunks()
        degree = np.diff(near.offsets.to_numpy())
        table = np.full((len(index), max(1, int(degree.max()))), -1, np.int32)
        table[np.arange(table.shape[1]) < degree[:, None]] = near.flatten().to_numpy()
        starts = np.flatnonzero(index["entry"].to_numpy())
        wide, out = max(beam, k + 1), []
        for at in range(0, len(own), BLOCK):
            found = beam_search(points, table, starts, flat[at:at + BLOCK], wide)
            row, col = np.nonzero(found >= 0)
            node = found[row, col]
            score = np.einsum("ij,ij->i", vectors[node], asked[at + row])
            many = first[node + 1] - first[node]
            one = np.repeat(first[node], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            row, score, other = np.repeat(row, many), np.repeat(score, many), every[one]
            keep = other != own[at + row]
            row, score, other = row[keep], score[keep], other[keep]
            order = np.lexsort((other, -score, row))
            row, score, other = row[order], score[order], other[order]
            count = np.bincount(row, minlength=1)
            rank = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            out.append((own[at + row[rank < k]], other[rank < k], score[rank < k]))
        return pa.table([np.concatenate(x) for x in zip(*out)], ["query_id", "id", "score"])
    return search


def search_index(index: DataFrame, queries: DataFrame, k: int = 20, beam: int = WIDE, query_block: int = QUERIES,
                 id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` nearest found; ``index`` holds more than ``k`` copies."""
    asked = usable(queries, id_col, vec_col).filter(F.exists("vec", lambda x: x != 0))
    shards, blocks = index.agg(F.max("shard")).first()[0], max(1, -(-asked.count() // query_block))
    if shards is None:
        return asked.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).filter("false")
    found = cells(asked, index, blocks, shards + 1, _search(k, beam), "query_id long, id long, score double", right_block=F.col("shard"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")
