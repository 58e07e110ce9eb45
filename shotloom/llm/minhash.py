"""Near-duplicate classes by BagMinHash signatures, banding and an exact check of multiset overlap.

A document is the multiset of its word shingles.  The weight axis is cut into [0, 1), [1, 2),
[2, 4), ...; each shingle has, per interval, a Poisson process of (time, place on the axis, slot)
points seeded by the shingle, and a document sees the points below its own count.  The earliest
time per slot is a signature whose slots agree with the probability of the weighted Jaccard
similarity; a process is followed only until it is later than every slot of its document.

Texts with one multiset are one content, found by a 128-bit digest before anything else.  Contents
that share a band of the signature form a bucket.  Every member is compared with the bucket's
leader; members of a bucket that are still in different classes afterwards are compared with each
other, in pieces of at most ``PIECE`` contents.  A bucket with more is cut by further bands, which
links most of it cheaply.  The members of larger buckets that then still hold several classes meet
in an exact join: each emits the rarest fifth of its shingles, and any two that are similar enough
share one of them, so no link of a hot bucket is left out.

Defined cases: null texts are empty; all empty texts are copies of each other, other texts
without a word are copies only of themselves; texts shorter than a shingle are one shingle; rows
with null or repeated ids are classed by their text; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotloom.llm.common import keyed
from shotloom.llm.word_arrays import bags, mix, portions
from shotloom.session import stage

WIDTH, THRESHOLD, SLOTS, ROWS, PIECE, SALTS, PLACES, SHARE = 5, 0.8, 128, 4, 16, 16, 1 << 18, 1024
KEYS = ("key", "key2", "key3")  # one band, and with the next one or two bands
_U = np.uint64
_STEP, _LEVEL = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def bag_minhash(doc: np.ndarray, item: np.ndarray, count: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """Earliest times, ``n_docs`` x ``slots``; infinite for a document without items."""
    depth = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1  # intervals that begin below the count
    at = np.repeat(np.arange(len(item)), depth)
    level = np.arange(len(at)) - np.repeat(np.cumsum(depth) - depth, depth)
    low = np.where(level == 0, 0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1, low)
    owner, top = doc[at], count[at].astype(np.float64)
    seed = mix(item[at] + level.astype(_U) * _U(_LEVEL))
    time = np.zeros(len(at))
    best = np.full(n_docs * slots, np.inf)
    latest = np.full(n_docs, np.inf)
    turn = 0
    while len(owner):
        turn += 1
        draw = mix(seed + _U(turn * _STEP % (1 << 64)))
        time = time - np.log(((draw >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53) / (slots * width)
        place = mix(draw)
        seen = (time < latest[owner]) & (low + width * ((place >> _U(11)).astype(np.float64) * 2.0**-53) < top)
        np.minimum.at(best, owner[seen] * slots + (place[seen] % _U(slots)).astype(np.int64), time[seen])
        latest = best.reshape(n_docs, slots).max(axis=1)
        keep = time < latest[owner]
        owner, top, seed, time, low, width = owner[keep], top[keep], seed[keep], time[keep], low[keep], width[keep]
    return best.reshape(n_docs, slots)


def _digests(doc, item, count, n_docs) -> tuple[np.ndarray, np.ndarray]:
    """Two sums per text that do not depend on the order of its shingles."""
    first, second = np.zeros(n_docs, _U), np.zeros(n_docs, _U)
    np.add.at(first, doc, mix(item ^ _U(_STEP)) * count.astype(_U))
    np.add.at(second, doc, mix(item ^ _U(_LEVEL)) * count.astype(_U))
    return mix(first), mix(second)


def _signatures(width: int, slots: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in portions(pdf["text"].tolist()):
                yield one(pdf.iloc[part])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        texts, n = pdf["text"].tolist(), len(pdf)
        doc, item, count = bags(texts, width)
        weight = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
        a, b = _digests(doc, item, count, n)
        bare = weight == 0  # no word: the text itself stands for its content
        a = np.where(bare, mix(pdf["_t"].to_numpy().view(_U)), a)
        b = np.where(bare, mix(a + _U(1)), b)
        times = bag_minhash(doc, item, count, n, slots).view(_U)
        spread = mix(times)
        band = np.zeros((n, slots // rows), _U)
        for k in range(rows):
            band = mix(band * _U(_LEVEL) + spread[:, k::rows])
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].array, "_d": pdf["_d"].array, "_t": pdf["_t"].array, "a": a.view(np.int64),
            "b": b.view(np.int64), "weight": weight,
            "bands": pd.Series([None if z else x.view(np.int64) for x, z in zip(band, bare)], dtype="object"),
            "sig": pd.Series([x.astype("<u2").tobytes() for x in (spread >> _U(48))], dtype="object")})
    return run


def _likeness(slots: int):
    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        left = np.frombuffer(b"".join(x), "<u2").reshape(-1, slots)
        right = np.frombuffer(b"".join(y), "<u2").reshape(-1, slots)
        return pd.Series((left == right).mean(axis=1))
    return alike


def _overlaps(width: int):
    @F.pandas_udf("double")
    def overlap(x: pd.Series, y: pd.Series) -> pd.Series:
        out = [_jaccard(x.iloc[k].tolist(), y.iloc[k].tolist(), width) for k in portions((x + y).tolist())]
        return pd.Series(np.concatenate(out) if out else [], dtype="float64")
    return overlap


def _jaccard(left: list[str], right: list[str], width: int) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    n = len(left)
    doc, item, count = bags([*left, *right], width)
    weight = np.bincount(doc, weights=count, minlength=2 * n)
    pair = doc % n
    order = np.lexsort((item, pair))
    pair, item, count = pair[order], item[order], count[order]
    both = np.flatnonzero((pair[1:] == pair[:-1]) & (item[1:] == item[:-1]))
    shared = np.bincount(pair[both], weights=np.minimum(count[both], count[both + 1]), minlength=n)
    union = weight[:n] + weight[n:] - shared
    return np.where(union > 0, shared / np.maximum(union, 1), 0.0)


def roots(parents: DataFrame) -> DataFrame:
    """``node``, ``label``: the end of each chain of ``parents`` (x, y), where y is always smaller than x.

    Every turn doubles the step; it is written, so a lost executor costs one turn.
    """
    steps = stage(parents.select(F.col("x").alias("node"), F.col("y").alias("label")))
    while True:
        over = steps.select(F.col("node").alias("label"), F.col("label").alias("next"))
        steps = stage(steps.join(over, "label", "left").select(
            "node", F.coalesce("next", "label").alias("label"), F.col("next").isNotNull().alias("moved")))
        if steps.filter("moved").isEmpty():
            ends = steps.select(F.col("label").alias("node"), "label").distinct()
            return steps.select("node", "label").union(ends)
        steps = steps.select("node", "label")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``label``: the smallest node reachable over ``edges`` (x, y).

    Labels spread to neighbours and jump to the label of their label; each turn is written, and
    only the answer whether a label changed reaches the driver.
    """
    both = stage(edges.select("x", "y").union(edges.select("y", "x")).distinct())
    labels = stage(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("label"))
                   .withColumn("was", F.col("node")))
    while not labels.filter(F.col("label") != F.col("was")).isEmpty():
        here = labels.select("node", "label")
        near = both.join(here.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        new = (here.join(near.withColumnRenamed("x", "node"), "node")
               .select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")))
        over = here.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = stage(new.join(over, "label").select("node", F.least("label", "next").alias("label"), "was"))
    return labels.select("node", "label")


def _sized(threshold: float, left: str = "weight", right: str = "_weight") -> Column:
    """The overlap of two multisets is at most the smaller one, their union at least the larger one."""
    return F.least(left, right) >= threshold * F.greatest(left, right) - 1e-6


def _pieces(rows: DataFrame, threshold: float = 0.0, columns: Sequence[str] = ("x", "y")) -> DataFrame:
    """Pairs (x, y) of nodes with different labels (lx, ly) that share a bucket and fit in size.

    ``rows`` have band, keys, node, label and, for a threshold, weight.
    Buckets of one label are done.  Those of at most PIECE members give their pairs; a larger one
    is cut by the next band of its members, and then by one more.  Members that agree in all these
    bands and are still more than PIECE are tied to their leader and to the next one in order.
    """
    found = None
    rows = rows if "weight" in rows.columns else rows.withColumn("weight", F.lit(0))
    for depth in range(len(KEYS)):
        spot = ["band", *KEYS[:depth + 1]]
        stats = (rows.groupBy(*spot).agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"),
                                         F.max("label").alias("hi"), F.min(F.struct("node", "weight", "label")).alias("first"))
                 .filter("lo < hi").select(*spot, "n", "first"))
        mixed = stage(rows.join(stage(stats), spot))
        small = mixed.filter(F.col("n") <= PIECE)
        other = small.select(*spot, F.col("node").alias("y"), F.col("label").alias("_other"), F.col("weight").alias("_weight"))
        pairs = small.join(other, spot).filter((F.col("node") < F.col("y")) & (F.col("label") != F.col("_other")) & _sized(threshold))
        pairs = pairs.select(F.col("node").alias("x"), "y", F.col("label").alias("lx"), F.col("_other").alias("ly"))
        found = pairs if found is None else found.unionByName(pairs)
        rows = mixed.filter(F.col("n") > PIECE)
        if depth + 1 < len(KEYS):
            rows = rows.drop("n", "first")
    star = rows.filter((F.col("label") != F.col("first.label")) & _sized(threshold, "weight", "first.weight")).select(
        F.col("first.node").alias("x"), F.col("node").alias("y"), F.col("first.label").alias("lx"), F.col("label").alias("ly"))
    order = Window.partitionBy("band", *KEYS).orderBy("node")
    last = {name: F.lag(c).over(order).alias(name) for name, c in (("x", "node"), ("lx", "label"), ("_weight", "weight"))}
    chain = (rows.select(*last.values(), F.col("node").alias("y"), F.col("label").alias("ly"), "weight")
             .filter(F.col("x").isNotNull() & (F.col("lx") != F.col("ly")) & _sized(threshold)).select("x", "y", "lx", "ly"))
    return found.unionByName(star).unionByName(chain).select(*columns).distinct()


def _crowded(rows: DataFrame) -> DataFrame:
    """``node``, ``label`` of the members of buckets above PIECE that hold several labels."""
    stats = rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    mixed = stage(stats.filter((F.col("n") > PIECE) & (F.col("lo") < F.col("hi"))).select("band", "key"))
    return stage(rows.join(mixed, ["band", "key"]).select("node", "label").distinct())


def _elements(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of every shingle; its k-th copy is an element of its own, so sets stand for multisets."""
    doc, item, count = bags(texts, width)
    own = np.repeat(np.arange(len(item)), count)
    turn = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    return doc[own], mix(item[own] + turn.astype(_U) * _U(_LEVEL))


def _places(width: int):
    """How many of a task's elements fall into each of PLACES groups of hashes.

    Only groups that hold an element for every SHARE of the task's texts are told, so a task gives no more
    rows than SHARE times the elements of a text, whatever the number of tasks.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, texts = np.zeros(PLACES, np.int64), 0
        for pdf in batches:
            some = pdf["text"].tolist()
            texts += len(some)
            for part in portions(some):
                element = _elements(some[part], width)[1]
                total += np.bincount((element % _U(PLACES)).astype(np.int64), minlength=PLACES)
        place = np.flatnonzero((total > 1) & (total * SHARE >= texts))
        yield pd.DataFrame({"place": place, "n": total[place]})
    return run


def _prefixes(width: int, threshold: float, common: np.ndarray):
    """The rarest elements of each text, as many as it can't miss all and still be similar enough."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in portions(pdf["text"].tolist()):
                yield one(pdf.iloc[part])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        doc, token = _elements(pdf["text"].tolist(), width)
        order = np.lexsort((token, common[(token % _U(PLACES)).astype(np.int64)], doc))
        doc, token = doc[order], token[order]
        weight = np.bincount(doc, minlength=len(pdf))
        most = weight - np.ceil(threshold * weight - 1e-9).astype(np.int64) + 1
        left = np.cumsum(weight)[doc] - np.arange(len(doc))  # this element and those after it
        keep = weight[doc] - left < most[doc]
        doc, token, left = doc[keep], token[keep], left[keep]
        return pd.DataFrame({"node": pdf["node"].to_numpy()[doc], "label": pdf["label"].to_numpy()[doc],
                             "weight": weight[doc], "left": left, "token": token.view(np.int64)})
    return run


def _across(crowd: DataFrame, threshold: float, width: int) -> DataFrame:
    """Pairs (x, y) with different labels (lx, ly) of ``crowd`` (node, label, text) that share a prefix element and fit in
    size, and as ``weight`` how many such elements they share.

    The order of elements is by the count of their place, at most PLACES numbers that go to the
    tasks: any order is exact, this one keeps elements of a hot group out of most prefixes.
    """
    common = np.zeros(PLACES, np.int64)
    for row in (crowd.select("text").mapInPandas(_places(width), "place long, n long").groupBy("place")
                .agg(F.sum("n").alias("n")).filter(F.col("n") > PIECE).toLocalIterator()):
        common[row["place"]] = row["n"]
    tokens = stage(crowd.select("node", "label", "text").mapInPandas(
        _prefixes(width, threshold, common), "node long, label long, weight long, left long, token long"))
    mixed = stage(tokens.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
                  .filter("lo < hi").select("token"))
    rows = stage(tokens.join(mixed, "token"))
    other = rows.select("token", F.col("node").alias("y"), F.col("label").alias("_other"), F.col("weight").alias("_weight"),
                        F.col("left").alias("_left"))
    # At the first element that a pair shares, what is left must still hold the overlap it needs.
    need = threshold / (1 + threshold) * (F.col("weight") + F.col("_weight"))
    fits = F.least("left", "_left") >= need - 1e-6
    return rows.join(other, "token").filter((F.col("node") < F.col("y")) & (F.col("label") != F.col("_other")) & fits).groupBy(
        F.col("node").alias("x"), "y", F.col("label").alias("lx"), F.col("_other").alias("ly")).agg(F.count(F.lit(1)).alias("weight"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, slots: int = SLOTS,
                    rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (smallest id of its class), ``keeper`` and its keys.

    ``keeper`` marks the row of the class with the smallest id; identical rows share the mark.
    With 4 rows a band and 128 slots a pair of similarity 0.8 is missed with a chance below 1e-7.
    """
    base = keyed(docs, id_col, text_col)
    n_bands = slots // rows
    schema = "doc_id long, _d long, _t long, a long, b long, weight long, bands array<long>, sig binary"
    signed = stage(base.drop("_keep").mapInPandas(_signatures(width, slots, rows), schema))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "_d", "_t"))
    contents = stage(signed.groupBy("a", "b").agg(
        first.alias("rep"), F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"),
        F.first("weight").alias("weight"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    further = [F.xxhash64("key", *[F.get("bands", (F.col("band") + k) % n_bands) for k in range(1, depth + 1)])
               .alias(KEYS[depth]) for depth in range(1, len(KEYS))]
    members = (contents.filter("weight > 0").select(F.col("a").alias("node"), "weight", "bands", F.posexplode("bands")
                                                    .alias("band", "key")).select("node", "weight", "band", "key", *further))
    stats = stage(members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "weight")).alias("leader"))
                  .filter("n > 1").drop("n"))
    buckets = stage(members.join(stats, ["band", "key"]))
    # A member with its buckets, at most one per band: what is told of a member is joined once.
    held = stage(buckets.groupBy("node", "weight").agg(F.collect_list(F.struct("band", *KEYS)).alias("at")))
    alike, overlap = _likeness(slots), _overlaps(width)
    sigs = contents.select("a", "sig")
    # Five standard errors below the threshold: no pair at the threshold is lost to the estimate.
    least = threshold - 5 * float(np.sqrt(threshold * (1 - threshold) / slots))

    def likely(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sigs.select(F.col("a").alias("x"), F.col("sig").alias("sx")), "x").join(
            sigs.select(F.col("a").alias("y"), F.col("sig").alias("sy")), "y")
        return both.select("x", "y", alike("sx", "sy").alias("est")).filter(F.col("est") >= least)

    # The texts of all contents in buckets move once; both checks read them from there.
    shared = buckets.select(F.col("node").alias("a")).distinct()
    keys = contents.join(shared, "a").select("a", F.col("rep._d").alias("_d"), F.col("rep._t").alias("_t"))
    known = stage(base.select("_d", "_t", "text").join(keys, ["_d", "_t"]).dropDuplicates(["a"]).select("a", "text"))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(known.select(F.col("a").alias("x"), F.col("text").alias("tx")), "x").join(
            known.select(F.col("a").alias("y"), F.col("text").alias("ty")), "y")
        return stage(both.select("x", "y", overlap("tx", "ty").alias("similarity"))
                     .filter(F.col("similarity") >= threshold).select("x", "y"))

    stars = stage(buckets.filter((F.col("node") != F.col("leader.node")) & _sized(threshold, "weight", "leader.weight"))
                  .groupBy(F.col("node").alias("x"), F.col("leader.node").alias("y"))
                  .agg(F.count(F.lit(1)).alias("bands")))
    # The leader that shares most bands is the likeliest; it is the smallest of its bucket, so one link per member is a forest.
    best = stage(stars.groupBy("x").agg(F.max_by("y", F.struct("bands", "y")).alias("y")))
    labels = roots(verified(likely(best)))

    def labelled(pairs: DataFrame, column: str, name: str, labels: DataFrame) -> DataFrame:
        tags = labels.select(F.col("node").alias(column), F.col("label").alias(name))
        return pairs.join(tags, column, "left").withColumn(name, F.coalesce(name, column))

    def merge(labels: DataFrame, linked: DataFrame) -> DataFrame:
        merged = components(labelled(labelled(linked, "x", "lx", labels), "y", "ly", labels).select(
            F.col("lx").alias("x"), F.col("ly").alias("y")).filter("x <> y"))
        final = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
        return final.select("node", F.coalesce("to", "label").alias("label")).union(
            merged.join(labels, "node", "left_anti").select("node", "label"))

    def link(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """Merge ``labels`` over ``pairs`` (x, y, their labels lx and ly, weight): of every label the heaviest first, then what
        still joins two."""
        ends = stage(pairs.groupBy("x", "y", "lx", "ly").agg(F.max("weight").alias("weight")))
        heavy = F.max_by(F.struct("x", "y"), F.struct("weight", "x", "y")).alias("one")
        either = ends.select(F.col("lx").alias("l"), "x", "y", "weight").unionByName(ends.select(F.col("ly").alias("l"), "x", "y", "weight"))
        first = stage(either.groupBy("l").agg(heavy).select("one.*").distinct())
        labels = stage(merge(labels, verified(likely(first))))
        rest = ends.select("x", "y").join(first, ["x", "y"], "left_anti")
        rest = stage(labelled(labelled(rest, "x", "lx", labels), "y", "ly", labels).filter("lx <> ly").select("x", "y"))
        return stage(merge(labels, verified(likely(rest))))

    def spread(labels: DataFrame) -> DataFrame:
        return labelled(held, "node", "label", labels).select("node", "weight", "label", F.inline("at"))

    # Labels come with the members, so that no pair has to look its own up.
    inside = _pieces(spread(labels), threshold, ("x", "y", "lx", "ly"))
    rest = stars.join(best.select("x", "y"), ["x", "y"], "left_anti")
    rest = labelled(labelled(rest, "x", "lx", labels), "y", "ly", labels).filter("lx <> ly")
    low, high = F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")
    turned = F.col("x") > F.col("y")
    sides = [F.when(turned, F.col("ly")).otherwise(F.col("lx")).alias("lx"), F.when(turned, F.col("lx")).otherwise(F.col("ly")).alias("ly")]
    tried = stage(rest.select(low, high, *sides, F.col("bands").alias("weight")).unionByName(
        inside.select(low, high, *sides, F.lit(0).cast("bigint").alias("weight"))))
    near = link(labels, tried)
    crowd = _crowded(spread(near))
    texts = known.withColumnRenamed("a", "node").join(crowd, "node")
    # A pair that was tried before and still has two labels is no link; it is not looked at again.
    done = tried.select("x", "y").union(best.select(low, high)).distinct()
    final = link(near, _across(texts, threshold, width).join(done, ["x", "y"], "left_anti"))
    # Only contents with copies or links need a look-up; the rest are classes of their own.
    tagged = contents.select("a", "id", "rep", "copies").join(
        final.withColumnRenamed("node", "a"), "a", "left").filter("copies > 1 or label is not null")
    tagged = stage(tagged.withColumn("label", F.coalesce("label", "a")))
    heads = tagged.groupBy("label").agg(F.min("id").alias("class_id"), F.min("rep").alias("head"))
    classes = stage(tagged.join(heads, "label").select("a", "class_id", "head"))
    salted = classes.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows_ = signed.select("doc_id", "_d", "_t", "a", F.pmod(F.xxhash64("_d", "_t"), F.lit(SALTS)).cast("int").alias("_s"))
    out = rows_.join(salted, ["a", "_s"], "left")
    alone = F.col("head").isNull()
    keeper: Column = alone | ((F.col("head._d") == F.col("_d")) & (F.col("head._t") == F.col("_t")))
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      keeper.alias("keeper"), "_d", "_t")
