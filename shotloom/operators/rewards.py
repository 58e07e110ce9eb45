"""Scores of generated storyboards: format, retrieval against episode frames, judge, and their blend."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.functions import fixed_text as T
from shotloom.functions.jsonfix import (array_items, is_text, json_extract_array, json_fields, safe_shot, subject_texts,
                                        with_repaired_items)
from shotloom.functions.templates import QUERY_FIELDS, visual_query
from shotloom.functions.text import let
from shotloom.operators.enrich import enrich_memoised
from shotloom.operators.ordered import attach_stats, global_rank, hash_order, rank_in_group
from shotloom.operators.pairs import block_topk
from shotloom.session import stage


# ---------------------------------------------------------------- format

def _filled(item: Column, raw: Column, fields: Sequence[str]) -> Column:
    """Share of ``fields`` whose value is neither null nor an empty text, list or object."""
    def valid(name: Column) -> Column:
        value = F.try_element_at(raw, name)
        return F.when(value.isin("[]", "{}"), is_text(item, name)).otherwise(F.coalesce(value.rlike(r"(?U)\S"), F.lit(False)))

    return F.size(F.filter(F.array(*[F.lit(f) for f in fields]), valid)) / len(fields)


def shot_format_score(item: Column, raw: Column) -> Column:
    """0.6 · share of the eleven keys present + 0.3 · share of six content values filled + 0.1 · subject coverage.

    ``item`` is an object text and ``raw`` its ``json_fields``.
    """
    keys = F.array(*[F.lit(f) for f in T.SHOT_FIELDS])
    presence = F.size(F.array_intersect(F.map_keys(raw), keys)) / len(T.SHOT_FIELDS)
    people = subject_texts(raw["subjects"], False)
    filled = F.transform(people, lambda s: let(json_fields(s), lambda m: _filled(s, m, T.SUBJECT_FIELDS)))
    coverage = F.try_divide(F.aggregate(filled, F.lit(0.0), lambda a, x: a + x), F.size(filled).cast("double"))
    return 0.6 * presence + 0.3 * _filled(item, raw, T.CONTENT_FIELDS) + 0.1 * F.coalesce(coverage, F.lit(0.0))


def parsed_shots(items: Column) -> Column:
    """ARRAY<STRUCT<item, raw>> of object texts with their fields: the only parse of a shot."""
    return F.transform(items, lambda x: F.struct(x.alias("item"), json_fields(x).alias("raw")))


def format_score(items: Column) -> Column:
    """Mean over the shots of a completion, in [0, 1]; no shots give 0."""
    return score_of_shots(parsed_shots(items))


def score_of_shots(shots: Column) -> Column:
    """``format_score`` of ``parsed_shots``."""
    scores = F.transform(shots, lambda s: shot_format_score(s["item"], s["raw"]))
    return let(scores, lambda x: F.coalesce(F.try_divide(
        F.aggregate(x, F.lit(0.0), lambda a, v: a + v), F.size(x).cast("double")), F.lit(0.0)))


# ---------------------------------------------------------------- judge answers

def validate_indexed_scores(responses: DataFrame, fallback: float = 0.5) -> DataFrame:
    """responses(chunk, expected, response) → chunk, index, score, fallback.

    Indices 1..expected must all carry a score, which is limited to [0, 1]; otherwise the
    whole chunk takes the neutral score.  Of repeated indices the last counts.
    """
    entry = "struct<index:string,score:string>"
    parsed = F.transform(array_items(json_extract_array(F.col("response"))), lambda x: F.from_json(x, entry))
    scored = F.filter(parsed, lambda e: e["score"].isNotNull())
    usable = F.forall(scored, lambda e: e["score"].try_cast("double").isNotNull()
                      & F.coalesce(e["index"], F.lit("0")).try_cast("int").isNotNull())
    number = lambda e: F.coalesce(e["index"], F.lit("0")).try_cast("int")
    entries = F.transform(scored, lambda e, at: F.struct(number(e).alias("i"), at.alias("at"), e["score"].try_cast("double").alias("s")))
    # Sorted by index and place: the last of an index is followed by another one.  A complete chunk then has index i at place i - 1.
    last = let(F.sort_array(entries), lambda v: F.filter(v, lambda x, k: F.coalesce(F.get(v, k + 1)["i"] != x["i"], F.lit(True))))
    inside = F.filter(last, lambda x: x["i"].between(1, F.col("expected")))
    table = responses.select("chunk", "expected", F.when(usable, inside).alias("e"))
    wanted = F.sequence(F.lit(1), F.col("expected").cast("int"))
    rows = table.select("chunk", F.coalesce(F.size("e") == F.col("expected"), F.lit(False)).alias("ok"), "e", F.explode(wanted).alias("index"))
    value = F.when(F.col("ok"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.get("e", F.col("index") - 1)["s"]))).otherwise(fallback)
    return rows.select("chunk", "index", value.alias("score"), (~F.col("ok")).alias("fallback"))


# ---------------------------------------------------------------- retrieval

def negative_episodes(episodes: DataFrame, seed: int = 0) -> DataFrame:
    """episodes(drama, episode) → with the episode to contrast with: neg_drama, neg_episode.

    The next episode of the drama in a hashed circle, so the choice is fixed by the seed; for
    a drama with one episode the next in a circle over all dramas; none in a corpus of one.
    """
    keys = episodes.select("drama", "episode").distinct()
    order = hash_order(F.lit(seed), "drama", "episode")
    ranked = rank_in_group(keys.withColumn("_k", order), ["drama"], [F.col("_k")], F.substring("_k", 1, 3), "_r")
    ranked = stage(global_rank(ranked, F.col("_k"), "_g").withColumn("_one", F.lit(1)))
    per = ranked.groupBy("drama").agg(F.count(F.lit(1)).alias("_n"))
    total = ranked.groupBy("_one").agg(F.count(F.lit(1)).alias("_t"))
    sized = attach_stats(attach_stats(ranked, per, ["drama"]), total, ["_one"])
    target = ranked.select("_r", "_g", F.col("drama").alias("neg_drama"), F.col("episode").alias("neg_episode"))
    home = (sized.filter("_n > 1").withColumn("_next", (F.col("_r") + 1) % F.col("_n"))
            .join(target.select(F.col("neg_drama"), F.col("_r").alias("_next"), "neg_episode")
                  .withColumn("drama", F.col("neg_drama")), ["drama", "_next"]))
    away = (sized.filter("_n = 1 and _t > 1").withColumn("_next", (F.col("_g") + 1) % F.col("_t"))
            .join(target.select(F.col("_g").alias("_next"), "neg_drama", "neg_episode"), "_next"))
    columns = ["drama", "episode", "neg_drama", "neg_episode"]
    return home.select(*columns).unionByName(away.select(*columns))


def retrieval_reward(shot_vectors: DataFrame, episode_vectors: DataFrame, top_k: int = 1, seed: int = 0,
                     key: str = "completion", negatives: DataFrame | None = None) -> DataFrame:
    """shot_vectors(key, pos, drama, episode, vec) vs episode_vectors(item, drama, episode, vec) → key, reward.

    Mean top-k similarity to the own episode's frames against that to a contrast episode:
    0.5 · (pos + 1 − neg), each rescaled to [0, 1].  Without frames 0.5; without contrast pos.
    """
    negatives = negatives if negatives is not None else stage(negative_episodes(episode_vectors, seed))
    shots = shot_vectors.withColumn("shot_key", F.concat_ws("#", key, "pos"))
    own = shots.select("shot_key", "vec", F.lit("own").alias("kind"), "drama", "episode")
    other = attach_stats(shots.select("shot_key", "vec", "drama", "episode"), negatives, ["drama", "episode"]).select(
        "shot_key", "vec", F.lit("neg").alias("kind"), F.col("neg_drama").alias("drama"), F.col("neg_episode").alias("episode"))
    left = own.unionByName(other).withColumn("lid", F.concat_ws("@", "kind", "shot_key"))
    episode = ["drama", "episode"]
    right = episode_vectors.select(*episode, F.col("item").cast("string").alias("item"), F.col("vec").alias("item_vec"))
    best = block_topk(left.select("lid", "vec", *episode), right, episode, "lid", "vec", "item", "item_vec", top_k)
    score = F.col("score")
    own_key = F.regexp_replace(F.regexp_replace("lid", "^(own|neg)@", ""), "#[^#]*$", "")
    means = best.groupBy(own_key.alias("_key")).agg(
        F.avg(F.when(F.col("lid").startswith("own@"), score)).alias("pos"),
        F.avg(F.when(F.col("lid").startswith("neg@"), score)).alias("neg"))
    pos, neg = (F.col("pos") + 1.0) / 2.0, (F.col("neg") + 1.0) / 2.0
    reward = F.when(F.col("pos").isNull(), 0.5).when(F.col("neg").isNull(), pos).otherwise(0.5 * (pos + (1.0 - neg)))
    keys = shot_vectors.select(key).distinct().withColumn("_key", F.col(key).cast("string"))
    return keys.join(means, "_key", "left").select(key, reward.alias("r_retrieval"))


# ---------------------------------------------------------------- blend

def combined_reward(retrieval: Column, video: Column, fmt: Column, n_shots: Column, alpha: Column | float,
                    beta: Column | float, gamma: Column | float) -> Column:
    """α·retrieval + β·video + γ·format; a completion without shots gets −1."""
    blend = F.lit(alpha) * retrieval + F.lit(beta) * video + F.lit(gamma) * fmt
    return F.when(n_shots == 0, F.lit(-1.0)).otherwise(blend)


def completion_parts(completions: DataFrame, text: str = "text") -> DataFrame:
    """Add items, n_shots, r_format, queries and narratives to completions; a map without any shuffle."""
    rows = with_repaired_items(completions, text)
    items = F.coalesce("items", F.array().cast("array<string>"))
    # Each step is a column of its own, so that no text is parsed for two of them.
    rows = rows.withColumn("items", items).withColumn("_shots", parsed_shots(F.col("items")))
    told = (*QUERY_FIELDS, "description_narrative")
    rows = rows.withColumn("_safe", F.transform("_shots", lambda s: safe_shot(s["item"], s["raw"], told)))
    narratives = F.transform("_safe", lambda s: s["description_narrative"])
    return (rows.withColumn("n_shots", F.size("items")).withColumn("r_format", 2.0 * score_of_shots(F.col("_shots")) - 1.0)
            .withColumn("queries", F.transform("_safe", visual_query))
            .withColumn("narratives", F.array_join(narratives, "\n")).drop("_safe", "_shots"))


def reward_completions(completions: DataFrame, episode_vectors: DataFrame, embed: Callable[[Sequence[str]], Sequence],
                       judge: Callable[[Sequence[str]], Sequence], alpha: float = 0.4, beta: float = 0.4,
                       gamma: float = 0.2, top_k: int = 1, seed: int = 0, batch: int = 16, key: str = "completion",
                       negatives: DataFrame | None = None) -> DataFrame:
    """completions(key, drama, episode, text) → key, n_shots, repaired, r_format, r_retrieval, r_video, reward.

    ``embed`` maps texts to vectors and ``judge`` narratives to scores; each distinct text is
    sent once.  A judge failure counts 0.5.
    """
    needed = [key, "drama", "episode", "n_shots", "repaired", "r_format", "queries", "narratives"]
    parts = stage(completion_parts(completions).select(*needed))  # not the texts they were made from
    shots = parts.select(key, "drama", "episode", F.posexplode_outer("queries").alias("pos", "query")).filter("pos is not null")
    embedded, _ = enrich_memoised(shots, "query", embed, "array<double>", batch)
    vectors = embedded.filter(F.col("result").isNotNull()).withColumnRenamed("result", "vec")
    retrieval = retrieval_reward(vectors, episode_vectors, top_k, seed, key, negatives)
    told = parts.filter("n_shots > 0").select(key, "narratives")
    judged, _ = enrich_memoised(told, "narratives", judge, "double", batch, default=F.lit(0.5))
    scored = (parts.select(key, "n_shots", "repaired", "r_format").join(retrieval, key, "left")
              .join(judged.select(key, F.col("result").alias("r_video")), key, "left"))
    r_retrieval = F.when(F.col("n_shots") > 0, F.coalesce("r_retrieval", F.lit(0.5)))
    scored = scored.withColumn("r_retrieval", r_retrieval)
    return scored.withColumn("reward", combined_reward(F.col("r_retrieval"), F.col("r_video"), F.col("r_format"),
                                                       F.col("n_shots"), alpha, beta, gamma))
