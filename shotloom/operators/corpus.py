"""Corpus operators: modality joins, reconcile, backfill and lookups between artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.functions import fixed_text as T
from shotloom.functions.text import last_number, plot_summary, round_half_even, trim_all
from shotloom.operators.ordered import attach_stats, first_rows, hash_order, limit_by_hash

SHOT_KEY = ("drama", "episode", "shot_index")
EPISODE = ("drama", "episode")


# ---------------------------------------------------------------- vectors

def pivot_modalities(embeddings: DataFrame, modalities: Sequence[str] = ("text", "depth", "pose"),
                     key: Sequence[str] = SHOT_KEY) -> DataFrame:
    """One shuffle on the shot key instead of a join per modality; an absent modality is null."""
    return embeddings.groupBy(*key).agg(
        *[F.any_value(F.when(F.col("modality") == m, F.col("vec")), ignoreNulls=True).alias(m) for m in modalities])


def join_modalities(shots: DataFrame, embeddings: DataFrame, key: Sequence[str] = SHOT_KEY) -> DataFrame:
    """Shots that have all three vectors."""
    wide = pivot_modalities(embeddings, key=key).dropna(subset=["text", "depth", "pose"])
    return shots.join(wide, list(key))


def complete_modalities(shots: DataFrame, embeddings: DataFrame, key: Sequence[str] = SHOT_KEY) -> DataFrame:
    """Every shot with a flag: does it have all three vectors."""
    have = embeddings.groupBy(*key).agg(
        F.bit_or(F.when(F.col("modality") == "text", 1).when(F.col("modality") == "depth", 2)
                 .when(F.col("modality") == "pose", 4).otherwise(0)).alias("_have"))
    return (shots.join(have, list(key), "left")
            .withColumn("complete", F.coalesce(F.col("_have"), F.lit(0)).bitwiseAND(7) == 7).drop("_have"))


def pair_depth_pose(embeddings: DataFrame, limit: int = 0, seed: int = 0, key: Sequence[str] = SHOT_KEY) -> DataFrame:
    """Index items: keys that have both image vectors; ``limit`` > 0 keeps a reproducible random part."""
    pairs = pivot_modalities(embeddings, ("depth", "pose"), key).dropna(subset=["depth", "pose"])
    return limit_by_hash(pairs, limit, hash_order(F.lit(seed), *key))


def episode_centroid(vectors: DataFrame, group: Sequence[str], vec: str = "vec") -> DataFrame:
    """Element-wise mean per group: sums of single elements combine before the shuffle."""
    cells = vectors.select(*group, F.posexplode(vec).alias("_i", "_x"))
    means = cells.groupBy(*group, "_i").agg(F.avg("_x").alias("_m"), F.count(F.lit(1)).alias("_n"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_m")))
    return means.groupBy(*group).agg(F.max("_n").alias("n"), F.transform(ordered, lambda s: s["_m"]).alias("centroid"))


# ---------------------------------------------------------------- reconcile and backfill

def reconcile_counts(shots: DataFrame, timeline: DataFrame, transcripts: DataFrame) -> DataFrame:
    """drama, episode, n_shot, n_timeline, n_transcript, status, action.

    The action says what the mismatch calls for; nothing is deleted.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias(name))

    c = (counted(shots, "n_shot").join(counted(timeline, "n_timeline"), list(EPISODE), "full")
         .join(counted(transcripts, "n_transcript"), list(EPISODE), "full"))
    n_shot, n_time, n_text = F.col("n_shot"), F.col("n_timeline"), F.col("n_transcript")
    both = n_time.isNotNull() & n_text.isNotNull()
    status = (F.when(n_shot.isNull(), T.MISSING_SHOT).when(~both, T.MISSING_FILE)
              .when((n_shot == n_time) & (n_time == n_text), "OK").otherwise(T.COUNT_MISMATCH))
    action = (F.when(n_shot.isNull() | ~both, "none").when(n_text != n_time, "drop_transcript_and_shot")
              .when(n_shot != n_time, "drop_shot").otherwise("none"))
    return (c.filter(n_shot.isNotNull() | n_time.isNotNull())
            .select(*EPISODE, "n_shot", "n_timeline", "n_transcript", status.alias("status"), action.alias("action")))


def reconcile_summary(reconciled: DataFrame) -> DataFrame:
    return reconciled.agg(F.count_if(F.col("status") == "OK").alias("ok"),
                          F.count_if(F.col("status") != "OK").alias("errors"),
                          F.count_if(F.col("status") == T.MISSING_SHOT).alias("missing_shots"),
                          F.count_if(F.col("action") == "drop_shot").alias("drop_shot"),
                          F.count_if(F.col("action") == "drop_transcript_and_shot").alias("drop_transcript_and_shot"))


def missing_shots(timeline: DataFrame, shots: DataFrame) -> DataFrame:
    """Episodes of the timeline that have no shot rows."""
    return timeline.select(*EPISODE).distinct().join(shots.select(*EPISODE).distinct(), list(EPISODE), "left_anti")


def backfill_dialogue_duration(shots: DataFrame, timeline: DataFrame, transcripts: DataFrame,
                               digits: int = 1) -> DataFrame:
    """Set dialogue and duration of shots in episodes whose counts agree.

    shots(drama, episode, seq, index, …): a null index is the position in the document.
    """
    ok = reconcile_counts(shots, timeline, transcripts).filter(F.col("status") == "OK").select(*EPISODE)
    rows = (shots.join(ok, list(EPISODE), "left_semi").withColumn("index", F.coalesce("index", "seq"))
            .drop("dialogue", "duration"))
    text = transcripts.select(*EPISODE, F.col("idx").alias("index"), F.col("text").alias("_text"))
    span = timeline.select(*EPISODE, F.col("segment_index").alias("index"),
                           round_half_even(F.col("end_sec") - F.col("start_sec"), digits).alias("_span"))
    key = [*EPISODE, "index"]
    return (rows.join(text, key, "left").join(span, key, "left")
            .withColumn("dialogue", F.coalesce("_text", F.lit("")))
            .withColumn("duration", F.coalesce("_span", F.lit(0.0))).drop("_text", "_span"))


def transcript_coverage(transcripts: DataFrame) -> DataFrame:
    """Non-empty and all transcript rows per episode."""
    filled = F.count_if(F.col("text") != "")
    return transcripts.groupBy(*EPISODE).agg(filled.alias("filled"), F.count(F.lit(1)).alias("total"),
                                             F.try_divide(filled, F.count(F.lit(1))).alias("ratio"))


def repair_tasks(listing: DataFrame, plots: DataFrame, timeline: DataFrame) -> DataFrame:
    """listing(drama, file) of transcript files → drama, episode, expected_count of those to repair.

    A plot must exist, ``fixed_<episode>.json`` must not; the expected count is null without a timeline.
    """
    stem = F.regexp_replace("file", r"\.json$", "")
    files = listing.filter(F.col("file").endswith(".json")).select("drama", stem.alias("episode"))
    fixed = files.filter(F.col("episode").startswith("fixed_")).select("drama", F.substr("episode", F.lit(7)).alias("episode"))
    todo = files.filter(~F.col("episode").startswith("fixed_")).join(fixed, list(EPISODE), "left_anti")
    expected = timeline.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("expected_count"))

    def named(df: DataFrame) -> DataFrame:
        return df.withColumn("episode", F.col("episode").cast("string"))

    return (todo.join(named(plots.select(*EPISODE).distinct()), list(EPISODE), "left_semi")
            .join(named(expected), list(EPISODE), "left"))


def validate_expected_count(parsed: DataFrame, expected: DataFrame) -> DataFrame:
    """Per episode: rows found, rows expected, and whether they agree (an unknown expectation accepts any)."""
    found = parsed.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("found"))
    want = expected.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("expected"))
    joined = want.join(found, list(EPISODE), "full").withColumn("found", F.coalesce("found", F.lit(0)))
    return joined.withColumn("valid", F.col("expected").isNull() | (F.col("expected") == F.col("found")))


def label_keyframes(keyframes: DataFrame, transcripts: DataFrame, timeline: DataFrame, digits: int = 2) -> DataFrame:
    """keyframes(drama, episode, seq, file) → idx and the label shown beside each image.

    The index is the last number of the file name, else the position.  Text and length are
    shown only for an episode that has transcripts.
    """
    key = [*EPISODE, "idx"]
    idx = F.coalesce(last_number(F.col("file")), F.col("seq").cast("int")).alias("idx")
    text = transcripts.select(*EPISODE, F.col("idx").cast("int").alias("idx"), trim_all(F.col("text")).alias("_text"))
    span = timeline.select(*EPISODE, F.col("segment_index").cast("int").alias("idx"),
                           round_half_even(F.col("end_sec") - F.col("start_sec"), digits).alias("_span"))
    have = transcripts.select(*EPISODE).distinct().withColumn("_have", F.lit(True))
    rows = (keyframes.select(*EPISODE, "seq", "file", idx).join(text, key, "left").join(span, key, "left")
            .join(have, list(EPISODE), "left"))
    number = F.format_string("[分镜%03d", "idx")
    line = F.when(F.coalesce("_text", F.lit("")) != "", F.col("_text")).otherwise(T.NO_DIALOGUE)
    full = F.concat(number, F.lit(" | 台词："), line, F.lit(" | 时长："),
                    F.coalesce("_span", F.lit(0.0)).cast("string"), F.lit("秒]"))
    label = F.when(F.col("_have"), full).otherwise(F.concat(number, F.lit("]")))
    return rows.select(*EPISODE, "seq", "file", "idx", label.alias("label"))


def existing_keyframes(segments: DataFrame, files: DataFrame) -> DataFrame:
    """Segments whose keyframe(drama, episode, file) exists; order by segment_index when writing."""
    named = segments.filter(F.col("keyframe_filename").isNotNull()).withColumn("file", F.col("keyframe_filename"))
    return named.join(files.select(*EPISODE, "file").distinct(), [*EPISODE, "file"], "left_semi").drop("file")


# ---------------------------------------------------------------- plots and splits for scoring

def plot_episode_map(plots: DataFrame) -> DataFrame:
    """Trimmed plot text → one episode; of equal texts the last in (drama, episode) order wins."""
    keyed = plots.withColumn("summary", trim_all(F.col("plot_summary"))).filter(F.col("summary") != "")
    return keyed.groupBy("summary").agg(F.max(F.struct("drama", "episode")).alias("_e")).select("summary", "_e.*")


def match_plot_episode(samples: DataFrame, plots: DataFrame, user: str = "user_text") -> DataFrame:
    """Add drama and episode to samples whose plot section equals a plot; the join key is its hash."""
    keyed = samples.withColumn("summary", plot_summary(F.col(user))).withColumn("_h", F.xxhash64("summary"))
    target = plot_episode_map(plots).withColumn("_h", F.xxhash64("summary"))
    return attach_stats(keyed, target, ["_h", "summary"]).drop("_h")


def needed_episodes(*matched: DataFrame) -> DataFrame:
    """Distinct episodes over several matched files."""
    keys = matched[0].select(*EPISODE)
    for m in matched[1:]:
        keys = keys.unionByName(m.select(*EPISODE))
    return keys.distinct()


def load_rl_split(samples: DataFrame, plots: DataFrame, vectors: DataFrame, split: str,
                  max_samples: int | None = None, order: str = "sample_index") -> tuple[DataFrame, DataFrame]:
    """Samples with an episode that has vectors, and one row of counts over the samples read.

    With ``max_samples`` reading stops once that many were kept, so later misses are not counted.
    """
    matched = match_plot_episode(samples, plots)
    have = vectors.select(*EPISODE).distinct()
    kept = matched.join(have, list(EPISODE), "left_semi").withColumn("split", F.lit(split))
    flags = samples.select(order).join(kept.select(order, F.lit(1).alias("_kept")), order, "left")
    if max_samples is not None:
        kept = first_rows(kept, max_samples, order)
        # One row: where reading stops, or null when fewer samples match.
        stop = kept.agg(F.when(F.count(F.lit(1)) >= max_samples, F.max(order)).alias("_stop")).withColumn("_g", F.lit(1))
        flags = (attach_stats(flags.withColumn("_g", F.lit(1)), stop, ["_g"])
                 .filter(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop"))))
    return kept, match_rate(flags, F.col("_kept").isNotNull())


def match_rate(rows: DataFrame, kept) -> DataFrame:
    counts = rows.agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("skipped"))
    total = F.greatest(F.col("kept") + F.col("skipped"), F.lit(1))
    return counts.withColumn("skip_pct", F.round(F.col("skipped") / total * 100, 1))
