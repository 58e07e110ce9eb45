"""Readers for the corpus tree, and the parsers they share with in-memory documents.

A reader lists or reads files; a parser takes a DataFrame of texts.  File contents are
not read where only the path matters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.functions.fixed_text import IMAGE_SUFFIXES, VIDEO_SUFFIXES
from shotloom.functions.text import round_half_even, trim_all
from shotloom.operators.ordered import attach_stats, first_keys, first_per_key, first_rows, hash_order, rank_by_text

SEGMENT = ("struct<segment_index:int,video_filename:string,keyframe_filename:string,start_frame:int,end_frame:int,"
           "num_frames:int,start_sec:double,end_sec:double,fps:double>")
TIMELINE = f"version int, source_video string, fps double, total_frames int, segments array<{SEGMENT}>"
PLOT = "characters array<struct<name:string,features:string>>, plot_summary string, dialogues array<string>"
SUBJECT = "struct<name:string,gender:string,clothing:string,position:string,action:string,expression:string>"
SHOT = (f"struct<index:int,shot_scale:string,camera_angle:string,camera_motion:string,subjects:array<{SUBJECT}>,"
        "background:string,description_narrative:string,description_visual:string,description:string,dialogue:string,"
        "speaker:string,emotion:string,duration:string>")
INFER = "sample_index int, user string, ground_truth string, model_output string"
RUNS = "signature string, status string, elapsed_s string, timestamp string"


# ---------------------------------------------------------------- readers

def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, modified, length of all files below ``root``; contents are pruned from the scan."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
            .load(root).select("path", F.col("modificationTime").alias("modified"), "length"))


def read_texts(spark: SparkSession, path: str, pattern: str = "*.json", whole: bool = True) -> DataFrame:
    """path, value: one row per file, as these documents are one JSON value each, or without ``whole`` one per line."""
    return (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
            .text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("path"), "value"))


def read_infer_results(spark: SparkSession, path: str) -> DataFrame:
    """Files of JSON arrays → source (file stem), sample_index, user, ground_truth, model_output."""
    raw = spark.read.schema(INFER).option("multiLine", "true").json(path)
    return raw.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("source"), "*")


def read_sft(spark: SparkSession, path: str) -> DataFrame:
    return sft_columns(spark.read.parquet(path))


def read_runs(spark: SparkSession, path: str, metrics: Sequence[str] = ()) -> DataFrame:
    schema = RUNS + "".join(f", `{m}` double" for m in metrics)
    return spark.read.schema(schema).option("header", "true").csv(path)


# ---------------------------------------------------------------- path keys

def with_episode_parts(df: DataFrame, path: str = "path") -> DataFrame:
    """Add drama (parent folder), file, stem and lower-case suffix."""
    file = F.element_at(F.split(path, "/"), -1)
    return (df.withColumn("drama", F.element_at(F.split(path, "/"), -2)).withColumn("file", file)
            .withColumn("stem", F.regexp_replace("file", r"\.[^.]*$", ""))
            .withColumn("suffix", F.lower(F.regexp_extract("file", r"\.([^.]*)$", 1))))


def episode_paths(files: DataFrame, suffixes: Sequence[str] = VIDEO_SUFFIXES) -> DataFrame:
    """drama, episode, path: a numeric stem is the episode, else its place in the drama (numbers first)."""
    parts = with_episode_parts(files).filter(F.col("suffix").isin(*suffixes))
    # A stem of more digits than a number holds is a name.
    number = F.when(F.col("stem").rlike("^[0-9]+$"), F.col("stem").try_cast("bigint"))
    parts = parts.select("drama", "stem", "path", number.alias("_number"))
    numbers = parts.groupBy("drama").agg(F.count("_number").alias("_before"))
    named = rank_by_text(parts.filter("_number is null"), ["drama"], ["stem", "path"], "_place")
    placed = attach_stats(named, numbers, ["drama"]).select(
        "drama", (F.col("_before") + F.col("_place") + 1).alias("episode"), "path")
    return parts.filter("_number is not null").select("drama", F.col("_number").alias("episode"), "path").unionByName(placed)


def modality_images(files: DataFrame, modality: str, legacy: bool = False,
                    suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    """files(path) relative to the root → path, key parts and the relative output path.

    ``<drama>/<episode>/<modality>/<file>``, or with ``legacy`` any file below ``<modality>/``.
    """
    parts = F.split("path", "/")
    file = F.element_at(parts, -1)
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    images = files.filter(F.lower(F.regexp_extract(file, r"\.([^.]*)$", 1)).isin(*suffixes))
    if legacy:
        rel = F.regexp_replace(F.array_join(F.slice(parts, 2, F.size(parts)), "/"), r"\.[^./]*$", ".npy")
        return images.filter(parts[0] == modality).select("path", rel.alias("output"))
    return images.filter((F.size(parts) == 4) & (parts[2] == modality)).select(
        "path", parts[0].alias("drama"), parts[1].alias("episode"), stem.alias("stem"),
        F.concat_ws("/", parts[0], parts[1], F.concat(stem, F.lit(".npy"))).alias("output"))


def resolve_embedding_layout(files: DataFrame) -> DataFrame:
    """modality, drama, episode, shot_index, path of vector files; the nested layout wins over the flat one."""
    pattern = r"^(?:.*?/)??(text|depth|pose)_emb/(?:(text|depth|pose)_emb/)?([^/]+)/([^/]+)/keyframe_([0-9]+)\.npy$"
    part = {n: F.regexp_extract("path", pattern, i) for i, n in ((1, "modality"), (2, "inner"), (3, "drama"),
                                                                 (4, "episode"), (5, "shot_index"))}
    keyed = files.filter(F.col("path").rlike(pattern)).select("path", *[c.alias(n) for n, c in part.items()])
    keyed = keyed.filter((F.col("inner") == "") | (F.col("inner") == F.col("modality"))).withColumn(
        "priority", F.when(F.col("inner") != "", 0).otherwise(1))
    best = first_per_key(keyed, ["modality", "drama", "episode", "shot_index"], ["priority", "path"], [])
    return best.withColumn("shot_index", F.col("shot_index").cast("int"))


def shots_per_directory(files: DataFrame, suffixes: Sequence[str] = ("mp4", "avi", "mov", "mkv")) -> DataFrame:
    """directory (the whole parent path), place, path, total: clips of each folder in name order."""
    parts = with_episode_parts(files).filter(F.col("suffix").isin(*suffixes)).select(
        F.regexp_replace("path", "/?[^/]*$", "").alias("directory"), "file", "path")
    ranked = rank_by_text(parts, ["directory"], ["file", "path"], "place")
    totals = parts.groupBy("directory").agg(F.count(F.lit(1)).alias("total"))
    return attach_stats(ranked.select("directory", "place", "path"), totals, ["directory"])


def sample_shots(files: DataFrame, shot_counts: Sequence[str] = (), samples: Sequence[str] = (),
                 sample_limit: int = 0, select: str = "first", shot_limit: int = 0, seed: int = 0) -> DataFrame:
    """Shots that have a first frame, from ``shot_count_N/sample_*/shots/shot_*/first_frame.jpg`` paths."""
    pattern = r"(?:^|/)(shot_count_[^/]+)/(sample_[^/]+)/shots/(shot_[^/]+)/first_frame\.jpg$"
    found = files.select("path", *[F.regexp_extract("path", pattern, i).alias(n) for i, n in
                                   ((1, "shot_count"), (2, "sample"), (3, "shot"))]).filter("shot_count <> ''")
    if shot_counts:
        wanted = [c if c.startswith("shot_count_") else f"shot_count_{c}" for c in shot_counts]
        found = found.filter(F.col("shot_count").isin(*wanted))
    if samples:
        found = found.filter(F.col("sample").isin(*samples))
    order = ["shot_count", "sample"]
    if sample_limit > 0:
        found = first_keys(found, sample_limit, order, [hash_order(F.lit(seed), *order)] if select == "random" else [])
    found = found.select(*order, "shot", F.col("path").alias("first_frame"))
    return first_rows(found, shot_limit, *order, "shot", "first_frame") if shot_limit > 0 else found


def expected_files(manifests: DataFrame) -> DataFrame:
    """manifests(sample, shots JSON text) → sample, path, label of every file a sample must have, or an error row."""
    shots = F.from_json(F.get_json_object("manifest", "$.shots"), "array<struct<shot_dir:string>>")
    is_list = F.coalesce(trim_all(F.get_json_object("manifest", "$.shots")).startswith("["), F.lit(False))
    parsed = manifests.select("sample", F.when(is_list, shots).alias("shots"))
    bad = parsed.filter(F.col("shots").isNull()).select("sample", F.lit(None).cast("string").alias("path"),
                                                        F.lit("manifest has no shots list").alias("label"))
    per_shot = parsed.select("sample", F.explode("shots").alias("s"))
    names = (("metadata.json", "shot metadata"), ("prompt.txt", "shot prompt"),
             ("controls/01_depth.png", "depth control image"), ("controls/02_pose.png", "pose control image"))
    wanted = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(label).alias("label")) for f, label in names]))
    ok = (per_shot.filter(F.coalesce("s.shot_dir", F.lit("")) != "").withColumn("w", wanted)
          .select("sample", F.concat_ws("/", "s.shot_dir", "w.f").alias("path"), "w.label"))
    invalid = per_shot.filter(F.coalesce("s.shot_dir", F.lit("")) == "").select(
        "sample", F.lit(None).cast("string").alias("path"), F.lit("invalid shot entry").alias("label"))
    return ok.unionByName(bad).unionByName(invalid)


def missing_files(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """sample, path, label of what is wrong or absent."""
    return expected_files(manifests).join(files.select("path").distinct(), "path", "left_anti").select(
        "sample", "path", "label")


# ---------------------------------------------------------------- parsers

def parse_timeline(docs: DataFrame, digits: int = 2) -> DataFrame:
    """docs(drama, episode, value) → one row per segment with its duration."""
    seg = docs.select("drama", "episode", F.explode(F.from_json("value", TIMELINE)["segments"]).alias("s"))
    return seg.select("drama", "episode", "s.*").withColumn(
        "duration", round_half_even(F.col("end_sec") - F.col("start_sec"), digits))


def parse_transcripts(docs: DataFrame) -> DataFrame:
    """docs(drama, episode, value) → idx, text; a key that is no integer gives a null idx."""
    pairs = docs.select("drama", "episode", F.explode(F.from_json("value", "map<string,string>")).alias("k", "text"))
    return pairs.select("drama", "episode", F.col("k").try_cast("int").alias("idx"), "text")


def parse_plots(docs: DataFrame) -> DataFrame:
    """docs(drama, episode, value) → plots with anything in summary, dialogues or characters."""
    p = docs.select("drama", "episode", F.from_json("value", PLOT).alias("p")).select("drama", "episode", "p.*")
    return p.filter((F.coalesce("plot_summary", F.lit("")) != "") | (F.coalesce(F.size("dialogues"), F.lit(0)) > 0)
                    | (F.coalesce(F.size("characters"), F.lit(0)) > 0))


def valid_shots(shots: DataFrame) -> DataFrame:
    """Shots with an index and a description: the visual one, or the plain one where that is empty."""
    visual = F.when(F.coalesce("description_visual", F.lit("")) != "", F.col("description_visual"))
    text = trim_all(F.coalesce(visual, F.col("description"), F.lit("")))
    return (shots.withColumn("description", text)
            .filter(F.col("index").isNotNull() & (F.col("description") != "")))


def parse_shots(docs: DataFrame) -> DataFrame:
    """docs(drama, episode, value) → seq and the fields of each shot; an unreadable document gives no row."""
    parsed = F.from_json("value", f"array<{SHOT}>")
    whole = F.when(F.ltrim("value").startswith("["), parsed)
    return docs.select("drama", "episode", F.posexplode(whole).alias("seq", "s")).select("drama", "episode", "seq", "s.*")


def sft_columns(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").cast("string"), F.col("task_type").cast("string"), F.col("text").cast("string"),
                       F.col("response_start_char").cast("int"))


def last_per_signature(runs: DataFrame, order: Column | str) -> DataFrame:
    """The run row written last for each signature."""
    payload = [c for c in runs.columns if c != "signature"]
    order = F.col(order) if isinstance(order, str) else order
    return (runs.groupBy("signature").agg(F.max_by(F.struct(*payload), F.struct(order)).alias("_r"))
            .select("signature", "_r.*"))
