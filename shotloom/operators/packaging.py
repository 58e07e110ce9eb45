"""From model outputs to video inputs, prompts, references and retrieval packages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.functions import text as X
from shotloom.functions.fixed_text import CAST_TITLE, IMAGE_ENDINGS, PLOT_TITLE
from shotloom.functions.jsonfix import array_items, json_extract_array, normalize_shot
from shotloom.functions.templates import control_prompt, shot_prompt
from shotloom.operators.ordered import first_keys, hash_order
from shotloom.operators.retrieval import retrieve_topk

PREVIEW = 1000
BAD_OUTPUT = "ValueError: Could not parse model_output into a JSON array."


# ---------------------------------------------------------------- video inputs

def video_inputs(outputs: DataFrame) -> DataFrame:
    """outputs(source_file, sample_index, user, model_output) → parsed rows; ``shots`` is null for a bad output.

    A map over rows: the document of a sample is its row, so nothing is grouped.  Several sinks
    read the result; stage it before they do.
    """
    array = json_extract_array(F.col("model_output"))
    rows = outputs.withColumn("_a", array).withColumn(
        "_s", F.transform(array_items(F.col("_a")), lambda x: normalize_shot(x)))
    shot = F.transform("_s", lambda s: F.struct(s["index"].alias("shot_index"), s["duration"].alias("duration"),
                                                shot_prompt(s).alias("prompt"), s.alias("storyboard")))
    return rows.select("source_file", "sample_index", X.extract_section(F.col("user"), PLOT_TITLE).alias("story_summary"),
                       X.extract_section(F.col("user"), CAST_TITLE).alias("characters"), F.col("user").alias("user_prompt"),
                       shot.alias("shots"), F.substring("model_output", 1, PREVIEW).alias("preview"))


def _stem(c: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(.)\.[^.]*$", "$1")


def manifest_rows(inputs: DataFrame, output_dir: str) -> DataFrame:
    """Good rows with the paths of their three documents."""
    def path(kind: str, ext: str) -> Column:
        return F.format_string(f"{output_dir}/{kind}/%s/sample_%03d.{ext}", _stem(F.col("source_file")), "sample_index")

    return inputs.filter(F.col("shots").isNotNull()).select(
        "source_file", "sample_index", path("storyboards", "json").alias("storyboard_path"),
        path("video_inputs", "json").alias("video_input_path"), path("prompt_text", "txt").alias("prompt_text_path"),
        F.size("shots").alias("num_shots"))


def error_rows(inputs: DataFrame) -> DataFrame:
    return inputs.filter(F.col("shots").isNull()).select(
        "source_file", "sample_index", F.lit(BAD_OUTPUT).alias("error"), F.col("preview").alias("model_output_preview"))


def sample_documents(inputs: DataFrame) -> DataFrame:
    """source_file, sample_index, document: the nested video input as JSON text."""
    doc = F.struct("source_file", "sample_index", "story_summary", "characters", "user_prompt", "shots")
    return inputs.filter(F.col("shots").isNotNull()).select(
        "source_file", "sample_index", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


def prompt_text(inputs: DataFrame) -> DataFrame:
    """source_file, sample_index, text: header and two lines per shot."""
    def or_empty(c: str) -> Column:
        return F.when(F.coalesce(F.col(c), F.lit("")) == "", "(empty)").otherwise(F.col(c))

    def shot(s: Column) -> Column:
        seconds = F.when(s["duration"].isNull(), "unknown").otherwise(F.format_string("%.1fs", s["duration"]))
        return F.concat(F.lit("- Shot "), F.coalesce(s["shot_index"], F.lit("None")), F.lit(" | "), seconds, F.lit("\n"),
                        s["prompt"])

    head = F.concat(F.lit("Source File: "), _stem(F.col("source_file")), F.lit("\nSample Index: "),
                    F.col("sample_index").cast("string"), F.lit("\n\nStory Summary:\n"), or_empty("story_summary"),
                    F.lit("\n\nCharacters:\n"), or_empty("characters"), F.lit("\n\nShot Prompts:"))
    body = F.array_join(F.transform("shots", shot), "\n\n")
    text = F.when(F.size("shots") > 0, F.concat(head, F.lit("\n"), body)).otherwise(head)
    return inputs.filter(F.col("shots").isNotNull()).select("source_file", "sample_index",
                                                            F.concat(text, F.lit("\n")).alias("text"))


def sample_query_shots(inputs: DataFrame, samples: int, shots_per_sample: int, seed: int = 0) -> DataFrame:
    """Queries from up to ``samples`` files and ``shots_per_sample`` shots of each, in hashed order; ≤ 0 takes all.

    inputs(source_file, sample_index, shots ARRAY); a shot without a prompt uses up its draw, as it does when drawn.
    """
    keys = ["source_file", "sample_index"]
    files = first_keys(inputs, samples, keys, [hash_order(F.lit(seed), *keys)])
    tagged = F.transform("shots", lambda s, i: F.struct(
        F.md5(F.concat_ws("|", F.lit(seed).cast("string"), "source_file", F.col("sample_index").cast("string"),
                          i.cast("string"))).alias("k"), i.alias("i"), s.alias("s")))
    drawn = F.array_sort(tagged) if shots_per_sample <= 0 else F.slice(F.array_sort(tagged), 1, shots_per_sample)
    rows = files.select("source_file", "sample_index", F.explode(drawn).alias("d"))
    prompt = X.trim_all(F.coalesce("d.s.prompt", F.lit("")))
    return (rows.select("source_file", "sample_index", F.col("d.s.shot_index").alias("shot_index"), prompt.alias("prompt"),
                        F.col("d.s.duration").cast("string").try_cast("double").alias("duration"))
            .filter(F.col("prompt") != ""))


# ---------------------------------------------------------------- prompt lookup

def build_prompt_index(docs: DataFrame) -> DataFrame:
    """docs(shot_count, path, value) → one prompt per (shot_count, sample_idx, shot_idx); a later path overwrites.

    The sample index is a field of the document, else a number in the file name.
    """
    entry = "struct<shot_index:string,prompt:string,duration:string>"
    name = F.element_at(F.split("path", "/"), -1)
    p = docs.select("shot_count", "path", F.get_json_object("value", "$.sample_index").alias("field"), F.transform(
        array_items(F.get_json_object("value", "$.shots")), lambda x: F.from_json(x, entry)).alias("shots"))
    sample = F.coalesce(F.col("field").try_cast("int"), F.regexp_extract(name, r"^sample_([0-9]+)\.json$", 1).try_cast("int"))
    rows = p.select("shot_count", "path", sample.alias("sample_idx"), F.posexplode("shots").alias("at", "s"))
    shots = rows.select("shot_count", "path", "sample_idx", "at", F.col("s.shot_index").try_cast("int").alias("shot_idx"),
                        X.trim_all(F.coalesce("s.prompt", F.lit(""))).alias("prompt"), F.col("s.duration").alias("duration_raw"))
    usable = shots.filter("sample_idx is not null and shot_idx is not null and prompt <> ''")
    return usable.groupBy("shot_count", "sample_idx", "shot_idx").agg(
        F.max(F.struct("path", "at", "prompt", "duration_raw")).alias("_e")).select(
        "shot_count", "sample_idx", "shot_idx", "_e.prompt", "_e.duration_raw", F.col("_e.path").alias("source_file"))


def resolve_prompts(tasks: DataFrame, index: DataFrame, fallback_duration: str = "5") -> DataFrame:
    """tasks(shot_count, sample, shot) → prompt and duration, or which level of the lookup failed."""
    keyed = tasks.withColumn("sample_idx", X.sample_index(F.col("sample"))).withColumn("shot_idx", X.shot_index(F.col("shot")))
    counts = index.select("shot_count").distinct().withColumn("_c", F.lit(True))
    samples = index.select("shot_count", "sample_idx").distinct().withColumn("_s", F.lit(True))
    found = (keyed.join(counts, "shot_count", "left").join(samples, ["shot_count", "sample_idx"], "left")
             .join(index, ["shot_count", "sample_idx", "shot_idx"], "left"))
    error = (F.when(F.col("sample_idx").isNull(), F.concat(F.lit("Cannot parse sample index from "), "sample"))
             .when(F.col("shot_idx").isNull(), F.concat(F.lit("Cannot parse shot index from "), "shot"))
             .when(F.col("_c").isNull(), F.concat(F.lit("No prompt source index loaded for "), "shot_count"))
             .when(F.col("_s").isNull(), F.concat(F.lit("No prompt source sample found for "), "shot_count", F.lit("/"), "sample"))
             .when(F.col("prompt").isNull(), F.concat(F.lit("No prompt source shot found for "), "shot_count", F.lit("/"),
                                                      "sample", F.lit("/"), "shot")))
    duration = F.when(error.isNull(), X.duration_enum(F.col("duration_raw"), fallback_duration))
    return found.select("shot_count", "sample", "shot", "prompt", duration.alias("duration"), "source_file", error.alias("error"))


# ---------------------------------------------------------------- references and images

def match_character_refs(shots: DataFrame, refs: DataFrame) -> DataFrame:
    """shots(sample, shot, search) with the names of their sample's refs(sample, place, name) found in the text.

    The few names of a sample become one list, and every shot looks for the names of its list in its own
    text: each text is met once and only the lists are looked up.
    """
    names = refs.filter(F.coalesce("name", F.lit("")) != "").groupBy("sample").agg(
        F.sort_array(F.collect_list(F.struct("place", "name"))).alias("_names"))
    here = F.filter("_names", lambda x: F.col("search").contains(x["name"]))
    found = F.coalesce(F.transform(here, lambda x: x["name"]), F.array().cast("array<string>"))
    return shots.join(names, "sample", "left").withColumn("refs", found).drop("_names")


def resolve_image_path(items: DataFrame, listing: DataFrame, root_name: str = "",
                       extensions: Sequence[str] = IMAGE_ENDINGS) -> DataFrame:
    """items(item, rel) → image: the first candidate that listing(path) holds, or null.

    Candidates in order: the path, then without a leading root or embedding folder; as is,
    then with ``#U`` codes decoded; plain, then ``_generated``; lower-case endings before upper-case.
    """
    rel = F.col("rel")
    parts = F.split(rel, "/")
    cut = F.when((F.size(parts) >= 2) & parts[0].isin(root_name, "depth_emb", "pose_emb"),
                 F.array_join(F.slice(parts, 2, F.size(parts)), "/"))
    stems = F.transform(F.array_compact(F.array(rel, cut)), lambda p: F.regexp_replace(p, r"(.)\.[^./]*$", "$1"))
    forms = F.flatten(F.transform(stems, lambda p: F.array(p, X.decode_u_escapes(p))))
    bases = F.flatten(F.transform(forms, lambda p: F.array(p, F.concat(p, F.lit("_generated")))))
    ends = F.array(*[F.lit(e) for e in extensions], *[F.lit(e.upper()) for e in extensions])
    names = F.flatten(F.transform(bases, lambda b: F.transform(ends, lambda e: F.concat(b, e))))
    candidates = items.select("item", F.posexplode(names).alias("priority", "path"))
    hit = candidates.join(listing.select("path").distinct(), "path")
    best = hit.groupBy("item").agg(F.min(F.struct("priority", "path"))["path"].alias("image"))
    return items.join(best, "item", "left")


# ---------------------------------------------------------------- retrieval package

def retrieval_package(queries: DataFrame, index: DataFrame, images: DataFrame, k: int = 5, out_dir: str = "out") -> DataFrame:
    """One row per query and rank, with the task made from the best match on its first row.

    queries(query_id, folder, stem, sample_index, shot_index, serial, duration, prompt, vec),
    index(item_id, drama, episode, keyframe, vec), images(item_id, depth_image, pose_image).
    """
    found = retrieve_topk(queries, index, k)
    cand = index.drop("vec").join(images, "item_id", "left")
    rows = found.join(cand, "item_id").join(queries.drop("vec"), "query_id")
    task = X.task_id(F.col("folder"), F.col("stem"), F.col("sample_index"), F.col("shot_index"), F.col("serial"))
    ready = F.col("depth_image").isNotNull() & F.col("pose_image").isNotNull()
    first = F.col("rank") == 1
    return rows.select(
        "query_id", "rank", "score", "item_id", "drama", "episode", "keyframe", "depth_image", "pose_image", "duration",
        F.when(first, task).alias("task_id"),
        F.when(first, F.when(ready, "ready").otherwise("missing_controls")).alias("status"),
        F.when(first, control_prompt(F.col("prompt"), F.col("depth_image"), F.col("pose_image"))).alias("vlm_prompt"),
        F.when(first, F.concat(F.lit(f"{out_dir}/first_frames/"), task, F.lit(".png"))).alias("first_frame_path"),
        F.when(first, F.concat(F.lit(f"{out_dir}/video_clips/"), task, F.lit(".mp4"))).alias("clip_path"))
