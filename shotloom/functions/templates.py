"""Texts built from shot structs.

The three descriptions differ on purpose: how motion, full stops and empty subjects are
written is part of each format.
"""

from __future__ import annotations

import functools

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotloom.functions import fixed_text as T
from shotloom.functions.text import let, strip_control_lines, strip_dialogue, trim_all


def per_shot(build):
    """Compute the shot struct once however often ``build`` reads it."""
    @functools.wraps(build)
    def column(s: Column) -> Column:
        return let(s, build)
    return column


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _lead(label: str, c: Column) -> Column:
    """``label`` + text, or null for an empty text so that joins skip it."""
    return F.when(_text(c) != "", F.concat(F.lit(label), c))


def _join(sep: str, *parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), sep)


@per_shot
def description_visual(s: Column) -> Column:
    """Camera without a static motion; background; subjects that have any attribute; one full stop."""
    scale, angle = trim_all(_text(s["shot_scale"])), trim_all(_text(s["camera_angle"]))
    motion = trim_all(F.when(_text(s["camera_motion"]) == "", T.STATIC_MOTION).otherwise(s["camera_motion"]))
    moved = F.when((motion != "") & (motion != T.STATIC_MOTION), F.concat(F.lit("（"), motion, F.lit("）"))).otherwise("")
    camera = F.when(F.concat(scale, angle) != "", F.concat(scale, angle, F.lit("镜头"), moved))
    background = trim_all(_text(s["background"]))

    def subject(x: Column) -> Column:
        clothing, action, face = (trim_all(_text(x[f])) for f in ("clothing", "action", "expression"))
        seen = _join("，", _lead("身穿", clothing), _lead("", action), _lead("表情：", face))
        return F.when(seen != "", F.concat(trim_all(_text(x["position"])), F.lit("人物，"), seen))

    parts = F.concat(F.array(camera, F.when(background != "", background)), F.transform(s["subjects"], subject))
    line = F.array_join(F.array_compact(parts), "；")
    return F.when(line != "", F.concat(line, F.lit("。"))).otherwise("")


@per_shot
def embedding_text(s: Column) -> Column:
    """Motion always in brackets; every subject is written and ends with a full stop."""
    scale, angle, motion, background = (_text(s[f]) for f in ("shot_scale", "camera_angle", "camera_motion", "background"))
    camera = F.when(F.concat(scale, angle, motion) != "",
                    F.concat(scale, angle, F.lit("镜头（"), motion, F.lit("）")))

    def subject(x: Column) -> Column:
        return F.concat(_join("，", F.concat(_text(x["position"]), F.lit("人物")), _lead("身穿", x["clothing"]),
                              _lead("", x["action"]), _lead("表情：", x["expression"])), F.lit("。"))

    parts = F.concat(F.array(camera, F.when(background != "", background)), F.transform(s["subjects"], subject))
    return F.array_join(F.array_compact(parts), "；")


QUERY_FIELDS = ("shot_scale", "camera_angle", "camera_motion", "subjects", "background")


@per_shot
def visual_query(s: Column) -> Column:
    """Motion only where given; background and subjects end with a full stop; no shot reads as an empty scene."""
    motion, background = _text(s["camera_motion"]), _text(s["background"])
    camera = F.concat(_text(s["shot_scale"]), _text(s["camera_angle"]), F.lit("镜头"),
                      F.when(motion != "", F.concat(F.lit("（"), motion, F.lit("）"))).otherwise(""))
    stop = F.when(background.endswith("。"), background).otherwise(F.concat(background, F.lit("。")))

    def subject(x: Column) -> Column:
        return F.concat(_join("，", F.concat(_text(x["position"]), F.lit("人物")), _lead("身穿", x["clothing"]),
                              _lead("", x["action"]), _lead("表情：", x["expression"])), F.lit("。"))

    parts = F.concat(F.array(camera, F.when(background != "", stop)), F.transform(s["subjects"], subject))
    return F.when(s.isNull(), "空镜头").otherwise(F.array_join(F.array_compact(parts), "；"))


@per_shot
def shot_prompt(s: Column) -> Column:
    """Camera, background, people, narrative, dialogue and mood for a video model."""
    scale, angle, motion = (_text(s[f]) for f in ("shot_scale", "camera_angle", "camera_motion"))
    camera = F.when(F.concat(scale, angle, motion) != "",
                    F.regexp_replace(F.concat_ws("，", scale, angle, motion), "^，+|，+$", ""))

    def subject(x: Column) -> Column:
        return _join("，", _lead("", x["name"]), _lead("位于", x["position"]), _lead("服装：", x["clothing"]),
                     _lead("动作：", x["action"]), _lead("表情：", x["expression"]))

    people = F.array_join(F.filter(F.transform(s["subjects"], subject), lambda x: x != ""), "；")
    speaker = F.when(_text(s["speaker"]) != "", s["speaker"]).otherwise("角色")
    spoken = F.when(_text(s["dialogue"]) != "", F.concat(F.lit("台词："), speaker, F.lit("说“"), s["dialogue"], F.lit("”")))
    line = _join("。", F.when(camera != "", camera), _lead("背景：", s["background"]), _lead("人物：", people),
                 _lead("画面描述：", s["description_narrative"]), spoken, _lead("情绪：", s["emotion"]))
    return F.concat(F.regexp_replace(line, "^。+|。+$", ""), F.lit("。"))


def is_environment_only(prompt: Column, refs: Column) -> Column:
    """No character reference and no people section."""
    return (F.coalesce(F.size(refs), F.lit(0)) <= 0) & ~prompt.contains("人物：")


def first_frame_prompt(base: Column, refs: Column) -> Column:
    """Cleaned base prompt, numbered character references, then the depth and pose images by number."""
    clean = strip_dialogue(strip_control_lines(base))
    n = F.coalesce(F.size(refs), F.lit(0))

    def numbered(parts: tuple[str, str], i: Column) -> Column:
        return F.concat(F.lit(parts[0]), i.cast("string"), F.lit(parts[1]))

    a, b, c = T.FRAME_REF
    named = F.transform(refs, lambda r, i: F.concat(F.lit(a), (i + 1).cast("string"), F.lit(b), r, F.lit(c)))
    ref_lines = F.when(n > 0, F.concat(F.array(F.lit(T.FRAME_REFS)), named)).otherwise(F.array().cast("array<string>"))
    scenery = F.array(numbered(T.FRAME_ENVIRONMENT[0], n + 2), F.lit(T.FRAME_ENVIRONMENT[1]))
    people = F.array(numbered(T.FRAME_PEOPLE[0], n + 2), *[F.lit(x) for x in T.FRAME_PEOPLE[1:]])
    lines = F.concat(F.array(clean), ref_lines, F.array(numbered(T.FRAME_DEPTH, n + 1)),
                     F.when(is_environment_only(clean, refs), scenery).otherwise(people),
                     F.array(*[F.lit(x) for x in T.FRAME_TAIL]))
    return F.array_join(lines, "\n")


def character_prompt(base: Column) -> Column:
    return F.concat(base, F.lit(T.CHARACTER_TAIL))


def control_prompt(prompt: Column, depth: Column, pose: Column) -> Column:
    """Prompt with a hint for each control image at hand."""
    hint = _join("，", F.when(depth.isNotNull(), T.CONTROL_DEPTH), F.when(pose.isNotNull(), T.CONTROL_POSE))
    hint = F.when(hint == "", T.CONTROL_NONE).otherwise(hint)
    return F.concat(F.lit(T.CONTROL_HEAD), prompt, F.lit(T.CONTROL_HINT), hint, F.lit(T.CONTROL_TAIL))


def scene_lines(characters: Column, dialogues: Column) -> tuple[Column, Column]:
    """Character and dialogue lines of a plot; an empty list reads ``（无）``."""
    def or_none(lines: Column) -> Column:
        text = F.array_join(lines, "\n")
        return F.when(_text(text) == "", T.NONE_LINE).otherwise(text)

    people = F.transform(characters, lambda c: F.concat(
        F.lit("  - "), F.coalesce(c["name"], F.lit("未知")), F.lit("："), F.coalesce(c["features"], F.lit("无描述"))))
    return or_none(people), or_none(F.transform(dialogues, lambda d: F.concat(F.lit("  "), d)))


def pretty_map(m: Column) -> Column:
    """JSON object of a string map in map order, two-space indent."""
    pairs = F.transform(F.map_entries(m), lambda e: F.concat(
        F.lit("  "), _json_string(e["key"]), F.lit(": "), _json_string(e["value"])))
    return F.when(F.size(m) == 0, "{}").otherwise(F.concat(F.lit("{\n"), F.array_join(pairs, ",\n"), F.lit("\n}")))


def _json_string(c: Column) -> Column:
    boxed = F.to_json(F.array(c))
    return F.substr(boxed, F.lit(2), F.length(boxed) - 2)


def key_skeleton(m: Column) -> Column:
    return F.transform_values(m, lambda k, v: F.lit("..."))


def repair_prompt(transcripts: Column, characters: Column, plot: Column, dialogues: Column) -> Column:
    """Prompt that asks for corrected lines under the same keys."""
    people, lines = scene_lines(characters, dialogues)
    return F.concat(F.lit(T.REPAIR_HEAD), people, F.lit(T.REPAIR_PLOT), F.coalesce(plot, F.lit(T.NO_PLOT)),
                    F.lit(T.REPAIR_DIALOGUE), lines, F.lit(T.REPAIR_INPUT), pretty_map(transcripts),
                    F.lit(T.REPAIR_RULES), pretty_map(key_skeleton(transcripts)), F.lit("\n"))


def retry_suffix(expected: Column, parts: tuple[str, str, str] = T.RETRY_OBJECT) -> Column:
    """Reminder of the expected count; empty where none is known."""
    text = F.concat(F.lit(parts[0]), expected.cast("string"), F.lit(parts[1]), (expected - 1).cast("string"), F.lit(parts[2]))
    return F.coalesce(text, F.lit(""))


def analysis_prompt(parts: Sequence[str], n: Column, characters: Column, plot: Column, dialogues: Column) -> Column:
    """Shot-analysis prompt: the caller's five texts around the number of images, people, plot and lines.

    The reminder of the exact number of objects follows at the end.
    """
    people, lines = scene_lines(characters, dialogues)
    head, before_people, before_plot, before_lines, rules = map(F.lit, parts)
    return F.concat(head, n.cast("string"), before_people, people, before_plot, F.coalesce(plot, F.lit(T.NO_PLOT)),
                    before_lines, lines, rules, retry_suffix(n, T.RETRY_ARRAY))


def judge_prompt(narratives: Column) -> Column:
    """Prompt for a chunk of completions: ARRAY<ARRAY<STRING>> of narratives, numbered from 1."""
    n = F.size(narratives).cast("string")
    indices = F.sequence(F.lit(1), F.size(narratives))
    listed = F.concat(F.lit("["), F.array_join(F.transform(indices, lambda i: i.cast("string")), ", "), F.lit("]"))
    a, b, rules = T.JUDGE_INTRO
    items = F.array_join(F.transform(indices, lambda i: F.concat(F.lit(T.JUDGE_ITEM[0]), i.cast("string"),
                                                                 F.lit(T.JUDGE_ITEM[1]))), ",\n ")
    seqs = F.transform(narratives, lambda ns, i: F.concat(
        F.lit("=== 序列 "), (i + 1).cast("string"), F.lit(" ===\n"),
        F.array_join(F.transform(ns, lambda x, j: F.concat(F.lit("  "), (j + 1).cast("string"), F.lit(". "), x)), "\n")))
    return F.concat(F.lit(a[0]), n, F.lit(a[1]), F.lit(b[0]), n, F.lit(b[1]), listed, F.lit(b[2]), F.lit(rules), items,
                    F.lit("\n]\n\n"), F.array_join(seqs, "\n\n"))


def chat_messages(system: Column, user: Column, assistant: Column | None = None) -> Column:
    """ARRAY<STRUCT<role, content>>; the assistant turn is left out where it is null."""
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    turns = F.array(message("system", system), message("user", user))
    if assistant is None:
        return turns
    return F.when(assistant.isNull(), turns).otherwise(F.concat(turns, F.array(message("assistant", assistant))))
