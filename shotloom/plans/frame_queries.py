"""Frame metrics, cuts and segments on the event values read as frame series."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotloom.functions import vectors as V
from shotloom.operators import frames as O
from shotloom.plans import bindings as B
from shotloom.plans.bindings import FPS, MIN_LEN, sql
from shotloom.plans.registry import query
from shotloom.session import stage

PEAKS = """
    peaks as (select video, frame_no, diff from (
        select *, lag(diff) over w as p, lead(diff) over w as n from frames
        window w as (partition by video order by frame_no)) where diff > p and diff > n),
    limits as (select video, greatest(30.0, 2.5 * avg(diff)) as threshold from frames group by video)"""
SCENE = PEAKS + f""",
    ranked as (select video, list([frame_no] order by diff desc, frame_no) as l
        from peaks join limits using (video) where diff >= threshold group by video),
    scene as (select video, unnest(list_reduce(l, lambda acc, x:
        case when len(list_filter(acc, lambda k: abs(k - x[1]) < {MIN_LEN})) = 0 then list_concat(acc, x) else acc end)) as frame_no
        from ranked)"""
FLASH = f"""
    bright_runs as (select video, min(frame_no) as run, arg_min(frame_no, row(-brightness, frame_no)) as peak from (
        select *, frame_no - row_number() over (partition by video order by frame_no) as g
        from frames where brightness > 230.0) group by video, g),
    flagged as (select *, run = max(run) over (partition by video) as is_last from bright_runs),
    lists as (select video, list([case when is_last then peak else peak + 20 end] order by run) as l,
        list(case when is_last then peak else peak + 20 end) filter (not is_last) as shifted from flagged group by video),
    flash as (select distinct video, cut, case when list_contains(shifted, cut) then cut - 20 end as origin from (
        select video, shifted, unnest(list_reduce(l, lambda acc, x:
          case when abs(x[1] - acc[len(acc)]) >= {MIN_LEN} then list_concat(acc, x) else acc end)) as cut from lists))"""
MERGED = f"""
    merged as (select video, unnest(list_reduce(l, lambda acc, x:
        case when x[1] - acc[len(acc)] >= {MIN_LEN} then list_concat(acc, x) else acc end)) as cut from (
        select video, list([c] order by c) as l from (
            select video, frame_no + 1 as c from scene union select video, cut from flash) group by video))"""


@query("frame_diff", sql("""
    select video, frame_no, round(list_sum(list_transform(list_zip(px[1:32], p[1:32]), lambda z: abs(z[1] - z[2]))) / 32
        + list_sum(list_transform(list_zip(px[33:64], p[33:64]), lambda z: abs(z[1] - z[2]))) / 32, 6) + 0.0 as diff
    from (select *, lag(px) over (partition by video order by frame_no) as p from pixel_frames) where p is not null"""))
def _frame_diff(spark, sf):
    return O.frame_diff(B.pixel_frames(spark, sf)).withColumn("diff", V.r6(F.col("diff")))


@query("local_peaks", sql(f"with {PEAKS} select video, frame_no, diff from peaks"))
def _local_peaks(spark, sf):
    return O.local_peaks(B.frames(spark, sf))


@query("adaptive_threshold", sql(f"with {PEAKS} select video, round(threshold, 6) as threshold from limits"))
def _adaptive_threshold(spark, sf):
    return O.adaptive_threshold(B.frames(spark, sf)).withColumn("threshold", V.r6(F.col("threshold")))


@query("detect_scene_cuts", sql(f"with {SCENE} select video, frame_no from scene"))
def _detect_scene_cuts(spark, sf):
    return O.detect_scene_cuts(B.frames(spark, sf), min_len=MIN_LEN).select("video", "frame_no")


@query("detect_flash_cuts", sql(f"with {FLASH} select video, cut, origin from flash"))
def _detect_flash_cuts(spark, sf):
    return O.detect_flash_cuts(B.frames(spark, sf), min_len=MIN_LEN)


@query("merge_cuts", sql(f"with {SCENE}, {FLASH}, {MERGED} select video, cut from merged"))
def _merge_cuts(spark, sf):
    f = stage(B.frames(spark, sf))
    return O.merge_cuts(O.detect_scene_cuts(f, min_len=MIN_LEN), O.detect_flash_cuts(f, min_len=MIN_LEN), MIN_LEN)


@query("build_segments", sql(f"""with {SCENE}, {FLASH}, {MERGED},
    bounds as (select video, cut from merged union all select video, 0 from limits),
    total as (select video, count(*) as n from frames group by video),
    seg as (select video, row_number() over w - 1 as segment_index, cut as start_frame,
        coalesce(lead(cut) over w, n) as end_frame from bounds join total using (video)
        window w as (partition by video order by cut))
    select s.video, segment_index, start_frame, end_frame, end_frame - start_frame as num_frames,
      round(start_frame / {FPS}, 6) as start_sec, round(end_frame / {FPS}, 6) as end_sec, f.origin as white_from,
      printf('keyframe_%03d.png', segment_index) as keyframe_filename
    from seg s left join flash f on f.video = s.video and f.cut = s.end_frame and f.origin is not null
    where end_frame - start_frame >= {MIN_LEN}"""))
def _build_segments(spark, sf):
    f = stage(B.frames(spark, sf))
    flash = stage(O.detect_flash_cuts(f, min_len=MIN_LEN))
    cuts = stage(O.merge_cuts(O.detect_scene_cuts(f, min_len=MIN_LEN), flash, MIN_LEN))
    videos = f.groupBy("video").agg(F.count(F.lit(1)).alias("total_frames")).withColumn("fps", F.lit(FPS))
    return O.build_segments(cuts, flash, videos, MIN_LEN).drop("video_filename", "fps")


@query("union_of_cuts", sql(f"""with {SCENE}, {FLASH}
    select video, frame_no + 1 as frame_no from scene union select video, cut from flash"""))
def _union_of_cuts(spark, sf):
    f = stage(B.frames(spark, sf))
    scene, flash = O.detect_scene_cuts(f, min_len=MIN_LEN), O.detect_flash_cuts(f, min_len=MIN_LEN)
    return scene.select("video", (F.col("frame_no") + 1).alias("frame_no")).union(
        flash.select("video", F.col("cut").alias("frame_no"))).distinct()
