"""Video inputs, prompt lookup, references, image paths and the retrieval package."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotloom.functions import fixed_text as T
from shotloom.functions import vectors as V
from shotloom.operators import packaging as K
from shotloom.plans import bindings as B
from shotloom.plans.bindings import sql
from shotloom.plans.registry import query
from shotloom.plans.text_queries import SHOT_PROMPT, UNWRAP, _lit
from shotloom.session import stage
from shotloom.sources import sinks


def _inputs(spark, sf):
    m = B.model_outputs(spark, sf).select(F.concat(F.lit("runs/"), "source", F.lit(".json")).alias("source_file"), "sample_index",
                                          F.col("user_text").alias("user"), "model_output")
    return K.video_inputs(m)


# Outputs that hold one array: not those with brackets in a think block (2), cut short (3) or without one (5).
GOOD = f"""
    good as (select m.*, sample_index % 6 not in (2, 3, 5) as ok from model_outputs m)"""


@query("write_manifest_errors", sql(f"""with {GOOD}, n as (select sample_index, count(*) as n from items group by 1)
    select 'runs/' || source || '.json' as source_file, sample_index, case when ok then n end::bigint as num_shots,
      case when ok then 'out/video_inputs/' || source || '/sample_' || printf('%03d', sample_index) || '.json' end as video_input_path,
      case when not ok then {_lit(K.BAD_OUTPUT)} end as error, case when not ok then substr(model_output, 1, 1000) end as model_output_preview
    from good left join n using (sample_index)"""))
def _manifest(spark, sf):
    rows = stage(_inputs(spark, sf))
    path = sinks.new_path(spark, "manifest")
    sinks.write_manifest_errors(rows, K.manifest_rows(rows, "out"), K.error_rows(rows), path)
    good = spark.read.schema("source_file string, sample_index bigint, video_input_path string, num_shots bigint").json(f"{path}/manifest")
    bad = spark.read.schema("source_file string, sample_index bigint, error string, model_output_preview string").json(f"{path}/errors")
    return good.unionByName(bad, allowMissingColumns=True)


@query("export_sample_documents", sql(f"""with {SHOT_PROMPT}, {GOOD}
    select g.source, g.sample_index, 'unknown' <> '' as has_summary, count(p.pos) as shots,
      string_agg(p.prompt, '|' order by p.pos) as prompts, round(sum(coalesce(p.duration, 0)), 6) as seconds
    from good g left join prompted p using (sample_index) where ok group by all"""))
def _documents(spark, sf):
    docs = K.sample_documents(stage(_inputs(spark, sf))).select(F.regexp_extract("source_file", "runs/(.*).json", 1).alias("source"), "document")
    path = sinks.new_path(spark, "documents")
    sinks.write_documents(docs, path, "source")
    back = spark.read.schema("value string, source string").text(path)
    doc = F.from_json("value", "sample_index bigint, story_summary string, shots array<struct<duration:double,prompt:string>>")
    d = back.select("source", doc.alias("d")).select("source", "d.*")
    return d.select("source", "sample_index", (F.col("story_summary") != "").alias("has_summary"), F.size("shots").cast("bigint").alias("shots"),
                    F.array_join("shots.prompt", "|").alias("prompts"),
                    V.r6(F.aggregate("shots.duration", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))).alias("seconds"))


@query("export_prompt_text", sql(f"""with {SHOT_PROMPT}, {GOOD}
    select g.sample_index, 'Source File: ' || g.source || chr(10) || 'Sample Index: ' || g.sample_index || chr(10) || chr(10) || 'Story Summary:' || chr(10)
      || trim(regexp_extract(g.user_text, '(?s)【剧情摘要】\\n(.*?)(?:\\n【|$)', 1), ' ' || chr(10)) || chr(10) || chr(10) || 'Characters:' || chr(10)
      || '角色0、角色' || g.lang || chr(10) || chr(10) || 'Shot Prompts:' || chr(10)
      || string_agg('- Shot ' || p.pos || ' | ' || case when p.duration is null then 'unknown' else printf('%.1fs', p.duration) end || chr(10)
         || p.prompt, chr(10) || chr(10) order by p.pos) || chr(10) as text
    from good g join prompted p using (sample_index) where ok group by g.sample_index, g.source, g.user_text, g.lang"""))
def _prompt_text(spark, sf):
    return K.prompt_text(stage(_inputs(spark, sf))).select("sample_index", "text")


@query("sample_query_shots", sql(f"""with {SHOT_PROMPT}, {GOOD},
    f as (select sample_index, source from good where ok order by md5('7|runs/' || source || '.json|' || sample_index) limit 300),
    r as (select p.*, row_number() over (partition by sample_index order by md5('7|runs/' || f.source || '.json|' || sample_index || '|' || pos)) as rn
        from prompted p join f using (sample_index))
    select sample_index, pos::varchar as shot_index, prompt, duration from r where rn <= 2"""))
def _query_shots(spark, sf):
    usable = stage(_inputs(spark, sf)).filter("shots is not null")
    return K.sample_query_shots(usable, 300, 2, 7).drop("source_file")


DOC = ("case page_id % 3 when 0 then '{\"shots\": [{\"shot_index\": 1, \"prompt\": \" a ' || drama || '\", \"duration\": 2.5}, {\"shot_index\": 2, \"prompt\": \" \"}]}' "
       "else '{\"sample_index\": ' || cast(cast(num as int) % 40 as string) || ', \"shots\": [{\"shot_index\": \"' || cast(page_id % 4 as string) || '\", \"prompt\": \"p' || cast(page_id as string) || '\"}, \"x\"]}' end")
DOC_PATH = "concat('src/', 'sample_', cast(num as int) % 40, case page_id % 5 when 0 then '_' || cast(page_id as string) else '' end, '.json')"
PROMPT_INDEX = f"""
    pd as (select 'shot_count_' || (page_id % 2) as shot_count, page_id, {DOC_PATH} as path, drama,
        case when page_id % 3 > 0 then num::int % 40 when page_id % 5 > 0 then num::int % 40 end as sample_idx,
        case when page_id % 3 = 0 then 1 else (page_id % 4)::int end as shot_idx,
        case when page_id % 3 = 0 then 'a ' || drama else 'p' || page_id end as prompt, case when page_id % 3 = 0 then '2.5' end as duration_raw from paths),
    pidx as (select shot_count, sample_idx, shot_idx, x[3] as prompt, x[4] as duration_raw, x[1] as source_file from (
        select shot_count, sample_idx, shot_idx, max(row(path, 0, prompt, coalesce(duration_raw, ''))) as x from pd where sample_idx is not null group by all))"""


def _prompt_index(spark, sf):
    docs = B.paths(spark, sf).select(F.concat(F.lit("shot_count_"), F.col("page_id") % 2).alias("shot_count"), F.expr(DOC_PATH).alias("path"),
                                     F.expr(DOC).alias("value"))
    return K.build_prompt_index(docs)


@query("build_prompt_index", sql(f"with {PROMPT_INDEX} select shot_count, sample_idx, shot_idx, prompt, nullif(duration_raw, '') as duration_raw, source_file from pidx"))
def _index(spark, sf):
    return _prompt_index(spark, sf)


@query("resolve_prompts", sql(f"""with {PROMPT_INDEX},
    t as (select distinct 'shot_count_' || (page_id % 3) as shot_count, case when page_id % 11 = 0 then 'demo' else 'sample_' || (num::int % 50) end as sample,
        case when page_id % 13 = 0 then 'shot_x' else 'shot_' || (page_id % 4) end as shot from paths),
    k as (select *, try_cast(nullif(regexp_extract(sample, '^sample_([0-9]+)', 1), '') as int) as si, try_cast(nullif(regexp_extract(shot, '^shot_([0-9]+)$', 1), '') as int) as sh from t)
    select k.shot_count, k.sample, k.shot, p.prompt, p.source_file,
      case when p.prompt is not null then case when p.duration_raw = '2.5' then '3' else '5' end end as duration,
      case when si is null then 'Cannot parse sample index from ' || sample when sh is null then 'Cannot parse shot index from ' || shot
        when k.shot_count not in (select shot_count from pidx) then 'No prompt source index loaded for ' || k.shot_count
        when (k.shot_count, si) not in (select (shot_count, sample_idx) from pidx) then 'No prompt source sample found for ' || k.shot_count || '/' || sample
        when p.prompt is null then 'No prompt source shot found for ' || k.shot_count || '/' || sample || '/' || shot end as error
    from k left join pidx p on p.shot_count = k.shot_count and p.sample_idx = si and p.shot_idx = sh"""))
def _resolve(spark, sf):
    t = B.paths(spark, sf).select(
        F.expr("concat('shot_count_', page_id % 3)").alias("shot_count"),
        F.expr("case when page_id % 11 = 0 then 'demo' else concat('sample_', cast(num as int) % 50) end").alias("sample"),
        F.expr("case when page_id % 13 = 0 then 'shot_x' else concat('shot_', page_id % 4) end").alias("shot")).distinct()
    return K.resolve_prompts(t, stage(_prompt_index(spark, sf)))


@query("match_character_refs", sql("""
    with r as (select distinct source as sample, n as place, '角色' || n as name from model_outputs, range(0, 5) t(n))
    select m.source as sample, m.sample_index as shot, coalesce(string_agg(r.name, ',' order by place), '') as refs
    from model_outputs m left join r on r.sample = m.source and contains(m.model_output, r.name) group by all"""))
def _refs(spark, sf):
    m = B.model_outputs(spark, sf)
    shots = m.select(F.col("source").alias("sample"), F.col("sample_index").alias("shot"), F.col("model_output").alias("search"))
    refs = m.select(F.col("source").alias("sample")).distinct().select("sample", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("place"))
    refs = refs.withColumn("name", F.concat(F.lit("角色"), "place"))
    return K.match_character_refs(shots, refs).select("sample", "shot", F.array_join("refs", ",").alias("refs"))


IMAGE_OF = ("case page_id % 6 when 0 then '' else concat(drama, '/中', num, case page_id % 2 when 0 then '_generated' else '' end, "
            "case page_id % 3 when 0 then '.JPG' else '.png' end) end")


@query("resolve_image_path", sql(f"""
    select page_id as item, 'depth_emb/' || drama || '/#U4e2d_' || num || '.npy' as rel, case when page_id % 6 > 0 then i.img end as image from (
      select page_id, drama, num, case page_id % 6 when 0 then null else drama || '/中_' || num || case page_id % 2 when 0 then '_generated' else '' end
        || case page_id % 3 when 0 then '.JPG' else '.png' end end as own from paths) p
    left join lateral (select arg_min(img, pr) as img from (
      select drama || '/中_' || num || case page_id % 2 when 0 then '_generated' else '' end || case page_id % 3 when 0 then '.JPG' else '.png' end as img,
        (page_id % 2 = 0)::int * 10 + (page_id % 3 = 0)::int as pr from paths q where q.drama = p.drama and q.num = p.num and q.page_id % 6 > 0)) i on true"""
    .replace("case when page_id % 6 > 0 then i.img end", "i.img").replace("(page_id % 2 = 0)", "(1 - page_id % 2)").replace("(1 - page_id % 2)::int * 10", "(1 - page_id % 2) * 10")))
def _image(spark, sf):
    p = B.paths(spark, sf)
    items = p.select(F.col("page_id").alias("item"), F.concat(F.lit("depth_emb/"), "drama", F.lit("/#U4e2d_"), "num", F.lit(".npy")).alias("rel"))
    have = p.filter("page_id % 6 > 0").select(F.expr(IMAGE_OF.replace("'/中'", "'/中_'")).alias("path"))
    return K.resolve_image_path(items, have)


PACKAGE_ITEMS = "select shot_id as item_id, drama::varchar as drama, episode, 'keyframe_' || printf('%03d', shot_index) as keyframe from shots"


@query("retrieval_package", sql(f"""
    with it as ({PACKAGE_ITEMS}),
    f as (select q.shot_id as query_id, q.drama, q.episode, q.shot_index, q.vec_id, i.shot_id as item_id, list_dot_product(q.t, i.img) as score,
        row_number() over (partition by q.shot_id order by list_dot_product(q.t, i.img) desc, i.shot_id)::int as rank
      from (select *, list_transform(text, lambda x: x / greatest(sqrt(list_dot_product(text, text)), 1e-12)) as t from shots) q, imgs i),
    m as (select f.*, it.drama as d, it.episode as e, it.keyframe, case when hash_d % 2 = 0 then 'd/' || item_id || '.png' end as depth_image,
        case when hash_d % 3 > 0 then 'p/' || item_id || '.png' end as pose_image
      from f join (select *, ('0x' || substr(md5(item_id), 1, 15))::bigint as hash_d from it) it using (item_id) where rank <= 3),
    n as (select *, 'in_v' || drama || printf('_s%03d', episode) || printf('_k%03d', case when shot_index % 2 = 0 then shot_index else vec_id end) as tid from m)
    select query_id, rank, round(score, 6) as score, item_id, d as drama, e as episode, keyframe, depth_image, pose_image,
      case when rank = 1 then tid end as task_id, case when rank = 1 then case when depth_image is not null and pose_image is not null then 'ready' else 'missing_controls' end end as status,
      case when rank = 1 then {_lit(T.CONTROL_HEAD)} || query_id || {_lit(T.CONTROL_HINT)} || case when depth_image is null and pose_image is null then {_lit(T.CONTROL_NONE)}
        else concat_ws('，', case when depth_image is not null then {_lit(T.CONTROL_DEPTH)} end, case when pose_image is not null then {_lit(T.CONTROL_POSE)} end) end || {_lit(T.CONTROL_TAIL)} end as vlm_prompt,
      case when rank = 1 then 'out/first_frames/' || tid || '.png' end as first_frame_path,
      case when rank = 1 then 'out/video_clips/' || tid || '.mp4' end as clip_path from n"""))
def _package(spark, sf):
    from shotloom.operators.ordered import hash_int
    s = stage(B.shots(spark, sf))
    queries = s.select(F.col("shot_id").alias("query_id"), F.lit("in").alias("folder"), F.concat(F.lit("v"), "drama").alias("stem"),
                       F.col("episode").alias("sample_index"),
                       F.when(F.col("shot_index") % 2 == 0, F.col("shot_index").cast("string")).otherwise("?").alias("shot_index"),
                       F.col("vec_id").alias("serial"), F.lit(2.5).alias("duration"), F.col("shot_id").alias("prompt"), F.col("text").alias("vec"))
    index = s.select(F.col("shot_id").alias("item_id"), F.col("drama").cast("string").alias("drama"), "episode",
                     F.format_string("keyframe_%03d", "shot_index").alias("keyframe"),
                     V.fuse_mean(F.col("depth"), F.col("pose")).alias("vec"))
    h = hash_int("item_id")
    images = index.select("item_id", F.when(h % 2 == 0, F.concat(F.lit("d/"), "item_id", F.lit(".png"))).alias("depth_image"),
                          F.when(h % 3 > 0, F.concat(F.lit("p/"), "item_id", F.lit(".png"))).alias("pose_image"))
    return K.retrieval_package(queries, index, images, 3).drop("duration").withColumn("score", V.r6(F.col("score")))
