"""Vector functions, modality joins and top-k retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotloom.functions import vectors as V
from shotloom.operators.corpus import complete_modalities, episode_centroid, join_modalities, pair_depth_pose
from shotloom.operators.retrieval import retrieve_topk
from shotloom.plans import bindings as B
from shotloom.plans.bindings import sql
from shotloom.plans.registry import query

R6 = "round({}, 6) + 0.0"


@query("retrieve_topk", sql("""
    select query_id, item_id, round(s, 6) as score, rank from (
      select q.shot_id as query_id, i.shot_id as item_id, list_dot_product(q.t, i.img) as s,
        row_number() over (partition by q.shot_id order by list_dot_product(q.t, i.img) desc, i.shot_id) as rank
      from (select shot_id, list_transform(text, lambda x: x / greatest(sqrt(list_dot_product(text, text)), 1e-12)) as t
            from shots) q, imgs i)
    where rank <= 5"""))
def _retrieve_topk(spark, sf):
    s = B.shots(spark, sf)
    found = retrieve_topk(s.select(F.col("shot_id").alias("query_id"), F.col("text").alias("vec")),
                          s.select(F.col("shot_id").alias("item_id"), V.fuse_mean(F.col("depth"), F.col("pose")).alias("vec")))
    return found.withColumn("score", V.r6(F.col("score")))


@query("vec_normalize", sql("""
    select shot_id, round(n[1], 6) + 0.0 as first, round(n[64], 6) + 0.0 as last,
      round(sqrt(list_dot_product(n, n)), 6) as length
    from (select shot_id, list_transform(text, lambda x: x / greatest(sqrt(list_dot_product(text, text)), 1e-8)) as n
          from shots)"""))
def _vec_normalize(spark, sf):
    s = B.shots(spark, sf).select("shot_id", V.l2_normalize(F.col("text")).alias("n"))
    return s.select("shot_id", V.r6(F.col("n")[0]).alias("first"), V.r6(F.col("n")[63]).alias("last"),
                    V.r6(V.norm(F.col("n"))).alias("length"))


@query("vec_cosine", sql("""
    select shot_id, round(c, 6) + 0.0 as cosine, round((c + 1.0) / 2.0, 6) + 0.0 as unit_score
    from (select shot_id, list_dot_product(text, depth)
            / (greatest(sqrt(list_dot_product(text, text)), 1e-8) * greatest(sqrt(list_dot_product(depth, depth)), 1e-8)) as c
          from shots)"""))
def _vec_cosine(spark, sf):
    c = B.shots(spark, sf).select("shot_id", V.cosine(F.col("text"), F.col("depth")).alias("c"))
    return c.select("shot_id", V.r6(F.col("c")).alias("cosine"), V.r6(V.to_unit_interval(F.col("c"))).alias("unit_score"))


@query("vec_fuse_mean", sql("""
    select shot_id, round(list_sum(m), 6) + 0.0 as total, round(m[1], 6) + 0.0 as first, cast(null as varchar) as error
    from imgs
    union all
    select shot_id || '#short', null, null, 'dimension mismatch: 64 vs 32' from shots"""))
def _vec_fuse_mean(spark, sf):
    s = B.shots(spark, sf)
    both = s.select("shot_id", "depth", "pose").unionByName(
        s.select(F.concat("shot_id", F.lit("#short")).alias("shot_id"), "depth", F.slice("pose", 1, 32).alias("pose")))
    m = both.select("shot_id", V.fuse_mean(F.col("depth"), F.col("pose")).alias("m"),
                    V.fuse_error(F.col("depth"), F.col("pose")).alias("error"))
    total = F.aggregate("m", F.lit(0.0), lambda acc, x: acc + x)
    return m.select("shot_id", V.r6(total).alias("total"), V.r6(F.col("m")[0]).alias("first"), "error")


@query("minmax_u8", sql("""
    select video, frame_no, list_sum(u)::bigint as total, u[1] as first, list_max(u) as top from (
      select video, frame_no, list_transform(px, lambda x:
        trunc((x - list_min(px)) / (list_max(px) - list_min(px)) * 255.0)::int) as u from pixel_frames)"""))
def _minmax_u8(spark, sf):
    u = B.pixel_frames(spark, sf).select("video", "frame_no", V.minmax_u8(F.col("px")).alias("u"))
    return u.select("video", "frame_no", F.aggregate("u", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
                    F.col("u")[0].alias("first"), F.array_max("u").alias("top"))


@query("join_modalities", sql("""
    select s.shot_id, round(list_sum(s.text), 6) + 0.0 as text_sum, round(s.depth[1], 6) + 0.0 as depth_first,
      round(s.pose[1], 6) + 0.0 as pose_first
    from shots s where s.shot_index % 7 <> 6"""))
def _join_modalities(spark, sf):
    s, long = _long_vectors(spark, sf)
    j = join_modalities(s.select("drama", "episode", "shot_index", "shot_id"), long)
    total = F.aggregate("text", F.lit(0.0), lambda acc, x: acc + x)
    return j.select("shot_id", V.r6(total).alias("text_sum"), V.r6(F.col("depth")[0]).alias("depth_first"),
                    V.r6(F.col("pose")[0]).alias("pose_first"))


def _long_vectors(spark, sf):
    """Shots and their vectors in long form; every seventh shot of an episode lacks its pose vector."""
    s = B.shots(spark, sf)
    key = ["drama", "episode", "shot_index"]
    long = s.select(*key, F.explode(F.map_from_arrays(
        F.array(*[F.lit(m) for m in ("text", "depth", "pose")]), F.array("text", "depth", "pose"))).alias("modality", "vec"))
    return s, long.filter(~((F.col("modality") == "pose") & (F.col("shot_index") % 7 == 6)))


@query("complete_modalities", sql("""
    select drama, count(*) as total, count(*) filter (shot_index % 7 <> 6) as complete,
      count(*) filter (shot_index % 7 = 6) as skipped from shots group by drama"""))
def _complete_modalities(spark, sf):
    s, long = _long_vectors(spark, sf)
    flags = complete_modalities(s.select("drama", "episode", "shot_index", "shot_id"), long)
    return flags.groupBy("drama").agg(F.count(F.lit(1)).alias("total"), F.count_if("complete").alias("complete"),
                                      F.count_if(~F.col("complete")).alias("skipped"))


@query("pair_depth_pose", sql("""
    select drama, episode, shot_index, md5('7|' || drama || '|' || episode || '|' || shot_index) as k,
      round(list_dot_product(depth, pose), 6) + 0.0 as agreement
    from shots where shot_index % 7 <> 6"""))
def _pair_depth_pose(spark, sf):
    _, long = _long_vectors(spark, sf)
    p = pair_depth_pose(long)
    return p.select("drama", "episode", "shot_index", F.md5(F.concat_ws("|", F.lit(7), "drama", "episode", "shot_index")).alias("k"),
                    V.r6(V.dot(F.col("depth"), F.col("pose"))).alias("agreement"))


@query("paired_stems", sql("""
    select drama, episode, shot_index from shots where shot_index % 7 <> 6"""))
def _paired_stems(spark, sf):
    _, long = _long_vectors(spark, sf)
    key = ["drama", "episode", "shot_index"]
    return long.filter("modality = 'depth'").select(*key).intersect(long.filter("modality = 'pose'").select(*key))


@query("episode_centroid", sql("""
    select drama, episode, count(*) as n, round(avg(m[1]), 6) + 0.0 as first, round(avg(m[64]), 6) + 0.0 as last
    from imgs group by drama, episode"""))
def _episode_centroid(spark, sf):
    s = B.shots(spark, sf).select("drama", "episode", V.fuse_mean(F.col("depth"), F.col("pose")).alias("vec"))
    c = episode_centroid(s, ["drama", "episode"])
    return c.select("drama", "episode", "n", V.r6(F.col("centroid")[0]).alias("first"), V.r6(F.col("centroid")[63]).alias("last"))
