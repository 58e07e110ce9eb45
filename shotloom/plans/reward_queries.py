"""Format, retrieval, judge and combined scores of storyboards."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from shotloom.functions import fixed_text as T
from shotloom.functions import vectors as V
from shotloom.operators import rewards as R
from shotloom.operators.enrich import enrich_memoised
from shotloom.plans import bindings as B
from shotloom.plans.bindings import duck_text, sql
from shotloom.plans.registry import query
from shotloom.plans.text_queries import VISUAL
from shotloom.session import stage

SEED = 7
DIM = 64


def stub_number(text: str) -> int:
    return int(hashlib.md5(text.encode("utf-8")).hexdigest()[:15], 16)


def stub_embed(texts):
    """Stands in for an embedding service: a vector computed from the md5 of the text."""
    return [[(stub_number(t) // (i + 1) % 1000) / 1000.0 - 0.5 for i in range(DIM)] for t in texts]


def stub_judge(texts):
    return [stub_number(t) % 1000 / 999.0 for t in texts]


HASH = "('0x' || substr(md5({}), 1, 15))::bigint"
ITEM_LIST = "[" + ", ".join(f"'{f}'" for f in T.SHOT_FIELDS) + "]"


def _filled(field, row="s"):
    return f"(coalesce(trim({row}->>'$.{field}'), '') not in ('', '[]', '{{}}'))::int"


FORMAT = f"""
    cover as (select sample_index, pos, avg(({' + '.join(_filled(f, 'u') for f in T.SUBJECT_FIELDS)}) / 6.0::double) as c
        from subjects join items using (sample_index, pos) where json_type(s->'$.subjects') = 'ARRAY' group by all),
    fmt as (select sample_index, avg(0.6::double * len(list_intersect(json_keys(s), {ITEM_LIST})) / 11.0::double
        + 0.3::double * ({' + '.join(_filled(f) for f in T.CONTENT_FIELDS)}) / 6.0::double + 0.1::double * coalesce(c, 0.0)) as f,
        count(*) as n from items left join cover using (sample_index, pos) group by sample_index)"""


@query("format_score", sql(f"""with {FORMAT}
    select m.sample_index, round(coalesce(f, 0), 6) as score, round(2 * coalesce(f, 0) - 1, 6) as scaled
    from model_outputs m left join fmt using (sample_index)"""))
def _format(spark, sf):
    s = B.salvaged(spark, sf).select("sample_index", R.format_score(F.col("items")).alias("f"))
    return s.select("sample_index", V.r6(F.col("f")).alias("score"), V.r6(2 * F.col("f") - 1).alias("scaled"))


@query("validate_indexed_scores", sql("""
    select doc_id as chunk, i as index, case when doc_id % 5 in (1, 3, 4) then 0.5 else case i when 1 then 1.0
        else round((n_chars % 100) / 100.0, 6) end end as score, doc_id % 5 in (1, 3, 4) as fallback
    from (select *, unnest([1, 2]) as i from documents)"""))
def _scores(spark, sf):
    d = B.table(spark, sf, "documents")
    x = F.expr("cast((n_chars % 100) / 100.0 as string)")
    second = F.concat(F.lit('{"index": 2, "score": '), x, F.lit("}"))
    body = F.concat(F.lit('[{"index": 1, "score": 0.1}, {"index": "1", "score": 1.7, "reasoning": "good"}, '), second, F.lit("]"))
    text = (F.when(F.col("doc_id") % 5 == 0, body).when(F.col("doc_id") % 5 == 1, F.lit('[{"index": 1, "score": 0.4}]'))
            .when(F.col("doc_id") % 5 == 2, F.concat(F.lit("Scores: "), body, F.lit(" done")))
            .when(F.col("doc_id") % 5 == 3, F.lit("no idea")).otherwise(F.replace(body, F.lit("1.7"), F.lit('"high"'))))
    r = d.select(F.col("doc_id").alias("chunk"), F.lit(2).alias("expected"), text.alias("response"))
    return R.validate_indexed_scores(r).withColumn("score", V.r6(F.col("score")))


NEG = f"""
    eps as (select drama, episode, md5('{SEED}|' || drama || '|' || episode) as k from (select distinct drama, episode from shots)),
    ring as (select *, row_number() over (partition by drama order by k) - 1 as r, count(*) over (partition by drama) as n,
        row_number() over (order by k) - 1 as g, count(*) over () as t from eps),
    negs as (select a.drama, a.episode, b.drama as neg_drama, b.episode as neg_episode from ring a join ring b
        on case when a.n > 1 then b.drama = a.drama and b.r = (a.r + 1) % a.n else b.g = (a.g + 1) % a.t end)"""


@query("negative_episodes", sql(f"with {NEG} select * from negs"))
def _negs(spark, sf):
    return R.negative_episodes(B.shots(spark, sf).select("drama", "episode"), SEED)


def _duck_reward(shots_cte: str, k: int) -> str:
    """``got`` from a CTE of (completion, pos, drama, episode, t): top-k means against own and contrast episode."""
    def side(name, drama, episode, join):
        return f"""{name} as (select completion, avg(s) as v from (select *, row_number() over (partition by completion, pos
            order by s desc, shot_id) as rk from (select c.completion, c.pos, i.shot_id, list_dot_product(c.t, i.img) as s
            from {shots_cte} c {join} join imgs i on i.drama = {drama} and i.episode = {episode})) where rk <= {k} group by completion)"""
    return f"""{NEG}, {side('own', 'c.drama', 'c.episode', '')},
        {side('neg', 'n.neg_drama', 'n.neg_episode', 'join negs n on n.drama = c.drama and n.episode = c.episode')},
        got as (select completion, case when o.v is null then 0.5 when g.v is null then (o.v + 1) / 2
            else 0.5 * ((o.v + 1) / 2 + 1 - (g.v + 1) / 2) end as r_retrieval
            from (select distinct completion from {shots_cte}) left join own o using (completion) left join neg g using (completion))"""


def _frames(spark, sf):
    return B.shots(spark, sf).select(F.col("shot_id").alias("item"), "drama", "episode",
                                     V.fuse_mean(F.col("depth"), F.col("pose")).alias("vec"))


@query("retrieval_reward", sql(f"""with told as (select drama || '/' || episode || '/' || (shot_index % 3) as completion, shot_index as pos,
        drama, case when drama = 9 then 999 else episode end as episode,
        list_transform(text, lambda x: x / greatest(sqrt(list_dot_product(text, text)), 1e-12)) as t from shots),
    {_duck_reward('told', 2)} select completion, round(r_retrieval, 6) as r_retrieval from got"""))
def _retrieval(spark, sf):
    s = stage(B.shots(spark, sf))
    told = s.select(F.concat_ws("/", "drama", "episode", F.col("shot_index") % 3).alias("completion"), F.col("shot_index").alias("pos"),
                    "drama", F.when(F.col("drama") == 9, 999).otherwise(F.col("episode")).alias("episode"), F.col("text").alias("vec"))
    frames = s.select(F.col("shot_id").alias("item"), "drama", "episode", V.fuse_mean(F.col("depth"), F.col("pose")).alias("vec"))
    return R.retrieval_reward(told, frames, 2, SEED).withColumn("r_retrieval", V.r6(F.col("r_retrieval")))


COMBINED = f"""{FORMAT}, parts as (select m.sample_index, coalesce(n, 0) as n_shots, 2 * coalesce(f, 0) - 1 as r_format,
        {HASH.format('m.user_text')} % 1000 / 999.0::double as r_video, (m.sample_index % 10) / 10.0::double as r_retrieval
        from model_outputs m left join fmt using (sample_index))"""


@query("combined_reward", sql(f"""with {COMBINED}
    select sample_index, n_shots, round(case when n_shots = 0 then -1 else 0.5::double * r_retrieval + 0.3::double * r_video
      + 0.2::double * r_format end, 6) as reward from parts"""))
def _combined(spark, sf):
    from shotloom.operators.ordered import hash_int
    s = B.salvaged(spark, sf)
    n = F.coalesce(F.size("items"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    video = (hash_int("user_text") % 1000) / F.lit(999.0)
    retrieval = (F.col("sample_index") % 10) / F.lit(10.0)
    fmt = 2.0 * R.format_score(F.col("items")) - 1.0
    return s.select("sample_index", n.cast("bigint").alias("n_shots"),
                    V.r6(R.combined_reward(retrieval, video, fmt, n, 0.5, 0.3, 0.2)).alias("reward"))


END_TO_END = f"""with {VISUAL}, {FORMAT},
    raw as (select sample_index as completion, pos, sample_index % 10 as drama, (sample_index // 10) % 3 as episode,
        list_transform(range(64), lambda i: ({HASH.format('text')} // (i + 1) % 1000) / 1000.0::double - 0.5::double) as v from visual),
    told as (select *, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) as t from raw),
    {_duck_reward('told', 1)},
    nar as (select sample_index, string_agg(trim({duck_text('description_narrative')}), chr(10) order by pos) as nar from items group by 1)
    select m.sample_index as completion, coalesce(n, 0) as n_shots, coalesce(v.repaired, false) as repaired, round(2 * coalesce(f, 0) - 1, 6) as r_format,
      round(case when n > 0 then coalesce(g.r_retrieval, 0.5) end, 6) as r_retrieval, round({HASH.format('nar')} % 1000 / 999.0::double, 6) as r_video,
      round(case when n is null then -1 else 0.4::double * coalesce(g.r_retrieval, 0.5) + 0.4::double * ({HASH.format('nar')} % 1000 / 999.0::double)
        + 0.2::double * (2 * f - 1) end, 6) as reward
    from model_outputs m left join fmt using (sample_index) left join got g on g.completion = m.sample_index
      left join nar using (sample_index) left join salvaged v using (sample_index)"""


def completions(spark, sf):
    m = B.model_outputs(spark, sf)
    return m.select(F.col("sample_index").alias("completion"), (F.col("sample_index") % 10).alias("drama"),
                    (F.floor(F.col("sample_index") / 10) % 3).alias("episode"), F.col("model_output").alias("text"))


def rounded_rewards(df):
    return df.select("completion", F.col("n_shots").cast("bigint").alias("n_shots"), "repaired",
                     *[V.r6(F.col(c)).alias(c) for c in ("r_format", "r_retrieval", "r_video", "reward")])


@query("reward_completions", sql(END_TO_END))
def _rewards(spark, sf):
    return rounded_rewards(R.reward_completions(completions(spark, sf), stage(_frames(spark, sf)), stub_embed, stub_judge, seed=SEED))


@query("enrich_memoised", sql("""
    select doc_id, round(('0x' || substr(md5(text), 1, 15))::bigint % 1000 / 999.0::double, 6) as result,
      count(*) over (partition by md5(text)) as uses from documents"""))
def _enrich(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "text", F.md5("text").alias("_m"))
    rows, memo = enrich_memoised(d, "text", stub_judge, "double")
    uses = d.groupBy("_m").agg(F.count(F.lit(1)).alias("uses"))
    return rows.select("doc_id", "result", "_m").join(uses, "_m").select("doc_id", V.r6(F.col("result")).alias("result"), "uses")
