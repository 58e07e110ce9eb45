"""Scans by path, timeline / transcript / shot reconcile, and incremental work."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotloom.functions import text as X
from shotloom.functions.vectors import r6
from shotloom.operators import corpus as C
from shotloom.operators import ledger as L
from shotloom.plans import bindings as B
from shotloom.plans.bindings import sql
from shotloom.plans.registry import query
from shotloom.session import stage
from shotloom.sources import documents as D

# ---------------------------------------------------------------- paths


def _files(spark, sf, pattern="concat('videos/', drama, '/', stem, '.', suffix)"):
    return B.paths(spark, sf).select("page_id", "drama", "lang", "num", "stem", "suffix", F.expr(pattern).alias("path"))


@query("scan_episode_paths", sql("""
    with f as (select distinct drama, stem, 'videos/' || drama || '/' || stem || '.' || suffix as path from paths
        where suffix in ('MP4', 'mkv')),
    n as (select *, regexp_matches(stem, '^[0-9]+$') as is_num, row_number() over (partition by drama order by
        case when regexp_matches(stem, '^[0-9]+$') then 0 else 1 end,
        case when regexp_matches(stem, '^[0-9]+$') then stem::bigint end, stem, path) as place from f)
    select drama, case when is_num then stem::bigint else place end as episode, path from n"""))
def _scan_episode_paths(spark, sf):
    return D.episode_paths(_files(spark, sf).select("path").distinct())


@query("shots_per_directory", sql("""
    with f as (select distinct drama, stem, 'videos/' || drama || '/' || stem || '.' || suffix as path from paths
        where suffix in ('MP4', 'mkv'))
    select 'videos/' || drama as directory, row_number() over (partition by drama order by path) - 1 as place, path,
      count(*) over (partition by drama) as total from f"""))
def _shots_per_directory(spark, sf):
    return D.shots_per_directory(_files(spark, sf).select("path").distinct())


EMB_PATH = ("concat(case page_id % 3 when 0 then 'depth_emb/' when 1 then 'depth_emb/depth_emb/' else 'text_emb/pose_emb/' end,"
            " drama, '/', lang, '/keyframe_', num, '.npy')")


@query("resolve_embedding_layout", sql(f"""
    select modality, drama, episode, shot_index, min(priority)::int as priority, arg_min(path, row(priority, path)) as path from (
      select 'depth' as modality, drama, lang as episode, num::int as shot_index, {EMB_PATH} as path,
        case page_id % 3 when 1 then 0 else 1 end as priority from paths where page_id % 3 < 2)
    group by all"""))
def _layout(spark, sf):
    return D.resolve_embedding_layout(_files(spark, sf, EMB_PATH).select("path"))


IMG_PATH = "concat(drama, '/', lang, '/', case page_id % 3 when 0 then 'pose' else 'depth' end, '/', stem, '.', case suffix when 'MP4' then 'PNG' when 'mkv' then 'jpg' else 'txt' end)"


@query("scan_modality_images", sql(f"""
    select {IMG_PATH} as path, drama, lang as episode, stem, drama || '/' || lang || '/' || stem || '.npy' as output
    from paths where page_id % 3 <> 0 and suffix <> 'txt'"""))
def _images(spark, sf):
    return D.modality_images(_files(spark, sf, IMG_PATH).select("path"), "depth")


@query("scan_legacy_images", sql("""
    select 'depth/' || drama || '/' || stem || '.png' as path, drama || '/' || stem || '.npy' as output from paths"""))
def _legacy_images(spark, sf):
    return D.modality_images(_files(spark, sf, "concat('depth/', drama, '/', stem, '.png')").select("path"), "depth", legacy=True)


SAMPLE_PATH = ("concat('shot_count_', page_id % 4, '/sample_', cast(num as int) % 40, '/shots/shot_', page_id, '/', "
               "case suffix when 'txt' then 'prompt.txt' else 'first_frame.jpg' end)")


@query("scan_sample_shots", sql(f"""
    with f as (select 'shot_count_' || (page_id % 4) as shot_count, 'sample_' || (num::int % 40) as sample,
        'shot_' || page_id as shot, {SAMPLE_PATH} as first_frame from paths where suffix <> 'txt' and page_id % 4 in (1, 3)),
    s as (select distinct shot_count, sample from f)
    select shot_count, sample, shot, first_frame from f join s using (shot_count, sample)"""))
def _sample_shots(spark, sf):
    return D.sample_shots(_files(spark, sf, SAMPLE_PATH), ["1", "shot_count_3"])


@query("limit_samples", sql("""
    with s as (select distinct drama, lang from paths)
    select 'first' as mode, drama, lang from (select * from s order by drama, lang limit 20)
    union all select 'random', drama, lang from (select * from s order by md5('3|' || drama || '|' || lang) limit 20)"""))
def _limit_samples(spark, sf):
    from shotloom.operators.ordered import hash_order, limit_by_hash
    s = B.paths(spark, sf).select("drama", "lang").distinct()
    first = s.orderBy("drama", "lang").limit(20)
    drawn = limit_by_hash(s, 20, hash_order(F.lit(3), "drama", "lang"))
    return first.select(F.lit("first").alias("mode"), "*").unionByName(drawn.select(F.lit("random").alias("mode"), "*"))


MANIFEST = "case page_id % 5 when 0 then '{\"shots\": {}}' when 1 then '{\"shots\": [{\"shot_dir\": \"\"}]}' else '{\"shots\": [{\"shot_dir\": \"' || drama || '/' || page_id || '\"}]}' end"
FILE_OF = ("concat(drama, '/', page_id, case page_id % 4 when 0 then '/prompt.txt' when 1 then '/metadata.json' "
           "when 2 then '/controls/01_depth.png' else '/controls/02_pose.png' end)")


@query("validate_required_files", sql(f"""
    with want as (select page_id as sample, drama || '/' || page_id || '/' || n as path, label from paths,
        (values ('metadata.json', 'shot metadata'), ('prompt.txt', 'shot prompt'), ('controls/01_depth.png', 'depth control image'),
         ('controls/02_pose.png', 'pose control image')) v(n, label) where page_id % 5 > 1)
    select sample, path, label from want where path not in (select {FILE_OF} from paths)
    union all select page_id, null, case page_id % 5 when 0 then 'manifest has no shots list' else 'invalid shot entry' end
      from paths where page_id % 5 < 2"""))
def _required(spark, sf):
    m = B.paths(spark, sf).select(F.col("page_id").alias("sample"), F.expr(MANIFEST).alias("manifest"))
    return D.missing_files(m, _files(spark, sf, FILE_OF))


# ---------------------------------------------------------------- documents

@query("scan_timeline", sql("""
    select drama, episode, segment_index::int as segment_index, start_sec, end_sec,
      round_even(end_sec - start_sec, 2) as duration from timeline"""))
def _scan_timeline(spark, sf):
    seg = F.struct(F.col("segment_index").cast("int").alias("segment_index"), "start_sec", "end_sec")
    docs = B.timeline(spark, sf).select("drama", "episode", F.to_json(F.struct(
        F.lit(1).alias("version"), F.array(seg).alias("segments"))).alias("value"))
    return D.parse_timeline(docs, 2).select("drama", "episode", "segment_index", "start_sec", "end_sec", "duration")


@query("scan_transcript_map", sql("""
    select drama, episode, idx::int as idx, text from transcripts
    union all select drama, episode, null, 'stray' from transcripts where idx = 0"""))
def _scan_transcripts(spark, sf):
    t = B.transcripts(spark, sf)
    stray = F.when(F.col("idx") == 0, F.create_map(F.lit("note"), F.lit("stray"))).otherwise(F.expr("map()").cast("map<string,string>"))
    docs = t.select("drama", "episode", F.to_json(F.map_concat(F.create_map(F.col("idx").cast("string"), "text"), stray)).alias("value"))
    return D.parse_transcripts(docs)


@query("scan_plots_valid", sql("""
    select drama, episode, case when episode % 3 = 0 then '' else plot_summary end as plot_summary,
      case when episode % 4 = 0 then 0 else 1 end as n_dialogues from plots where not (episode % 12 = 0)"""))
def _scan_plots(spark, sf):
    p = B.plots(spark, sf)
    docs = p.select("drama", "episode", F.to_json(F.struct(
        F.when(F.col("episode") % 3 == 0, "").otherwise(F.col("plot_summary")).alias("plot_summary"),
        F.expr("if(episode % 4 = 0, array(), array('line'))").cast("array<string>").alias("dialogues"))).alias("value"))
    return D.parse_plots(docs).select("drama", "episode", "plot_summary", F.size("dialogues").alias("n_dialogues"))


@query("scan_shot_corpus", sql("""
    select source as drama, sample_index as episode, 0 as seq, 1 as index, 'visual ' || lang as description from model_outputs
      where sample_index % 6 <> 5 and sample_index % 3 = 0
    union all select source, sample_index, 0, 1, 'plain ' || source from model_outputs
      where sample_index % 6 <> 5 and sample_index % 3 = 1"""))
def _scan_shots(spark, sf):
    value = F.expr("""
        case when sample_index % 6 = 5 then 'not json' else
        '[{"index": 1, "description_visual": "' || case sample_index % 3 when 0 then ' visual ' || lang else '' end
        || '", "description": "' || case sample_index % 3 when 1 then 'plain ' || source else '  ' end
        || '"}, {"index": null, "description": "no index"}]' end""")
    docs = B.model_outputs(spark, sf).select(F.col("source").alias("drama"), F.col("sample_index").alias("episode"), value.alias("value"))
    return D.valid_shots(D.parse_shots(docs)).select("drama", "episode", "seq", "index", "description")


@query("valid_shots", sql("""
    select drama, episode, index, trim(text) as description from (
      select s.*, c.text from shot_rows s join conv c on c.episode = s.episode and c.turn = s.index)
    where role <> 'system' and trim(text) <> ''"""))
def _valid_shots(spark, sf):
    s = B.shot_rows(spark, sf).join(B.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("episode"), F.col("turn").alias("index"), "text"), ["episode", "index"])
    rows = s.select("drama", "episode", F.col("index"), F.lit("").alias("description_visual"),
                    F.when(F.col("role") == "system", "  ").otherwise(F.col("text")).alias("description"))
    return D.valid_shots(rows).select("drama", "episode", "index", "description")


@query("scan_infer_results", sql("""
    select source, sample_index::int as sample_index, user_text as user, model_output from model_outputs"""))
def _infer(spark, sf):
    m = B.model_outputs(spark, sf).select(F.col("source"), F.to_json(F.array(F.struct(
        F.col("sample_index").cast("int").alias("sample_index"), F.col("user_text").alias("user"), "model_output"))).alias("value"))
    return m.select("source", F.inline(F.from_json("value", f"array<struct<{D.INFER.replace(' ', ':').replace(',:', ',')}>>"))).drop("ground_truth")


@query("scan_sft_columns", sql("""
    select doc_id::varchar as id, lang as task_type, text, (n_chars // 2)::int as response_start_char from documents"""))
def _sft(spark, sf):
    d = B.table(spark, sf, "documents")
    return D.sft_columns(d.select(F.col("doc_id").alias("id"), F.col("lang").alias("task_type"), "text",
                                  F.expr("n_chars div 2").alias("response_start_char"), "source"))


@query("scan_runs_done", sql("""
    select signature, arg_max(status, seq) as status, max(seq) as seq from runs group by signature
    having arg_max(status, seq) = 'done'"""))
def _runs_done(spark, sf):
    return D.last_per_signature(B.runs(spark, sf), "seq").filter("status = 'done'").select("signature", "status", "seq")


# ---------------------------------------------------------------- reconcile

RECONCILE = """
    c as (select drama, episode, n_shot, n_timeline, n_transcript from
        (select drama, episode, count(*) as n_timeline from timeline group by all)
        full join (select drama, episode, count(*) as n_shot from shot_rows group by all) using (drama, episode)
        full join (select drama, episode, count(*) as n_transcript from transcripts group by all) using (drama, episode)),
    rec as (select *, case when n_shot is null then 'shot文件缺失（分析失败或未运行）'
        when n_timeline is null or n_transcript is null then '文件缺失'
        when n_shot = n_timeline and n_timeline = n_transcript then 'OK' else '分镜数量不一致' end as status,
        case when n_shot is null or n_timeline is null or n_transcript is null then 'none'
        when n_transcript <> n_timeline then 'drop_transcript_and_shot' when n_shot <> n_timeline then 'drop_shot'
        else 'none' end as action from c where n_shot is not null or n_timeline is not null)"""


def _trio(spark, sf):
    return B.shot_rows(spark, sf), B.timeline(spark, sf), B.transcripts(spark, sf)


@query("reconcile_counts", sql(f"with {RECONCILE} select * from rec"))
def _reconcile(spark, sf):
    return C.reconcile_counts(*_trio(spark, sf))


@query("reconcile_summary", sql(f"""with {RECONCILE}
    select count(*) filter (status = 'OK') as ok, count(*) filter (status <> 'OK') as errors,
      count(*) filter (n_shot is null) as missing_shots, count(*) filter (action = 'drop_shot') as drop_shot,
      count(*) filter (action = 'drop_transcript_and_shot') as drop_transcript_and_shot from rec"""))
def _summary(spark, sf):
    return C.reconcile_summary(C.reconcile_counts(*_trio(spark, sf)))


@query("missing_shots", sql("""
    select distinct drama, episode from timeline where episode not in (select episode from shot_rows)"""))
def _missing(spark, sf):
    s, t, _ = _trio(spark, sf)
    return C.missing_shots(t, s)


@query("backfill_dialogue_duration", sql(f"""with {RECONCILE}
    select s.drama, s.episode, s.index, s.description, coalesce(t.text, '') as dialogue,
      coalesce(round_even(l.end_sec - l.start_sec, 1), 0.0) as duration
    from shot_rows s join rec r on r.episode = s.episode and r.status = 'OK'
      left join transcripts t on t.episode = s.episode and t.idx = s.index
      left join timeline l on l.episode = s.episode and l.segment_index = s.index"""))
def _backfill(spark, sf):
    s, t, x = _trio(spark, sf)
    rows = s.select("drama", "episode", F.col("index").alias("seq"),
                    F.when(F.col("index") % 2 == 0, F.col("index")).alias("index"), "description")
    return C.backfill_dialogue_duration(rows, t, x).drop("seq")


@query("transcript_coverage", sql("""
    select drama, episode, count(*) filter (text <> '') as filled, count(*) as total,
      round(count(*) filter (text <> '') / count(*), 6) as ratio from transcripts group by all"""))
def _coverage(spark, sf):
    return C.transcript_coverage(B.transcripts(spark, sf)).withColumn("ratio", r6(F.col("ratio")))


@query("repair_tasks", sql("""
    select t.drama, t.episode::varchar as episode, n as expected_count
    from (select distinct drama, episode from transcripts) t join (select distinct episode from plots) using (episode)
      left join (select episode, count(*) as n from timeline where episode % 9 <> 0 group by 1) using (episode)
    where episode % 4 <> 0"""))
def _repair_tasks(spark, sf):
    ep = B.transcripts(spark, sf).select("drama", "episode").distinct()
    listing = ep.select("drama", F.concat(F.col("episode"), F.lit(".json")).alias("file")).union(
        ep.filter("episode % 4 = 0").select("drama", F.concat(F.lit("fixed_"), F.col("episode"), F.lit(".json"))))
    return C.repair_tasks(listing, B.plots(spark, sf), B.timeline(spark, sf).filter("episode % 9 <> 0"))


@query("validate_expected_count", sql("""
    select drama, episode, coalesce(f.n, 0) as found, e.n as expected, (e.n is null or e.n = coalesce(f.n, 0)) as valid
    from (select drama, episode, count(*) as n from timeline group by all) e
      full join (select drama, episode, count(*) as n from transcripts group by all) f using (drama, episode)"""))
def _expected(spark, sf):
    return C.validate_expected_count(B.transcripts(spark, sf), B.timeline(spark, sf))


@query("label_keyframes", sql("""
    select l.drama, l.episode, l.segment_index as seq, 'keyframe_' || lpad(l.segment_index::varchar, 3, '0') || '.png' as file,
      l.segment_index::int as idx,
      '[分镜' || lpad(l.segment_index::varchar, 3, '0') || case when h.episode is null then ']' else
        ' | 台词：' || case when coalesce(trim(t.text), '') = '' then '（无台词）' else trim(t.text) end || ' | 时长：'
        || (round_even(l.end_sec - l.start_sec, 2)::double)::varchar || '秒]' end as label
    from timeline l left join transcripts t on t.episode = l.episode and t.idx = l.segment_index and t.episode % 5 <> 0
      left join (select distinct episode from transcripts where episode % 5 <> 0) h on h.episode = l.episode"""))
def _label(spark, sf):
    t = B.timeline(spark, sf)
    k = t.select("drama", "episode", F.col("segment_index").alias("seq"),
                 F.format_string("keyframe_%03d.png", "segment_index").alias("file"))
    return C.label_keyframes(k, B.transcripts(spark, sf).filter("episode % 5 <> 0"), t)


@query("existing_keyframes", sql("""
    select l.drama, l.episode, l.segment_index, 'keyframe_' || lpad(l.segment_index::varchar, 3, '0') || '.png' as keyframe_filename
    from timeline l join shot_rows s on s.episode = l.episode and s.index = l.segment_index"""))
def _existing(spark, sf):
    name = F.format_string("keyframe_%03d.png", "segment_index")
    seg = B.timeline(spark, sf).select("drama", "episode", "segment_index", name.alias("keyframe_filename"))
    files = B.shot_rows(spark, sf).select("drama", "episode", F.format_string("keyframe_%03d.png", "index").alias("file"))
    return C.existing_keyframes(seg, files)


# ---------------------------------------------------------------- plots → episodes

MATCH = """
    pm as (select p, max(row(drama, episode)) as e from (select trim(plot_summary) as p, drama, episode from plots) where p <> '' group by p),
    matched as (select m.sample_index, e[1] as drama, e[2] as episode from (
        select sample_index, trim(regexp_extract(user_text, '(?s)【剧情摘要】\n(.*?)\n\n【', 1)) as p from model_outputs) m
        join pm using (p))"""
MATCH = MATCH.replace("\n(.*?)", "\\n(.*?)").replace("\n\n【', 1", "\\n\\n【', 1")


@query("match_plot_episode", sql(f"with {MATCH} select * from matched"))
def _match(spark, sf):
    return C.match_plot_episode(B.model_outputs(spark, sf), B.plots(spark, sf)).select("sample_index", "drama", "episode")


@query("needed_episodes", sql(f"with {MATCH} select distinct drama, episode from matched"))
def _needed(spark, sf):
    m = stage(C.match_plot_episode(B.model_outputs(spark, sf), B.plots(spark, sf)).select("sample_index", "drama", "episode"))
    return C.needed_episodes(m.filter("sample_index % 2 = 0"), m.filter("sample_index % 2 = 1"))


RL = f"""{MATCH},
    kept as (select * from matched where episode % 3 <> 0)"""


@query("load_rl_split", sql(f"with {RL} select sample_index, drama, episode, 'train' as split from kept"))
def _rl(spark, sf):
    kept, _ = _rl_parts(spark, sf)
    return kept


def _rl_parts(spark, sf):
    vec = B.timeline(spark, sf).filter("episode % 3 <> 0")
    kept, rate = C.load_rl_split(B.model_outputs(spark, sf), B.plots(spark, sf), vec, "train")
    return kept.select("sample_index", "drama", "episode", "split"), rate


@query("match_rate", sql(f"""with {RL},
    read as (select m.sample_index, k.sample_index is not null as hit from model_outputs m left join kept k using (sample_index))
    select count(*) filter (hit) as kept, count(*) filter (not hit) as skipped,
      ROUND(count(*) filter (not hit) / greatest(count(*), 1) * 100, 1) as skip_pct from read"""))
def _rate(spark, sf):
    return _rl_parts(spark, sf)[1]


# ---------------------------------------------------------------- incremental work

@query("pending_work", sql("""
    select distinct task from ledger where task not in (select task from ledger where status = 'SUCCESS' and event_no % 3 <> 0)"""))
def _pending(spark, sf):
    led = B.ledger(spark, sf)
    return L.pending_work(led.select("task").distinct(), led.filter("status = 'SUCCESS'"), ["task"], F.col("event_no") % 3 != 0)


ACTIONS = """
    acts as (select task, events, last_status, case when has_result then 'skip' when last_status = 'RUNNING' then 'resume'
        else 'submit' end as action from (
          select t.task, count(l.task) as events, arg_max(status, row(happened, event_no)) as last_status,
            coalesce(bool_or(status = 'SUCCESS'), false) as has_result
          from (select c_custkey as task from customer) t
            left join (select * from ledger where status <> 'SUCCESS' or event_no % 9 = 0) l using (task) group by t.task))"""


def _actions(spark, sf):
    tasks = B.table(spark, sf, "customer").select(F.col("c_custkey").alias("task"))
    events = B.ledger(spark, sf).filter("status <> 'SUCCESS' or event_no % 9 = 0")
    return L.task_ledger_actions(tasks, events, ["happened", "event_no"])


@query("task_ledger_actions", sql(f"with {ACTIONS} select * from acts"))
def _ledger(spark, sf):
    return _actions(spark, sf)


@query("task_outcomes", sql(f"""with {ACTIONS}
    select action, count(*) as tasks, sum(events)::bigint as events, count(*) filter (last_status = 'SUCCESS') as success,
      count(*) filter (last_status = 'FAILED') as error from acts group by action"""))
def _outcomes(spark, sf):
    return L.task_outcomes(_actions(spark, sf))


@query("stale_partitions", sql("""
    with cur as (select task, max(event_no) as mtime, count(*) as n from ledger group by task),
    old as (select task, max(event_no) as mtime, count(*) as n from ledger where status <> 'RUNNING' group by task)
    select cur.task, cur.mtime, cur.n, case when old.task is null then 'absent' else 'changed' end as reason
    from cur left join old using (task) where old.task is null or old.mtime <> cur.mtime or old.n <> cur.n"""))
def _stale(spark, sf):
    led = B.ledger(spark, sf)
    version = [F.max("event_no").alias("mtime"), F.count(F.lit(1)).alias("n")]
    return L.stale_partitions(led.groupBy("task").agg(*version),
                              led.filter("status <> 'RUNNING'").groupBy("task").agg(*version), ["task"], ["mtime", "n"])
