"""Text, JSON and template functions over the storyboard texts and the plain documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotloom.functions import jsonfix as J
from shotloom.functions import templates as P
from shotloom.functions import text as X
from shotloom.functions import fixed_text as T
from shotloom.functions.vectors import r6
from shotloom.plans import bindings as B
from shotloom.plans.bindings import duck_text, sql
from shotloom.plans.registry import query


def _outputs(spark, sf):
    return B.model_outputs(spark, sf)


def _docs(spark, sf):
    return B.table(spark, sf, "documents")


# ---------------------------------------------------------------- sections and wrappers

@query("fn_extract_section", sql("""
    select sample_index, trim(regexp_extract(user_text, '(?s)【剧情摘要】\\n(.*?)(?:\\n【|$)', 1), ' ' || chr(10)) as plot,
      trim(regexp_extract(user_text, '(?s)【出场角色】\\n(.*?)(?:\\n【|$)', 1)) as cast_list, '' as absent from model_outputs"""))
def _section(spark, sf):
    u = F.col("user_text")
    return _outputs(spark, sf).select("sample_index", X.extract_section(u, T.PLOT_TITLE).alias("plot"),
                                      X.extract_section(u, T.CAST_TITLE).alias("cast_list"),
                                      X.extract_section(u, "别的").alias("absent"))


@query("fn_plot_summary", sql("""
    select sample_index, trim(regexp_extract(user_text, '(?s)【剧情摘要】\\n(.*?)\\n\\n【', 1)) as plot,
      'solo ' || lang as loose from model_outputs"""))
def _plot(spark, sf):
    loose = F.concat(F.lit("head【剧情摘要】\n solo "), "lang", F.lit(" \n\nrest"))
    return _outputs(spark, sf).select("sample_index", X.plot_summary(F.col("user_text")).alias("plot"),
                                      X.plot_summary(loose).alias("loose"))


STRIP_FENCE = ("trim(case when starts_with(trim(model_output), '```') then regexp_replace(regexp_replace(trim(model_output),"
               " '^```[a-zA-Z0-9_+-]*\\n?', ''), '\\n?```$', '') else trim(model_output) end, ' ' || chr(10))")


@query("fn_strip_fence", sql(f"select sample_index, {STRIP_FENCE} as body from model_outputs"))
def _fence(spark, sf):
    return _outputs(spark, sf).select("sample_index", X.strip_code_fence(F.col("model_output")).alias("body"))


UNWRAP = f"trim(replace({STRIP_FENCE}, '<END>', ''))"


@query("fn_unwrap", sql(f"""
    select sample_index, {UNWRAP} as body, '[1] ' || lang || ' "q"' as quoted from model_outputs"""))
def _unwrap(spark, sf):
    quoted = F.concat(F.lit('"[1] '), "lang", F.lit(' \\"q\\" "<END>'))
    return _outputs(spark, sf).select("sample_index", X.unwrap_model_output(F.col("model_output")).alias("body"),
                                      X.unwrap_model_output(quoted).alias("quoted"))


@query("fn_strip_think", sql("""
    select sample_index, regexp_replace(model_output, '(?s)<think>.*?</think>', '', 'g') as body from model_outputs"""))
def _think(spark, sf):
    return _outputs(spark, sf).select("sample_index", X.strip_think(F.col("model_output")).alias("body"))


@query("fn_decode_u", sql("""
    select doc_id, '中' || doc_id || ' ' || chr(128512) || '#U110000' || '#Uzz ' || source || chr(19968 + (doc_id % 1000)::int) as decoded
    from documents"""))
def _decode(spark, sf):
    code = F.lpad(F.lower(F.conv((F.lit(19968) + F.col("doc_id") % 1000).cast("string"), 10, 16)), 4, "0")
    raw = F.concat(F.lit("#U004e2d"), F.col("doc_id").cast("string"), F.lit(" #U1F600#U110000#Uzz "), "source",
                   F.lit("#U"), code)
    return _docs(spark, sf).select("doc_id", X.decode_u_escapes(raw).alias("decoded"))


@query("fn_sanitize", sql(r"""
    select doc_id, coalesce(nullif(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_-]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'character') as name
    from documents"""))
def _sanitize(spark, sf):
    return _docs(spark, sf).select("doc_id", X.sanitize_filename(F.col("text")).alias("name"))


PROMPT = ("source || chr(10) || chr(10) || chr(10) || chr(10) || '控制条件：' || lang || chr(10) || '  上传顺序说明：x' || chr(10) || "
          "'台词：角色说' || lang || chr(10) || '背景：' || lang || ' 。。。' || case when sample_index % 2 = 0 then chr(10) || '人物：角色1' else '' end")


def _prompts(spark, sf):
    return _outputs(spark, sf).select("sample_index", "source", "lang", F.expr(PROMPT).alias("prompt"))


CONTROL = "source || chr(10) || chr(10) || '台词：角色说' || lang || chr(10) || '背景：' || lang || ' 。。。' || case when sample_index % 2 = 0 then chr(10) || '人物：角色1' else '' end"
CLEAN = "source || chr(10) || chr(10) || '背景：' || lang || '。' || case when sample_index % 2 = 0 then chr(10) || '人物：角色1' else '' end"


@query("fn_strip_control", sql(f"select sample_index, {CONTROL} as prompt from model_outputs"))
def _control(spark, sf):
    return _prompts(spark, sf).select("sample_index", X.strip_control_lines(F.col("prompt")).alias("prompt"))


@query("fn_strip_dialogue", sql(f"""
    select sample_index, {CLEAN} as prompt, regexp_replace(regexp_replace(source || ' . ' || lang, '台词：[^\\n]*', '', 'g'), 'x', 'x', 'g') as plain
    from model_outputs"""))
def _dialogue(spark, sf):
    return _prompts(spark, sf).select(
        "sample_index", X.strip_dialogue(X.strip_control_lines(F.col("prompt"))).alias("prompt"),
        X.strip_dialogue(F.concat("source", F.lit(" . "), "lang")).alias("plain"))


@query("fn_parse_indices", sql("""
    select page_id, num::int as sample, case when page_id % 2 = 0 then num::int end as shot, num::int as trailing,
      num::int as last_number from paths"""))
def _indices(spark, sf):
    n = F.col("num")
    return B.paths(spark, sf).select(
        "page_id", X.sample_index(F.concat(F.lit("sample_"), n, F.lit("_x"))).alias("sample"),
        X.shot_index(F.concat(F.lit("shot_"), n, F.when(F.col("page_id") % 2 == 0, "").otherwise("b"))).alias("shot"),
        X.trailing_number(F.concat(F.lit("shot_count_"), n)).alias("trailing"),
        X.last_number(F.concat(F.lit("a12_keyframe_"), n, F.lit(".png"))).alias("last_number"))


@query("fn_infer_split", sql("""
    select page_id, case page_id % 5 when 0 then 'train' when 1 then 'val' when 2 then 'test' when 3 then 'unknown' else 'unknown' end as split
    from paths"""))
def _infer_split(spark, sf):
    name = F.expr("""case page_id % 5 when 0 then array('d/Train_' || num || '.json', 'train.parquet') when 1 then array('x/sft_val.json')
        when 2 then array('a/b/test') when 3 then array('train.json', 'val.json') else array('training.json') end""")
    return B.paths(spark, sf).select("page_id", X.infer_split(name).alias("split"))


@query("fn_csv_list", sql("""
    select page_id, case when page_id % 4 = 0 then 'ordering' else drama || '|' || lang end as items from paths"""))
def _csv(spark, sf):
    raw = F.when(F.col("page_id") % 8 == 0, None).when(F.col("page_id") % 4 == 0, " , ").otherwise(
        F.concat(F.lit(" "), "drama", F.lit(",, "), "lang", F.lit(" ,")))
    return B.paths(spark, sf).select("page_id", F.array_join(X.csv_list(raw, ["ordering"]), "|").alias("items"))


@query("fn_task_id", sql("""
    select page_id, drama || '_' || stem || printf('_s%03d', page_id % 1000)
      || printf('_k%03d', case when page_id % 3 = 0 then page_id + 1 else num::int end) as task_id from paths"""))
def _task_id(spark, sf):
    shot = F.when(F.col("page_id") % 3 == 0, "n/a").otherwise(F.col("num"))
    return B.paths(spark, sf).select(
        "page_id", X.task_id(F.col("drama"), F.col("stem"), F.col("page_id") % 1000, shot, F.col("page_id") + 1).alias("task_id"))


@query("fn_rebase_path", sql("""
    select page_id, case when page_id % 3 = 0 then 'D:\\other\\' || stem else '/root/saved/Videos/' || drama || '/' || stem end as rebased,
      '../' || drama || '/' || stem as relative, '/root/saved/' || stem as absolute from paths"""))
def _rebase(spark, sf):
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("D:\\other\\"), "stem")).otherwise(
        F.concat(F.lit("E:\\data\\Videos\\"), "drama", F.lit("\\"), "stem"))
    return B.paths(spark, sf).select(
        "page_id", X.rebase_path(raw, "/root/saved").alias("rebased"),
        X.serialize_path(F.concat(F.lit("/root/"), "drama", F.lit("/"), "stem"), "relative", "/root/saved").alias("relative"),
        X.serialize_path(F.col("stem"), "absolute", "/root/saved").alias("absolute"))


@query("fn_fingerprint", sql("""
    select doc_id, substr(sha1('{"max_length":8192,"path":"' || source || '","rows":' || n_chars || '}'), 1, 16) as plan_id,
      sha256(text) as content from documents"""))
def _fingerprint(spark, sf):
    return _docs(spark, sf).select("doc_id", X.fingerprint(("path", F.col("source")), ("rows", F.col("n_chars")),
                                                           ("max_length", F.lit(8192))).alias("plan_id"),
                                   X.content_hash(F.col("text")).alias("content"))


LENS, ACT, TIME = T.LENS_WORDS, T.ACTION_WORDS, T.TEMPORAL_WORDS
WEAK = (f"1.0 / (1.0 + pow(2.71828::double, -(len(regexp_extract_all(t, '{LENS}')) * 0.4::double + len(regexp_extract_all(t, '{ACT}')) * 0.4::double"
        f" + len(regexp_extract_all(t, '{TIME}')) * 0.2::double - 1.5::double)))")


@query("weak_label", sql(f"""
    select sample_index, round({WEAK}, 6) as label from (select sample_index, model_output || '随即' || user_text as t from model_outputs)"""))
def _weak(spark, sf):
    t = F.concat("model_output", F.lit("随即"), "user_text")
    return _outputs(spark, sf).select("sample_index", r6(X.weak_label(t)).alias("label"))


@query("fn_signature", sql("""
    select seq, 'lh' || status || '_vr' || seq || '_m' || metric::varchar as sig from runs"""))
def _signature(spark, sf):
    return B.runs(spark, sf).select("seq", X.signature([("lh", F.col("status")), ("vr", F.col("seq")), ("m", F.col("metric"))]).alias("sig"))


@query("fn_parse_metrics", sql("""
    select seq, round(metric / 10000, 6) as r1, 0.5 as r10, 2 as n from runs"""))
def _metrics(spark, sf):
    log = F.concat(F.lit("Epoch 1 | R@1=0.9\n12:00 Test Results | R@1="), F.col("metric") / 10000, F.lit(" R@10=0.5 note=abc\nend"))
    m = X.parse_metrics(log)
    return B.runs(spark, sf).select("seq", r6(m["test_R@1"]).alias("r1"), m["test_R@10"].alias("r10"), F.size(m).alias("n"))


@query("fn_data_uri", sql("""
    select doc_id, 'data:image/' || case doc_id % 3 when 0 then 'jpeg' when 1 then 'png' else 'webp' end || ';base64,' || base64(text::blob) as uri
    from (select doc_id, encode(text) as text from documents)"""))
def _uri(spark, sf):
    path = F.expr("concat('d/', source, case doc_id % 3 when 0 then '.JPG' when 1 then '.png' else '.webp' end)")
    return _docs(spark, sf).select("doc_id", X.data_uri(path, F.encode("text", "UTF-8")).alias("uri"))


# ---------------------------------------------------------------- scalars

@query("duration_enum", sql("""
    select doc_id, case when doc_id % 7 = 0 then '5' else greatest(1, least(16, floor(n_chars / 100.0 + 0.5)))::int::varchar end as seconds
    from documents"""))
def _duration(spark, sf):
    raw = F.when(F.col("doc_id") % 14 == 0, None).when(F.col("doc_id") % 7 == 0, "soon").otherwise((F.col("n_chars") / 100.0).cast("string"))
    return _docs(spark, sf).select("doc_id", X.duration_enum(raw).alias("seconds"))


@query("alpha_blend", sql("""
    select doc_id, round(0.7 * (1.0 / (1.0 + exp(-(n_chars % 13)::double / 7))) + 0.3::double * ((n_chars % 11)::double / 11), 6) as score from documents"""))
def _blend(spark, sf):
    a = X.sigmoid((F.col("n_chars") % 13).cast("double") / 7)
    b = (F.col("n_chars") % 11).cast("double") / 11
    return _docs(spark, sf).select("doc_id", r6(X.alpha_blend(F.lit(0.7), a, b)).alias("score"))


@query("linear_schedule", sql("""
    select doc_id, round(0.7::double + (0.5::double - 0.7::double) * least(doc_id::double / greatest(500, 1), 1.0::double), 6) as alpha,
      0.5 as zero_total from documents"""))
def _schedule(spark, sf):
    step = F.col("doc_id").cast("double")
    return _docs(spark, sf).select("doc_id", r6(X.linear_schedule(step, F.lit(500), 0.7, 0.5)).alias("alpha"),
                                   X.linear_schedule(step + 1, F.lit(0), 0.7, 0.5).alias("zero_total"))


@query("fn_round_half_even", sql("""
    select o_orderkey, round_even(o_totalprice::double / 7, 2) as two, round_even((o_orderkey % 8)::double / 4, 1) as one,
      [0.1, 0.3, 2.67, 0.2, 1.0][(o_orderkey % 5 + 1)::int]::double as hard from orders"""))
def _round(spark, sf):
    orders = B.table(spark, sf, "orders")
    place = (F.col("o_orderkey") % 5).cast("int")
    # Values whose binary form lies below a half, and one exact half; the SQL states what they must give.
    one, two = F.array(*map(F.lit, (0.15, 0.35, 2.675, 0.25, 1.005))), (2, 4)
    hard = F.when(place.isin(*two), X.round_half_even(one[place], 2)).otherwise(X.round_half_even(one[place], 1))
    return orders.select("o_orderkey", X.round_half_even(F.col("o_totalprice").cast("double") / 7, 2).alias("two"),
                         X.round_half_even((F.col("o_orderkey") % 8).cast("double") / 4, 1).alias("one"), hard.alias("hard"))


# ---------------------------------------------------------------- JSON

@query("json_extract_array", sql(f"""
    with u as (select sample_index, {UNWRAP} as t from model_outputs),
    c as (select *, regexp_extract(t, '(?s)\\[.*\\]') as sl from u)
    select sample_index, case when starts_with(t, '[') and json_valid(t) then t when starts_with(sl, '[') and json_valid(sl) then sl end as body from c"""))
def _extract(spark, sf):
    return _outputs(spark, sf).select("sample_index", J.json_extract_array(F.col("model_output")).alias("body"))


@query("json_repair_truncated", sql("""
    select s.sample_index, coalesce(s.repaired, false) as repaired, count(i.pos) as n,
      string_agg(case when i.pos is not null then coalesce(i.s->>'$.index', 'x') end, ',' order by i.pos) as seen
    from salvaged s left join items i using (sample_index) group by all"""))
def _repair(spark, sf):
    s = B.salvaged(spark, sf)
    return s.select("sample_index", "repaired", F.size("items").cast("bigint").alias("n"),
                    X.blank_to_null(F.array_join(F.transform("items", lambda x: F.get_json_object(x, "$.index")), ",")).alias("seen"))


LAST = """list_filter(list_transform(list_filter(range(1, length(model_output) + 1), lambda i: model_output[i] = '{o}'),
    lambda i: substr(model_output, i, length(model_output) - instr(reverse(model_output), '{c}') + 2 - i)), lambda x: json_valid(x))[-1]"""


@query("json_recover_last", sql(f"""
    with b as (select sample_index, model_output, trim(rtrim(trim(regexp_replace(trim(model_output), '(?m)^```[^\\n]*\\n?', '', 'g')), '`'), ' ' || chr(10)) as bare
        from model_outputs)
    select sample_index, case when json_valid(bare) then bare else coalesce({LAST.format(o='[', c=']')}, {LAST.format(o='{', c='}')}) end as list_first,
      case when json_valid(bare) then bare else {LAST.format(o='{', c='}')} end as object_only from b"""))
def _recover(spark, sf):
    c = F.col("model_output")
    return _outputs(spark, sf).select("sample_index", J.json_recover_last(c).alias("list_first"),
                                      J.json_recover_last(c, "{").alias("object_only"))


def _shots(spark, sf, wrap=False):
    return B.items(spark, sf).select("sample_index", "pos", J.normalize_shot(F.col("item"), wrap).alias("s"))


@query("normalize_shots", sql("""
    select i.sample_index, i.pos, s->>'$.index' as index, s->>'$.shot_scale' as shot_scale, s->>'$.camera_motion' as camera_motion,
      s->>'$.emotion' as emotion, try_cast(s->>'$.duration' as double) as duration,
      coalesce(n, 0) as n_subjects, coalesce(names, '') as names
    from items i left join (select sample_index, pos, count(*) as n, string_agg(u->>'$.name', ',' order by k) as names from subjects
        join items using (sample_index, pos) where json_type(s->'$.subjects') = 'ARRAY' group by all) x using (sample_index, pos)"""))
def _normalize(spark, sf):
    return _shots(spark, sf).select("sample_index", "pos", "s.index", "s.shot_scale", "s.camera_motion", "s.emotion", "s.duration",
                                    F.size("s.subjects").alias("n_subjects"), F.array_join("s.subjects.name", ",").alias("names"))


@query("safe_text_field", sql(f"""
    select sample_index, pos, {duck_text('shot_scale')} as shot_scale, {duck_text('dialogue')} as dialogue,
      (select count(*) from subjects x where x.sample_index = i.sample_index and x.pos = i.pos)::int as n_subjects from items i"""))
def _safe(spark, sf):
    return B.items(spark, sf).select("sample_index", "pos", J.safe_shot(F.col("item")).alias("s")).select(
        "sample_index", "pos", "s.shot_scale", "s.dialogue", F.size("s.subjects").alias("n_subjects"))


@query("first_result_url", sql("""
    select page_id, case when page_id % 3 = 1 then url end as url from pages"""))
def _url(spark, sf):
    raw = F.expr("""case page_id % 3 when 0 then '{"results": [{"url": ""}, {"note": 1}]}'
        when 1 then '{"results": [{"url": null}, {"url": "' || url || '"}, {"url": "later"}]}' else '{"results": null}' end""")
    return B.table(spark, sf, "pages").select("page_id", J.first_result_url(raw).alias("url"))


@query("is_environment_only", sql("""
    select sample_index, sample_index % 2 = 1 and sample_index % 3 <> 0 as environment_only from model_outputs"""))
def _environment(spark, sf):
    refs = F.expr("if(sample_index % 3 = 0, array('角色1'), array())").cast("array<string>")
    return _prompts(spark, sf).select("sample_index", P.is_environment_only(F.col("prompt"), refs).alias("environment_only"))


# ---------------------------------------------------------------- templates

def _get(field, row="s"):
    return f"coalesce({row}->>'$.{field}', '')"


def _subject_lines(wrap: bool, label: str, parts: list[str], tail: str, need: str | None = None) -> str:
    only = "" if wrap else "where json_type(s->'$.subjects') = 'ARRAY'"
    body = f"{label} || {tail}" if not parts else (
        f"concat_ws('，', {label}, {', '.join(parts)}) || {tail}")
    guard = f"and ({need})" if need else ""
    return (f"(select sample_index, pos, list({body} order by k) filter (true {guard}) as lines from subjects join items using (sample_index, pos) "
            f"{only} group by all)")


LOOK = [f"case when {_get('clothing', 'u')} <> '' then '身穿' || {_get('clothing', 'u')} end", f"nullif({_get('action', 'u')}, '')",
        f"case when {_get('expression', 'u')} <> '' then '表情：' || {_get('expression', 'u')} end"]
PLACE = f"{_get('position', 'u')} || '人物'"
MOTION = _get("camera_motion")


@query("tmpl_description_visual", sql(f"""
    select i.sample_index, i.pos, array_to_string(list_concat(list_filter([
        trim({_get('shot_scale')}) || trim({_get('camera_angle')}) || '镜头' || case when {MOTION} in ('', '固定') then '' else '（' || {MOTION} || '）' end,
        nullif({_get('background')}, '')], lambda x: x is not null), coalesce(lines, [])), '；') || '。' as text
    from items i left join {_subject_lines(False, PLACE, LOOK, "''")} l using (sample_index, pos)"""))
def _t1(spark, sf):
    return _shots(spark, sf).select("sample_index", "pos", P.description_visual(F.col("s")).alias("text"))


@query("tmpl_embedding_text", sql(f"""
    select i.sample_index, i.pos, array_to_string(list_concat(list_filter([
        {_get('shot_scale')} || {_get('camera_angle')} || '镜头（' || {MOTION} || '）', nullif({_get('background')}, '')], lambda x: x is not null),
        coalesce(lines, [])), '；') as text
    from items i left join {_subject_lines(False, PLACE, LOOK, "'。'")} l using (sample_index, pos)"""))
def _t2(spark, sf):
    return _shots(spark, sf).select("sample_index", "pos", P.embedding_text(F.col("s")).alias("text"))


VISUAL = f"""
    visual as (select i.sample_index, i.pos, i.s, array_to_string(list_concat(list_filter([
        {duck_text('shot_scale')} || {_get('camera_angle')} || '镜头' || case when {MOTION} = '' then '' else '（' || {MOTION} || '）' end,
        {_get('background')} || '。'], lambda x: x <> '。'), coalesce(lines, [])), '；') as text
    from items i left join {_subject_lines(True, PLACE, LOOK, "'。'")} l using (sample_index, pos))"""


@query("tmpl_visual_query", sql(f"with {VISUAL} select sample_index, pos, text from visual"))
def _t3(spark, sf):
    return B.items(spark, sf).select("sample_index", "pos", P.visual_query(
        J.safe_shot(F.col("item"), fields=P.QUERY_FIELDS)).alias("text"))


PERSON = [f"case when {_get('position', 'u')} <> '' then '位于' || {_get('position', 'u')} end",
          f"case when {_get('clothing', 'u')} <> '' then '服装：' || {_get('clothing', 'u')} end",
          f"case when {_get('action', 'u')} <> '' then '动作：' || {_get('action', 'u')} end",
          f"case when {_get('expression', 'u')} <> '' then '表情：' || {_get('expression', 'u')} end"]
SHOT_PROMPT = f"""
    prompted as (select i.sample_index, i.pos, i.s, i.source, array_to_string(list_filter([
        trim({_get('shot_scale')} || '，' || {_get('camera_angle')} || '，' || {MOTION}, '，'),
        case when {_get('background')} <> '' then '背景：' || {_get('background')} end,
        case when len(lines) > 0 then '人物：' || array_to_string(lines, '；') end,
        '画面描述：' || {_get('description_narrative')},
        case when {_get('dialogue')} <> '' then '台词：' || case when {_get('speaker')} = '' then '角色' else {_get('speaker')} end
          || '说“' || {_get('dialogue')} || '”' end,
        case when {_get('emotion')} <> '' then '情绪：' || {_get('emotion')} end], lambda x: x is not null), '。') || '。' as prompt,
        try_cast(s->>'$.duration' as double) as duration
    from items i left join {_subject_lines(False, f"nullif({_get('name', 'u')}, '')", PERSON, "''")} l using (sample_index, pos))"""


@query("tmpl_shot_prompt", sql(f"with {SHOT_PROMPT} select sample_index, pos, prompt as text from prompted"))
def _t4(spark, sf):
    return _shots(spark, sf).select("sample_index", "pos", P.shot_prompt(F.col("s")).alias("text"))


def _lit(x):
    return "'" + x.replace("'", "''") + "'"


@query("tmpl_first_frame_prompt", sql(f"""
    select sample_index, array_to_string(list_concat([{CLEAN}],
      case when sample_index % 3 = 0 then [{_lit(T.FRAME_REFS)}, '使用图1作为角色参考图，保持角色 角色1 的外观、脸部特征和服装一致。'] else [] end,
      ['使用图' || (case when sample_index % 3 = 0 then 2 else 1 end) || {_lit(T.FRAME_DEPTH[1])}],
      case when sample_index % 2 = 1 and sample_index % 3 <> 0 then ['使用图2' || {_lit(T.FRAME_ENVIRONMENT[0][1])}, {_lit(T.FRAME_ENVIRONMENT[1])}]
      else ['使用图' || (case when sample_index % 3 = 0 then 3 else 2 end) || {_lit(T.FRAME_PEOPLE[0][1])}, {', '.join(_lit(x) for x in T.FRAME_PEOPLE[1:])}] end,
      [{', '.join(_lit(x) for x in T.FRAME_TAIL)}]), chr(10)) as text from model_outputs"""))
def _t5(spark, sf):
    refs = F.expr("if(sample_index % 3 = 0, array('角色1'), array())").cast("array<string>")
    return _prompts(spark, sf).select("sample_index", P.first_frame_prompt(F.col("prompt"), refs).alias("text"))


@query("tmpl_control_prompt", sql(f"""
    select page_id, {_lit(T.CONTROL_HEAD)} || drama || {_lit(T.CONTROL_HINT)} || case page_id % 4 when 0 then {_lit(T.CONTROL_NONE)}
      when 1 then {_lit(T.CONTROL_DEPTH)} when 2 then {_lit(T.CONTROL_POSE)} else {_lit(T.CONTROL_DEPTH + '，' + T.CONTROL_POSE)} end || {_lit(T.CONTROL_TAIL)} as text,
      drama || {_lit(T.CHARACTER_TAIL)} as character_text
    from paths"""))
def _t6(spark, sf):
    p = B.paths(spark, sf)
    depth = F.when(F.col("page_id") % 2 == 1, F.lit("d.png"))
    pose = F.when(F.floor(F.col("page_id") / 2) % 2 == 1, F.lit("p.png"))
    return p.select("page_id", P.control_prompt(F.col("drama"), depth, pose).alias("text"),
                    P.character_prompt(F.col("drama")).alias("character_text"))


@query("tmpl_repair_prompt", sql(f"""
    select sample_index, {_lit(T.REPAIR_HEAD)} || case when sample_index % 2 = 0 then '  - ' || source || '：' || lang else {_lit(T.NONE_LINE)} end
      || {_lit(T.REPAIR_PLOT)} || 'plot ' || lang || {_lit(T.REPAIR_DIALOGUE)} || '  a' || chr(10) || '  "b"'
      || {_lit(T.REPAIR_INPUT)} || '{{' || chr(10) || '  "0": "x \\"' || lang || '\\"",' || chr(10) || '  "1": ""' || chr(10) || '}}'
      || {_lit(T.REPAIR_RULES)} || '{{' || chr(10) || '  "0": "...",' || chr(10) || '  "1": "..."' || chr(10) || '}}' || chr(10)
      || case when sample_index % 3 = 0 then '' else {_lit(T.RETRY_OBJECT[0])} || (sample_index % 3) || {_lit(T.RETRY_OBJECT[1])} || (sample_index % 3 - 1) || {_lit(T.RETRY_OBJECT[2])} end as text
    from model_outputs"""))
def _t7(spark, sf):
    people = F.expr("if(sample_index % 2 = 0, array(named_struct('name', source, 'features', lang)), "
                    "cast(array() as array<struct<name:string,features:string>>))")
    lines = F.create_map(F.lit("0"), F.concat(F.lit('x "'), "lang", F.lit('"')), F.lit("1"), F.lit(""))
    prompt = P.repair_prompt(lines, people, F.concat(F.lit("plot "), "lang"), F.array(F.lit("a"), F.lit('"b"')))
    expected = F.when(F.col("sample_index") % 3 != 0, F.col("sample_index") % 3)
    return _outputs(spark, sf).select("sample_index", F.concat(prompt, P.retry_suffix(expected)).alias("text"))


_ANALYSIS = ("Frames: ", "\nPeople:\n", "\nPlot: ", "\nLines:\n", "\nAnswer with one object per frame.")


@query("tmpl_analysis_prompt", sql(f"""
    select sample_index, {_lit(_ANALYSIS[0])} || (sample_index % 4 + 1) || {_lit(_ANALYSIS[1])}
      || case when sample_index % 2 = 0 then '  - ' || source || '：' || lang else {_lit(T.NONE_LINE)} end
      || {_lit(_ANALYSIS[2])} || case when sample_index % 3 = 0 then {_lit(T.NO_PLOT)} else user_text end
      || {_lit(_ANALYSIS[3])} || '  a' || chr(10) || '  ' || lang || {_lit(_ANALYSIS[4])} || {_lit(T.RETRY_ARRAY[0])}
      || (sample_index % 4 + 1) || {_lit(T.RETRY_ARRAY[1])} || (sample_index % 4) || {_lit(T.RETRY_ARRAY[2])} as text
    from model_outputs"""))
def _analysis(spark, sf):
    people = F.expr("if(sample_index % 2 = 0, array(named_struct('name', source, 'features', lang)), "
                    "cast(array() as array<struct<name:string,features:string>>))")
    n = F.col("sample_index") % 4 + 1
    plot = F.when(F.col("sample_index") % 3 != 0, F.col("user_text"))
    text = P.analysis_prompt(_ANALYSIS, n, people, plot, F.array(F.lit("a"), F.col("lang")))
    return _outputs(spark, sf).select("sample_index", text.alias("text"))


@query("tmpl_judge_prompt", sql(f"""
    with n as (select sample_index, list(coalesce(s->>'$.description_narrative', '') order by pos) as l from items group by all)
    select sample_index, '请对以下 2' || {_lit(T.JUDGE_INTRO[0][1])} || {_lit(T.JUDGE_INTRO[1][0])} || '2' || {_lit(T.JUDGE_INTRO[1][1])} || '[1, 2]'
      || {_lit(T.JUDGE_INTRO[1][2])} || {_lit(T.JUDGE_INTRO[2])} || {_lit(T.JUDGE_ITEM[0] + '1' + T.JUDGE_ITEM[1])} || ',' || chr(10) || ' '
      || {_lit(T.JUDGE_ITEM[0] + '2' + T.JUDGE_ITEM[1])} || chr(10) || ']' || chr(10) || chr(10) || '=== 序列 1 ===' || chr(10)
      || array_to_string(list_transform(l, lambda x, i: '  ' || i || '. ' || x), chr(10)) || chr(10) || chr(10)
      || '=== 序列 2 ===' || chr(10) || '  1. only' as text from n"""))
def _t8(spark, sf):
    n = B.salvaged(spark, sf).filter(F.size("items") > 0).select(
        "sample_index", F.transform("items", lambda x: F.coalesce(F.get_json_object(x, "$.description_narrative"), F.lit(""))).alias("l"))
    return n.select("sample_index", P.judge_prompt(F.array(F.col("l"), F.array(F.lit("only")))).alias("text"))


@query("tmpl_chat_messages", sql("""
    select conv_id, turn, case when turn % 2 = 0 then 'system|user' else 'system|user|assistant' end as roles,
      'be exact|' || text || case when turn % 2 = 0 then '' else '|' || role end as contents from conversations"""))
def _t9(spark, sf):
    reply = F.when(F.col("turn") % 2 == 1, F.col("role"))
    m = B.table(spark, sf, "conversations").select("conv_id", "turn", P.chat_messages(F.lit("be exact"), F.col("text"), reply).alias("m"))
    return m.select("conv_id", "turn", F.array_join("m.role", "|").alias("roles"), F.array_join("m.content", "|").alias("contents"))
