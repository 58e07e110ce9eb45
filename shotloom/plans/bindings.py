"""Views that give the test tables the shape of a shot corpus.

Each view exists twice: a Spark function, and a DuckDB common table expression for the
checks.  Operators know nothing about either.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotloom.functions.jsonfix import explode_items, with_repaired_items
from shotloom.operators.ordered import rank_in_group

EPISODE_LEN = 20
FPS = 25.0
BATCH = 128
MIN_LEN = 3


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """A table that is read in fewer tasks than there are cores, dealt to all of them; any other as it is.

    The small test tables are one row group each, which one task reads whole.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


# ---------------------------------------------------------------- shots with three vectors

def shots(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, drama, episode, shot_index, shot_id, text, depth, pose."""
    emb = table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("bigint").alias("drama"), F.col("embedding").cast("array<double>").alias("depth"))
    ranked = rank_in_group(emb, ["drama"], [F.col("vec_id")], F.floor(F.col("vec_id") / 100000), "rn")
    follower = emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("depth").alias("pose"))
    return (ranked.join(follower, "vec_id", "left")
            .select("vec_id", "drama",
                    F.expr(f"rn div {EPISODE_LEN}").cast("bigint").alias("episode"),
                    (F.col("rn") % EPISODE_LEN).cast("bigint").alias("shot_index"),
                    F.transform("depth", lambda x, i: F.when(i < 8, x).otherwise(0.0)).alias("text"),
                    "depth", F.coalesce("pose", "depth").alias("pose"))
            .withColumn("shot_id", F.concat_ws("|", "drama", "episode", "shot_index")))


def pixel_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings read as pixel vectors: video, frame_no, hue, sat."""
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("video"),
                                                F.col("embedding").cast("array<double>").alias("px"))
    ranked = rank_in_group(emb, ["video"], [F.col("vec_id")], F.floor(F.col("vec_id") / 100000), "frame_no")
    return ranked.select("video", "frame_no", F.slice("px", 1, 32).alias("hue"), F.slice("px", 33, 32).alias("sat"),
                         "px")


# ---------------------------------------------------------------- frame metrics

def frames(spark: SparkSession, sf: str) -> DataFrame:
    """video, frame_no, diff, brightness."""
    ev = table(spark, sf, "events").select(F.col("user_id").alias("video"), "ts", "event_id",
                                           F.col("value").alias("diff"), F.col("value").alias("brightness"))
    ranked = rank_in_group(ev, ["video"], [F.col("ts"), F.col("event_id")], F.date_trunc("day", "ts"), "frame_no")
    return ranked.select("video", "frame_no", "diff", "brightness")


# ---------------------------------------------------------------- timeline, transcript, shot rows, plots

def _conv(spark: SparkSession, sf: str) -> DataFrame:
    conv = table(spark, sf, "conversations")
    nxt = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit(False).alias("_last"))
    return (conv.join(nxt, ["conv_id", "turn"], "left")
            .select((F.col("conv_id") % 10).alias("drama"), F.col("conv_id").alias("episode"), "turn", "role", "text",
                    F.coalesce("_last", F.lit(True)).alias("is_last")))


def timeline(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") % 10).alias("drama"), F.col("conv_id").alias("episode"), F.col("turn").alias("segment_index"),
        (F.col("turn") * 1.5).cast("double").alias("start_sec"),
        (F.col("turn") * 1.5 + 1.0 + (F.length("text") % 7) * 0.25).cast("double").alias("end_sec"))


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    c = _conv(spark, sf)
    return (c.filter(~(F.col("is_last") & (F.col("episode") % 7 == 0)))
            .select("drama", "episode", F.col("turn").alias("idx"),
                    F.when(F.col("role") == "system", "").otherwise(F.col("text")).alias("text")))


def shot_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = _conv(spark, sf)
    return (c.filter((F.col("episode") % 11 != 0) & ~(F.col("is_last") & (F.col("episode") % 5 == 0)))
            .select("drama", "episode", F.col("turn").alias("index"), "role",
                    F.concat(F.lit("shot of "), "role").alias("description")))


def plots(spark: SparkSession, sf: str) -> DataFrame:
    return (table(spark, sf, "conversations").filter("turn = 0")
            .select((F.col("conv_id") % 10).alias("drama"), F.col("conv_id").alias("episode"),
                    F.col("text").alias("plot_summary")))


# ---------------------------------------------------------------- generated storyboards

def _subject(d: str) -> str:
    return ("'{\"name\": \"角色' || cast(" + d + " % 3 as string) || '\", \"gender\": \"女\", \"clothing\": \"' || lang || "
            "'长裙\", \"position\": \"画面' || case when " + d + " % 2 = 0 then '左侧' else '' end || '\", \"action\": \"转身走向' "
            "|| source || '\", \"expression\": \"' || case when " + d + " % 5 = 0 then '' else '微笑' end || '\"}'")


def _shot(i: str) -> str:
    """JSON text of shot number ``i`` of a document, with absent keys and odd types mixed in."""
    d = f"(doc_id + {i})"
    subjects = (f"case cast({d} % 6 as int) when 0 then '[]' when 1 then {_subject(d)} when 2 then '\"none\"' "
                f"when 3 then '[' || {_subject(d)} || ', \"x\", ' || {_subject(f'(doc_id + {i} + 1)')} || ']' "
                f"else '[' || {_subject(d)} || ']' end")
    duration = (f"case cast({d} % 5 as int) when 0 then '\"2.5\"' when 1 then '\"abc\"' when 2 then 'null' "
                f"else cast({d} % 4 as string) || '.5' end")
    told = f"substr(told, cast({i} as int) * {PART} + 1, {PART})"
    scale = (f"case cast({d} % 7 as int) when 0 then '{{\"a\": \"中景\", \"b\": \"近景\"}}' "
             f"when 1 then '[\"特写\", \"全景\"]' when 2 then '3' else '\"中景\"' end")
    return (
        f"'{{\"index\": ' || cast({i} as string) || ', \"shot_scale\": ' || {scale} || ', \"camera_angle\": \"平拍\", ' || "
        f"case when {d} % 4 = 0 then '' else '\"camera_motion\": \"' || case when {d} % 3 = 0 then '固定' else '跟拍' end || '\", ' end || "
        f"'\"subjects\": ' || {subjects} || ', \"background\": \"' || case when {d} % 9 = 0 then '' else lang || '走廊' end || "
        f"'\", \"description_narrative\": \"角色' || cast({d} % 3 as string) || '在' || source || '停下' || {told} || '\", ' || "
        f"'\"dialogue\": ' || case when {d} % 3 = 0 then 'null' else '\"台词' || cast(doc_id as string) || {told} || '}}\"' end || "
        f"', \"speaker\": ' || case when {d} % 2 = 0 then 'null' else '\"角色1\"' end || "
        f"case when {d} % 5 = 0 then '' else ', \"emotion\": \"平静\"' end || ', \"duration\": ' || {duration} || '}}'"
    )


# A document of n characters has a shot for each PART of them, and one more by its id: the whole text passes through.
PART = 1500
LAST_SHOT = f"cast(floor(length(told) / {PART}) + doc_id % 3 as int)"
# White space and JSON's own marks cannot stand inside a JSON text as they are.
TOLD = "replace(replace(replace(text, chr(92), '/'), chr(34), '”'), chr(10), ' ')"


def _clean_spark() -> str:
    shot = _shot("cast(i as bigint)")
    return f"'[' || array_join(transform(sequence(0, {LAST_SHOT}), i -> {shot}), ', ') || ']'"


def _clean_duck() -> str:
    return f"'[' || array_to_string(list_transform(range(0, {LAST_SHOT} + 1), lambda i: {_shot('i')}), ', ') || ']'"


MODEL_OUTPUT = (
    "case cast(doc_id % 6 as int) when 0 then clean when 1 then '```json' || chr(10) || clean || chr(10) || '```'"
    " when 2 then '<think>plan [1]</think>' || clean || '<END>'"
    " when 3 then substr(clean, 1, cast(length(clean) - 30 as int))"
    " when 4 then 'Here it is: ' || clean || ' Hope it helps.'"
    " else 'no storyboard ' || cast(doc_id as string) end")


def model_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """sample_index, source, lang, user_text, model_output."""
    return outputs_of(dealt(table(spark, sf, "documents").select("doc_id", "source", "lang", "text"), "doc_id"), plots(spark, sf))


def outputs_of(documents: DataFrame, plot_rows: DataFrame) -> DataFrame:
    """The same from a document table or stream."""
    docs = documents.select("doc_id", "source", "lang", F.expr(TOLD).alias("told"))
    p = plot_rows.select(F.col("episode").alias("conv_id"), "plot_summary")
    keyed = docs.withColumn("conv_id", F.expr("doc_id % 1200"))
    return (keyed.join(p, "conv_id", "left")
            .withColumn("clean", F.expr(_clean_spark()))
            .select(F.col("doc_id").alias("sample_index"), "source", "lang",
                    F.expr("'【剧情摘要】' || chr(10) || coalesce(plot_summary, 'unknown plot') || chr(10) || chr(10) || "
                           "'【出场角色】' || chr(10) || '角色0、角色' || lang").alias("user_text"),
                    F.expr(MODEL_OUTPUT).alias("model_output")))


# ---------------------------------------------------------------- packing, runs, ledger, paths

TASKS = ("single_shot", "multifield", "ordering", "summary_compress", "long_form")


def pack_items(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(t) for t in TASKS])
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("sample_index"), names[(F.col("doc_id") % 5).cast("int")].alias("task_type"),
        F.col("n_chars").alias("length"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.concat("p_brand", "p_type").alias("signature"), F.col("p_partkey").alias("seq"),
        F.element_at(F.array(*[F.lit(s) for s in ("done", "failed", "timeout", "done")]),
                     (F.col("p_size") % 4 + 1).cast("int")).alias("status"),
        F.col("p_retailprice").cast("double").alias("metric"))


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    status = (F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "RUNNING")
              .otherwise("FAILED"))
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("event_no"), F.col("o_orderdate").alias("happened"),
        status.alias("status"))


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """One file listing row per page: drama, lang, stem and a path with a media suffix."""
    url = F.col("url")
    num = F.regexp_extract(url, r"^https?://[^/]+/[a-z]+/([0-9]+)", 1)
    return table(spark, sf, "pages").select(
        "page_id", F.regexp_extract(url, r"^https?://([^/]+)/", 1).alias("drama"),
        F.regexp_extract(url, r"^https?://[^/]+/([a-z]+)/", 1).alias("lang"), num.alias("num"),
        F.when(url.contains("#"), F.concat(F.lit("ep_"), num)).otherwise(num).alias("stem"),
        F.when(url.contains(".html"), "MP4").when(url.contains("?"), "txt").otherwise("mkv").alias("suffix"))


# ---------------------------------------------------------------- DuckDB twins

DUCK: dict[str, str] = {
    "shots": f"""
        select e.vec_id, e.drama, e.rn // {EPISODE_LEN} as episode, e.rn % {EPISODE_LEN} as shot_index,
          concat_ws('|', e.drama, e.rn // {EPISODE_LEN}, e.rn % {EPISODE_LEN}) as shot_id,
          list_transform(e.v, lambda x, i: case when i <= 8 then x else 0.0::double end) as text,
          e.v as depth, coalesce(n.embedding::double[], e.v) as pose
        from (select vec_id, label::bigint as drama, embedding::double[] as v,
                row_number() over (partition by label order by vec_id) - 1 as rn from embeddings) e
        left join embeddings n on n.vec_id = e.vec_id + 1""",
    "imgs": """
        select *, list_transform(m, lambda x: x / greatest(sqrt(list_dot_product(m, m)), 1e-8)) as img
        from (select *, list_transform(list_zip(depth, pose), lambda z: (z[1] + z[2]) / 2.0) as m from shots)""",
    "pixel_frames": """
        select label::bigint as video, row_number() over (partition by label order by vec_id) - 1 as frame_no,
          embedding::double[] as px from embeddings""",
    "frames": """
        select user_id as video, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_no,
          value as diff, value as brightness from events""",
    "conv": """
        select conv_id % 10 as drama, conv_id as episode, turn, role, text,
          turn = max(turn) over (partition by conv_id) as is_last from conversations""",
    "timeline": """
        select drama, episode, turn as segment_index, (turn * 1.5)::double as start_sec,
          (turn::double * 1.5 + 1.0 + (length(text) % 7)::double * 0.25)::double as end_sec from conv""",
    "transcripts": """
        select drama, episode, turn as idx, case when role = 'system' then '' else text end as text
        from conv where not (is_last and episode % 7 = 0)""",
    "shot_rows": """
        select drama, episode, turn as index, role, 'shot of ' || role as description
        from conv where episode % 11 <> 0 and not (is_last and episode % 5 = 0)""",
    "plots": """
        select conv_id % 10 as drama, conv_id as episode, text as plot_summary from conversations where turn = 0""",
    "model_outputs": f"""
        select doc_id as sample_index, source, lang, '【剧情摘要】' || chr(10) || coalesce(plot_summary, 'unknown plot')
          || chr(10) || chr(10) || '【出场角色】' || chr(10) || '角色0、角色' || lang as user_text,
          {MODEL_OUTPUT} as model_output
        from (select d.*, p.plot_summary, {_clean_duck()} as clean from (select *, {TOLD} as told from documents) d
              left join plots p on p.episode = d.doc_id % 1200)""",
    "stripped": r"""
        select *, json_valid(t) and starts_with(t, '[') as whole, substr(t, greatest(instr(t, '['), 1)) as body
        from (select *, trim(replace(regexp_replace(model_output, '(?s)<think>.*?</think>', '', 'g'), '<END>', '')) as t
              from model_outputs)""",
    # Where the last object ends that is complete in the first array: depth and place run over strings and brackets.
    "cuts": r"""
        select sample_index, max(stop) filter (mark = '}' and depth = 1 and stop < closed) as cut from (
          select *, min(stop) filter (depth = 0 and mark = ']') over (partition by sample_index) as closing,
            coalesce(closing, 9e18) as closed from (
            select sample_index, mark, sum(length(mark)) over w as stop,
              sum(case when mark in ('[', '{') then 1 when mark in (']', '}') then -1 else 0 end) over w as depth
            from (select sample_index, unnest(marks) as mark, generate_subscripts(marks, 1) as k from (select sample_index,
              regexp_extract_all(body, '"(?:[^"\\]|\\.)*"?|[\[\]{}]|[^"\[\]{}]+', 0, 's') as marks from stripped where not whole))
            window w as (partition by sample_index order by k))) group by sample_index""",
    "salvaged": r"""
        select sample_index, source, lang, user_text, arr, not whole and arr is not null
            and substr(ltrim(substr(body, length(arr))), 1, 1) <> ']' as repaired
        from (select *, case when whole then t when cut is not null then substr(body, 1, cut::bigint) || ']' end as arr
              from stripped left join cuts using (sample_index))""",
    "items": """
        select sample_index, source, lang, repaired, pos, l[pos + 1] as s from (
          select *, unnest(range(len(l))) as pos from (
            select *, list_filter(json_extract(arr::json, '$[*]'), lambda x: json_type(x) = 'OBJECT') as l
            from salvaged where arr is not null))""",
    "subjects": """
        select sample_index, pos, k, l[k + 1] as u from (select sample_index, pos, l, unnest(range(len(l))) as k from (
          select sample_index, pos, list_filter(case json_type(s->'$.subjects') when 'OBJECT' then [s->'$.subjects']
            when 'ARRAY' then json_extract(s, '$.subjects[*]') else [] end, lambda x: json_type(x) = 'OBJECT') as l
          from items))""",
    "pack_items": f"""
        select doc_id as sample_index, {list(TASKS)}[(doc_id % 5 + 1)::int] as task_type, n_chars as length
        from documents""",
    "runs": """
        select p_brand || p_type as signature, p_partkey as seq,
          ['done', 'failed', 'timeout', 'done'][(p_size % 4 + 1)::int] as status, p_retailprice::double as metric
        from part""",
    "ledger": """
        select o_custkey as task, o_orderkey as event_no, o_orderdate as happened,
          case o_orderstatus when 'F' then 'SUCCESS' when 'O' then 'RUNNING' else 'FAILED' end as status from orders""",
    "paths": r"""
        select page_id, regexp_extract(url, '^https?://([^/]+)/', 1) as drama,
          regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) as lang,
          regexp_extract(url, '^https?://[^/]+/[a-z]+/([0-9]+)', 1) as num,
          case when contains(url, '#') then 'ep_' else '' end
            || regexp_extract(url, '^https?://[^/]+/[a-z]+/([0-9]+)', 1) as stem,
          case when contains(url, '.html') then 'MP4' when contains(url, '?') then 'txt' else 'mkv' end as suffix
        from pages""",
}


def _six_digits(text: str) -> str:
    """Expand ``round(x, 6)`` to the same arithmetic as ``functions.vectors.r6``."""
    at = text.find("round(")
    while at >= 0:
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        inner = text[at + 6:end - 1]
        if inner.endswith(", 6"):
            text = f"{text[:at]}(ROUND((({inner[:-3]}) + 1e-9) * 1e6) / 1e6){text[end:]}"
        at = text.find("round(", at + 1)
    return text


def sql(body: str) -> str:
    """Prefix ``body`` with the views it names, in dependency order.

    A body may start its own CTE list with ``with``.
    """
    body = _six_digits(body)
    names = list(DUCK)
    used: list[str] = []

    def need(text: str) -> None:
        for n in names:
            if n not in used and re.search(rf"\b(from|join|,)\s+{n}\b", text):
                need(DUCK[n])
                used.append(n)

    need(body)
    views = ", ".join(f"{n} as ({DUCK[n]})" for n in used)
    stripped = body.strip()
    if stripped.lower().startswith("with recursive"):
        return f"with recursive {views}, {stripped[14:]}" if views else stripped
    if stripped.lower().startswith("with "):
        return f"with {views}, {stripped[5:]}" if views else stripped
    return f"with {views} {stripped}" if views else stripped


# ---------------------------------------------------------------- storyboard items, both engines

def salvaged(spark: SparkSession, sf: str) -> DataFrame:
    return with_repaired_items(model_outputs(spark, sf), "model_output").drop("model_output")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """sample_index, source, lang, repaired, pos, item: raw text of each recovered shot object."""
    return explode_items(salvaged(spark, sf).drop("user_text"))


def duck_text(field: str, row: str = "s") -> str:
    """Text of a leaf in DuckDB: the parts of an object or array joined, else the scalar."""
    path = f"$.{field}"
    return (f"case json_type({row}->'{path}') when 'OBJECT' then array_to_string(json_extract_string({row}, '{path}.*'), '，') "
            f"when 'ARRAY' then array_to_string(json_extract_string({row}, '{path}[*]'), '，') "
            f"else coalesce({row}->>'{path}', '') end")
