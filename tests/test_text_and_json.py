import json

import pytest
from pyspark.sql import functions as F

from shotloom.functions import fixed_text as T
from shotloom.functions import jsonfix as J
from shotloom.functions import templates as P
from shotloom.functions import text as X
from shotloom.operators import rewards as R


def _map(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r["x"] for r in df.select("i", fn(F.col("c")).alias("x")).orderBy("i").collect()]


SHOT = {"index": 0, "shot_scale": "中景", "camera_angle": "平拍", "camera_motion": "固定",
        "subjects": [{"name": "甲", "gender": "男", "clothing": "黑衣", "position": "左侧", "action": "走}近", "expression": ""}],
        "background": "走廊", "description_narrative": "甲走近", "dialogue": None, "speaker": None, "emotion": None, "duration": 2.5}
A = json.dumps([SHOT], ensure_ascii=False)
TWO = json.dumps([SHOT, {**SHOT, "index": 1}], ensure_ascii=False)


def test_u_escapes(spark):
    assert _map(spark, X.decode_u_escapes, ["#U4e2d", "#U1F600", "#U110000", "a#U4e", "#U4E2Dx#U6587!"]) == [
        "中", "😀", "#U110000", "a#U4e", "中x文!"]


def test_sections(spark):
    s = "头\n【剧情摘要】\n 甲\n乙 \n\n【出场角色】\n丙"
    assert _map(spark, lambda c: X.extract_section(c, T.PLOT_TITLE), [s, "none"]) == ["甲\n乙", ""]
    assert _map(spark, lambda c: X.extract_section(c, T.CAST_TITLE), [s]) == ["丙"]
    assert _map(spark, X.plot_summary, [s, "【剧情摘要】\n甲\n\n乙", "【剧情摘要】\n甲\n", "x"]) == ["甲\n乙", "甲", "甲", ""]


def test_fence_and_unwrap(spark):
    assert _map(spark, X.strip_code_fence, [" ```json\n[1]\n``` ", "[1]```", "```\n[1]"]) == ["[1]", "[1]```", "[1]"]
    assert _map(spark, X.unwrap_model_output, ['"[1] \\"a\\""<END>', '"broken', '"a" "b"']) == ['[1] "a"', '"broken', '"a" "b"']


def test_trim_takes_unicode_space(spark):
    assert _map(spark, X.trim_all, ["\u3000 a b\u00a0\n"]) == ["a b"]


def test_names_and_paths(spark):
    assert _map(spark, X.sanitize_filename, ["李 雷!", "__", "a-b_c"]) == ["李_雷", "character", "a-b_c"]
    assert _map(spark, lambda c: X.rebase_path(c, "/r"), ["D:\\x\\Videos\\a\\1.mp4", "/no/match"]) == ["/r/Videos/a/1.mp4", "/no/match"]
    assert _map(spark, lambda c: X.serialize_path(c, "relative", "/a/b"), ["/a/b/c", "/a/x", "/q", "rel"]) == ["c", "../x", "../../q", "rel"]


def test_durations(spark):
    assert _map(spark, X.duration_enum, ["2.5", "0.2", "99", None, "abc", "nan"]) == ["3", "1", "16", "5", "5", "5"]


def test_split_names(spark):
    assert _map(spark, X.infer_split, [["a/train_x.json"], ["x_val.json", "val"], ["train", "test"], ["trainer"]],
                "array<string>") == ["train", "val", "unknown", "unknown"]


def test_metrics_line(spark):
    log = "x\nTest Results | R@1=0.1 R@1=0.2 note=bad pos=1e-2\nR@5=9"
    assert _map(spark, X.parse_metrics, [log]) == [{"test_R@1": 0.2, "test_pos": 0.01}]


@pytest.mark.parametrize("text,ok", [("{}", True), ('{"a":1} x', False), ("[1]", True), ("[1],[2]", False), ("", False),
                                     ("1", True), ('"a"', True), ("[1", False), ("}{", False), (" [1] ", True)])
def test_strict_json(spark, text, ok):
    assert _map(spark, J.json_strict, [text]) == [ok]


def test_array_extraction(spark):
    texts = [A, f"```json\n{A}\n```", f"ok {A} bye", A[:-20], "none", '{"a": [1]}', A + "<END>"]
    assert _map(spark, J.json_extract_array, texts) == [A, A, A, None, None, "[1]", A]


def test_truncation_repair(spark):
    def run(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
        return [(len(r["items"]), r["repaired"]) for r in sorted(J.with_repaired_items(df, "c").collect())]

    assert run([TWO, TWO[:-30], f"<think>[</think>{TWO}<END>", f"say {TWO} done", "none", "[", "[5, " + A[1:]]) == [
        (2, False), (1, True), (2, False), (2, False), (0, False), (0, False), (1, False)]
    assert run(['[{"a":1}{"b":2}', '[{"a":"}"},{"b":', "[]"]) == [(2, True), (1, True), (0, False)]


def test_last_value_recovery(spark):
    texts = ['note {"a": 1} and {"b": 2}', "x [1] y [2, 3]", '```json\n{"a": [1]}\n```', "nothing", '{"a": [1}']
    assert _map(spark, J.json_recover_last, texts) == ['{"b": 2}', "[2, 3]", '{"a": [1]}', None, None]
    assert _map(spark, lambda c: J.json_recover_last(c, "{"), ["x [1]"]) == [None]


def test_normalisation(spark):
    items = [json.dumps({**SHOT, "duration": d}) for d in ("2.5", "abc", None, 3)] + ["{}"]
    assert [r["duration"] for r in _map(spark, J.normalize_shot, items)] == [2.5, None, None, 3.0, None]
    lone = json.dumps({"subjects": {"name": "甲"}})
    assert [len(r["subjects"]) for r in _map(spark, J.normalize_shot, [lone])] == [0]
    assert [len(r["subjects"]) for r in _map(spark, lambda c: J.normalize_shot(c, True), [lone])] == [1]


def test_safe_text(spark):
    got = _map(spark, J.safe_text, [" a ", None, '{"x": "甲", "y": ["乙", {"z": "丙"}], "n": null}', '["b", "", "c"]', "3"])
    assert got[0:2] == ["a", ""] and got[3:] == ["b，c", "3"] and got[2].startswith("甲，乙，")


def plain_text(v):
    """The coercion of a decoded value, level by level."""
    if v is None:
        return ""
    if isinstance(v, (dict, list)):
        parts = [plain_text(x) for x in (v.values() if isinstance(v, dict) else v)]
        return "，".join(p for p in parts if p)
    return v.strip() if isinstance(v, str) else str(v)


def test_safe_text_of_any_depth_and_kind(spark):
    deep = "leaf"
    for k in range(40):
        deep = [deep, f"n{k}"] if k % 2 else {"z": deep, "a": f' "quoted" \\ {k}: [x], {{y}} \n'}
    values = [deep, {"b": 1, "a": True, "c": [False, None, 2.5, "", "  "]}, [], {}, True, False, "true", "{not json}", "[1, 2]", 7, 1.5, None,
              {"k:": "v:", "角": ["\\", '"', "\\\""]}, "  x  "]
    shots = [json.dumps({"shot_scale": v, "subjects": [{"name": v}]}, ensure_ascii=k % 2 == 0) for k, v in enumerate(values)]
    got = _map(spark, J.safe_shot, shots)
    assert [r["shot_scale"] for r in got] == [plain_text(v) for v in values]
    assert [r["subjects"][0]["name"] for r in got] == [plain_text(v) for v in values]


def test_elements_need_exactly_one_array(spark):
    texts = ['[{"a":1}, "x", null]', '[1],[2]', '[1] x', '[{"a":1}', "5", "[]", '[1]],["A"]] [', "[NaN]", "[1,]", None]
    assert _map(spark, J.json_elements, texts) == [['{"a":1}', "x", None], None, None, None, None, [], None, None, None, None]


def test_format_score_tells_texts_from_empty_lists(spark):
    full = {**SHOT, "subjects": []}
    as_text = {**SHOT, "subjects": "[]"}
    assert _map(spark, R.format_score, [[json.dumps(s)] for s in (full, as_text)], "array<string>") == pytest.approx(
        [0.6 * len(full) / 11 + 0.3 * filled(full), 0.6 * len(full) / 11 + 0.3 * filled(as_text)])


def filled(shot):
    names = ("shot_scale", "camera_angle", "camera_motion", "subjects", "background", "description_narrative")
    return sum(bool(v.strip() if isinstance(v := shot.get(f), str) else v) for f in names) / 6


def _templated(spark, fn, shots, wrap=False):
    return _map(spark, lambda c: fn(J.normalize_shot(c, wrap)), [json.dumps(s, ensure_ascii=False) for s in shots])


def test_three_descriptions_differ(spark):
    bare = {"shot_scale": "近景", "subjects": [{}], "background": "街。"}
    assert _templated(spark, P.description_visual, [SHOT, bare, {}]) == [
        "中景平拍镜头；走廊；左侧人物，身穿黑衣，走}近。", "近景镜头；街。。", ""]
    assert _templated(spark, P.embedding_text, [SHOT, bare, {}]) == [
        "中景平拍镜头（固定）；走廊；左侧人物，身穿黑衣，走}近。", "近景镜头（）；街。；人物。", ""]
    assert _templated(spark, P.visual_query, [SHOT, bare, {}]) == [
        "中景平拍镜头（固定）；走廊。；左侧人物，身穿黑衣，走}近。", "近景镜头；街。；人物。", "镜头"]


def test_shot_prompt(spark):
    spoken = {**SHOT, "dialogue": "走", "emotion": "急"}
    assert _templated(spark, P.shot_prompt, [SHOT, spoken, {"camera_angle": "平拍"}, {}]) == [
        "中景，平拍，固定。背景：走廊。人物：甲，位于左侧，服装：黑衣，动作：走}近。画面描述：甲走近。",
        "中景，平拍，固定。背景：走廊。人物：甲，位于左侧，服装：黑衣，动作：走}近。画面描述：甲走近。台词：角色说“走”。情绪：急。", "平拍。", "。"]


def test_first_frame_prompt_numbers_its_images(spark):
    df = spark.createDataFrame([("人物：甲\n控制条件：x", ["甲", "乙"]), ("空街", [])], "p string, r array<string>")
    with_people, empty = [r["x"] for r in df.select(P.first_frame_prompt(F.col("p"), F.col("r")).alias("x")).collect()]
    assert "使用图2作为角色参考图，保持角色 乙" in with_people and "使用图3深度图" in with_people and "使用图4骨架图作为" in with_people
    assert "控制条件" not in with_people
    assert "使用图1深度图" in empty and "使用图2骨架图仅作为" in empty and "纯环境镜头" in empty


def test_format_score(spark):
    empty_values = {k: None for k in SHOT}
    full = {**SHOT, "subjects": [{f: "x" for f in T.SUBJECT_FIELDS}]}
    lists = [[json.dumps(full)], [json.dumps(empty_values)], [], [json.dumps({"index": 1})], [json.dumps(SHOT)]]
    got = _map(spark, R.format_score, lists, "array<string>")
    assert got == pytest.approx([1.0, 0.6, 0.0, 0.6 / 11, 0.9 + 0.1 * 5 / 6])


def test_pretty_map_and_messages(spark):
    df = spark.createDataFrame([({"0": 'a"b', "1": ""},)], "m map<string,string>")
    assert df.select(P.pretty_map(F.col("m"))).first()[0] == json.dumps({"0": 'a"b', "1": ""}, indent=2)
    m = spark.range(1).select(P.chat_messages(F.lit("s"), F.lit("u"), F.lit(None).cast("string")).alias("m")).first()["m"]
    assert [x["role"] for x in m] == ["system", "user"]


def test_few_texts_are_python_objects_at_once(monkeypatch):
    import pyarrow as pa
    held = []
    monkeypatch.setattr(J, "FEW", 3)
    many = pa.array([f"t{i}" if i % 4 else None for i in range(10)])
    got = J._few_at_a_time(many, lambda t: held.append(t) or t.upper(), pa.string())
    assert got.to_pylist() == [f"T{i}" if i % 4 else None for i in range(10)] and len(held) == 7
    assert J._few_at_a_time(many.slice(0, 0), str.upper, pa.string()).to_pylist() == []
