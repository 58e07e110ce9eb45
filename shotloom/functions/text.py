"""Text functions as Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shotloom.functions.fixed_text import ACTION_WORDS, LENS_WORDS, PLOT_TITLE, TEMPORAL_WORDS

END_TOKEN = "<END>"
TOTALS = 32


def trim_all(c: Column) -> Column:
    """Strip all Unicode white space, not only blanks."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def trim_ends(c: Column) -> Column:
    """``trim_all`` for long texts: the pattern only runs over a text that begins or ends with white space."""
    return let(c, lambda t: F.when(F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1)).rlike(r"(?U)\s"), trim_all(t)).otherwise(t))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def running_totals(steps: Column, levels: int = 4) -> Column:
    """Running totals of an array of long numbers, each with its own number.

    A number is summed inside its block of TOTALS, the totals of the blocks in the same way, up to ``levels``:
    about ``levels`` * TOTALS / 2 additions a number, where a fold that appends would copy all it has at every step.
    """
    def total(x: Column, first: Column, last: Column) -> Column:
        return F.aggregate(F.sequence(first, last), F.lit(0).cast("bigint"), lambda acc, i: acc + F.get(x, i))

    def of(x: Column, level: int) -> Column:
        places = F.sequence(F.lit(0), F.size(x) - 1)
        first = (lambda i: i - i % TOTALS) if level else (lambda i: F.lit(0))
        own = F.transform(places, lambda i: total(x, first(i), i))
        if not level:
            return own
        blocks = F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(TOTALS)), lambda k: total(x, k, F.least(k + TOTALS, F.size(x)) - 1))
        below = lambda b: F.when(F.size(b) > 1, of(b, level - 1)).otherwise(b)
        return let(let(blocks, below), lambda up: F.transform(places, lambda i: total(x, first(i), i) + F.when(
            i >= TOTALS, F.get(up, F.floor(i / TOTALS).cast("int") - 1)).otherwise(F.lit(0).cast("bigint"))))

    return let(steps, lambda x: F.when(F.size(x) > 0, of(x, levels - 1)).otherwise(x))


def round_half_even(x: Column, digits: int) -> Column:
    """The decimal with ``digits`` places that lies nearest the binary value of ``x``; exact ties go to the even one.

    Only where ``x * 10**digits`` comes out as a half can the product hide on which side the true
    value lies; there the error of the product decides, found by splitting both factors.
    """
    scale = 10.0 ** digits
    big = 134217729.0 * scale
    scale_high = big - (big - scale)
    scale_low = scale - scale_high

    def rounded(v: Column) -> Column:
        product = v * scale
        high = v * 134217729.0 - (v * 134217729.0 - v)
        low = v - high
        error = ((high * scale_high - product) + high * scale_low + low * scale_high) + low * scale_low
        floor = F.floor(product).cast("double")
        half = product - floor == 0.5
        return F.when(half & (error > 0), floor + 1).when(half & (error < 0), floor).otherwise(F.rint(product)) / scale

    return let(x.cast("double"), rounded)


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def extract_section(c: Column, title: str) -> Column:
    """Text between ``【title】`` and the next section or the end."""
    return trim_all(F.regexp_extract(c, rf"(?s)【{title}】\n(.*?)(?=\n【|\z)", 1))


def plot_summary(c: Column, title: str = PLOT_TITLE) -> Column:
    """The plot section up to the next section after a blank line, else up to the first blank line, else to the end."""
    head = f"(?s)【{title}】\\n"
    strict = F.regexp_extract(c, head + r"(.*?)(?=\n\n【)", 1)
    loose = F.regexp_extract(c, head + r"(.*?)(?=\n\n|\z)", 1)
    return trim_all(F.when(c.rlike(head + r".*?\n\n【"), strict).otherwise(loose))


def strip_code_fence(c: Column) -> Column:
    def bare(t: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(t, r"^```[a-zA-Z0-9_+-]*\n?", ""), r"\n?```$", "")
        return F.when(t.startswith("```"), trim_all(inner)).otherwise(t)

    return let(trim_all(c), bare)


def strip_think(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<think>.*?</think>", "")


def unwrap_model_output(c: Column) -> Column:
    """Fence and end token removed; a quoted JSON string is decoded once."""
    def unquoted(t: Column) -> Column:
        boxed = F.concat(F.lit("{\"v\":"), t, F.lit("}"))
        is_string = F.coalesce(F.schema_of_variant(F.try_parse_json(boxed)) == "OBJECT<v: STRING>", F.lit(False))
        return F.when(~(t.startswith('"') & t.endswith('"')), t).when(
            is_string, trim_all(F.get_json_object(boxed, "$.v"))).otherwise(t)

    return let(trim_all(F.replace(strip_code_fence(c), F.lit(END_TOKEN), F.lit(""))), unquoted)


def decode_u_escapes(c: Column) -> Column:
    """``#U`` + 4 to 6 hex digits → that character; beyond U+10FFFF the text stays."""
    parts = F.split(F.regexp_replace(c, r"(#U[0-9a-fA-F]{4,6})", "\u0001$1\u0001"), "\u0001")

    def char(p: Column) -> Column:
        code = F.regexp_extract(p, r"^#U([0-9a-fA-F]{4,6})$", 1)
        valid = (code != "") & (F.lpad(code, 6, "0") <= "10FFFF") & (F.upper(F.lpad(code, 6, "0")) <= "10FFFF")
        return F.when(valid, F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")).otherwise(p)

    return F.array_join(F.transform(parts, char), "")


def sanitize_filename(c: Column, default: str = "character") -> Column:
    clean = F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "_"), r"^_+|_+$", "")
    return F.coalesce(blank_to_null(clean), F.lit(default))


def strip_control_lines(c: Column) -> Column:
    """Drop lines that state control conditions or upload order; at most one blank line in a row."""
    lines = F.filter(F.split(c, "\n"), lambda x: ~(trim_all(x).startswith("控制条件：") | trim_all(x).startswith("上传顺序说明：")))
    return F.regexp_replace(trim_all(F.array_join(lines, "\n")), r"\n{3,}", "\n\n")


def strip_dialogue(c: Column) -> Column:
    """Drop ``台词：…`` to the line end and tidy what it leaves."""
    t = F.regexp_replace(c, r"台词：[^\n]*", "")
    t = F.regexp_replace(t, r"(?U)\s+。", "。")
    t = F.regexp_replace(t, r"。。+", "。")
    return trim_all(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def sample_index(c: Column) -> Column:
    return F.regexp_extract(c, r"^sample_([0-9]+)", 1).try_cast("int")


def shot_index(c: Column) -> Column:
    return F.regexp_extract(c, r"^shot_([0-9]+)$", 1).try_cast("int")


def trailing_number(c: Column) -> Column:
    return F.regexp_extract(c, r"([0-9]+)$", 1).try_cast("int")


def last_number(c: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"([0-9]+)")), F.lit(-1)).try_cast("int")


def infer_split(paths: Column, splits: Sequence[str] = ("train", "val", "test")) -> Column:
    """The one split named by the stems of an array of paths, else ``unknown``."""
    def stem(p: Column) -> Column:
        return F.lower(F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"(.)\.[^.]*$", "$1"))

    def named(s: str) -> Column:
        return F.exists(paths, lambda p: (stem(p) == s) | stem(p).startswith(s + "_") | stem(p).endswith("_" + s))

    hits = F.array_compact(F.array(*[F.when(named(s), F.lit(s)) for s in splits]))
    return F.when(F.size(hits) == 1, hits[0]).otherwise("unknown")


def csv_list(c: Column, fallback: Sequence[str] = ()) -> Column:
    """Comma list → trimmed non-blank items; null or empty gives the fallback."""
    items = F.filter(F.transform(F.split(c, ","), trim_all), lambda x: x != "")
    empty = F.array(*[F.lit(f) for f in fallback]) if fallback else F.array().cast("array<string>")
    return F.when(c.isNull() | (F.size(items) == 0), empty).otherwise(items)


def task_id(folder: Column, stem: Column, sample: Column, shot: Column, serial: Column) -> Column:
    number = F.coalesce(shot.try_cast("int"), serial.cast("int"))
    return F.format_string("%s_%s_s%03d_k%03d", folder, stem, sample.cast("int"), number)


def rebase_path(c: Column, root: str, marker: str = "videos") -> Column:
    """Any separator style; from the ``videos`` folder on the path is put below ``root``, else it stays."""
    parts = F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/")
    at = F.array_position(F.transform(parts, F.lower), marker)
    return F.when(at > 0, F.concat_ws("/", F.lit(root), F.array_join(F.slice(parts, at.cast("int"), F.size(parts)), "/"))
                  ).otherwise(c)


def serialize_path(c: Column, mode: str, base: str) -> Column:
    """Absolute paths relative to ``base`` in relative mode; relative ones put below it in absolute mode."""
    absolute = c.startswith("/")
    if mode == "absolute":
        return F.when(absolute, c).otherwise(F.concat_ws("/", F.lit(base), c))
    root = [p for p in base.split("/") if p]
    parts = F.filter(F.split(c, "/"), lambda p: p != "")
    same = F.lit(0)
    for i in range(len(root), 0, -1):
        shared = F.slice(parts, 1, i) == F.array(*[F.lit(p) for p in root[:i]])
        same = F.when(shared & (same == 0), F.lit(i)).otherwise(same)
    ups = F.array_repeat(F.lit(".."), F.lit(len(root)) - same)
    rest = F.slice(parts, same + 1, F.size(parts))
    return F.when(absolute, F.array_join(F.concat(ups, rest), "/")).otherwise(c)


def fingerprint(*parts: tuple[str, Column]) -> Column:
    """First 16 hex digits of the sha1 of a JSON object with sorted keys."""
    ordered = sorted(parts, key=lambda p: p[0])
    return F.substring(F.sha1(F.to_json(F.struct(*[c.alias(n) for n, c in ordered]))), 1, 16)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def weak_label(c: Column) -> Column:
    """Logistic score of lens, action and timing words."""
    score = (F.regexp_count(c, F.lit(LENS_WORDS)) * 0.4 + F.regexp_count(c, F.lit(ACTION_WORDS)) * 0.4
             + F.regexp_count(c, F.lit(TEMPORAL_WORDS)) * 0.2).cast("double")
    return 1.0 / (1.0 + F.pow(F.lit(2.71828), -(score - 1.5)))


def signature(pairs: Sequence[tuple[str, Column]]) -> Column:
    return F.concat_ws("_", *[F.concat(F.lit(k), v.cast("string")) for k, v in pairs])


def parse_metrics(log: Column, marker: str = "Test Results", prefix: str = "test_") -> Column:
    """``k=v`` tokens of the lines that hold the marker → MAP<STRING, DOUBLE>; the last one of a key wins."""
    lines = F.filter(F.split(log, "\r?\n"), lambda x: x.contains(marker))
    tokens = F.flatten(F.transform(lines, lambda x: F.filter(F.split(x, r"(?U)\s+"), lambda t: t.contains("="))))
    pairs = F.transform(tokens, lambda t: F.struct(
        F.concat(F.lit(prefix), F.substring_index(t, "=", 1)).alias("k"),
        F.regexp_replace(t, r"^[^=]*=", "").try_cast("double").alias("v")))
    pairs = F.filter(pairs, lambda p: p["v"].isNotNull())
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def data_uri(path: Column, content: Column) -> Column:
    """``data:image/…;base64,…``; jpg is named jpeg."""
    ext = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    kind = F.when(ext == "jpg", "jpeg").otherwise(ext)
    return F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def duration_enum(c: Column, fallback: str = "5") -> Column:
    """floor(x + 0.5) limited to 1..16 as text; what is no number gives the fallback."""
    x = c.cast("string").try_cast("double")
    ok = x.isNotNull() & ~F.isnan(x)
    value = F.greatest(F.lit(1), F.least(F.lit(16), F.floor(F.when(ok, x) + 0.5)))
    return F.when(ok, value.cast("string")).otherwise(fallback)


def alpha_blend(alpha: Column, a: Column, b: Column) -> Column:
    return alpha * a + (1.0 - alpha) * b


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def linear_schedule(step: Column, total: Column, start: float, end: float) -> Column:
    progress = F.least(step / F.greatest(total, F.lit(1)), F.lit(1.0))
    return start + (end - start) * progress
