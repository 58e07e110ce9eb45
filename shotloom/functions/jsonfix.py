"""Tolerant reading of JSON that a model wrote.

Clean text stays in Spark expressions.  Only a text that fails to parse whole is handed to
a vectorised Python helper; the others pass it as null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotloom.functions.fixed_text import SHOT_FIELDS, SUBJECT_FIELDS
from shotloom.functions.text import END_TOKEN, let, strip_think, trim_all, trim_ends, unwrap_model_output

RAW_SHOT = "struct<" + ",".join(f"{f}:string" for f in SHOT_FIELDS) + ",description_visual:string,description:string>"
RAW_SUBJECT = "struct<" + ",".join(f"{f}:string" for f in SUBJECT_FIELDS) + ">"
# Python functions are declared nondeterministic so that the optimizer never copies a call into
# a filter or merges it into several expressions.
_TOKENS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},]', re.S)
FEW = 64
_BRACKETS = re.compile(r'\\*"|[\[\]{}]')


STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _sealed(c: Column, kind: str, opening: str, closing: str) -> tuple[Column, Column]:
    """The values of a list that holds ``c`` and a hash of ``c``, and that hash.

    Spark's parser ignores what follows a value.  So a text is parsed once, in a list that its own hash
    ends: only one whole value can stand before that.
    """
    seal = F.hex(F.xxhash64(c))
    whole = F.concat(F.lit("["), c, F.lit(f',{opening}"'), seal, F.lit(f'"{closing}]'))
    return F.from_json(whole, kind, STRICT), seal


def json_strict(c: Column) -> Column:
    """True for text that is exactly one JSON value.  No lambda: the argument of a Python function may hold it."""
    values, seal = _sealed(c, "array<string>", "", "")
    return F.coalesce((F.size(values) == 2) & (F.get(values, F.lit(1)) == seal), F.lit(False))


def json_elements(c: Column) -> Column:
    """Raw texts of the elements of a text that is exactly one JSON array, else null."""
    def read(t: Column) -> Column:
        values, seal = _sealed(t, "array<array<string>>", "[", "]")
        return let(values, lambda v: F.when((F.size(v) == 2) & (F.get(F.get(v, F.lit(1)), F.lit(0)) == seal), v[0]))

    return let(c, read)


def json_fields(c: Column) -> Column:
    """MAP of the fields of an object text in their order: texts as they are, other values as JSON text; else null."""
    return F.from_json(c, "map<string,string>")


def is_text(c: Column, field: Column) -> Column:
    """Is the field of an object text a JSON string; for the few values whose text looks like another kind."""
    value = F.try_element_at(F.try_parse_json(c).try_cast("map<string,variant>"), field)
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def json_extract_array(c: Column) -> Column:
    """Text of the JSON array in a model output: the whole text, or its first ``[`` to its last ``]``; else null."""
    def array(x: Column) -> Column:
        return F.when(x.startswith("[") & json_strict(x), x)

    def found(whole: Column) -> Column:
        return F.coalesce(array(whole), let(F.regexp_extract(whole, r"(?s)\[.*\]", 0), array))

    return let(unwrap_model_output(c), found)


def objects_in(values: Column) -> Column:
    return F.filter(values, lambda x: F.ltrim(x).startswith("{"))


def array_items(c: Column) -> Column:
    """Raw text of the objects in a JSON array text."""
    return objects_in(F.from_json(c, "array<string>"))


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def _elements(text: str) -> Iterator[str | None]:
    """Text pieces of the first array, in one pass over its brackets; None where the array closes.

    An object ends at its own brace, any other element at a comma or at the closing bracket.
    """
    depth, begin = 0, 0
    for token in _TOKENS.finditer(text, max(text.find("["), 0)):
        mark = token.group()
        if mark in ("[", "{"):
            depth += 1
            begin = token.end() if depth == 1 else begin
        elif mark in ("]", "}"):
            depth -= 1
            if depth == 0:
                yield text[begin:token.start()]
                yield None
                return
            if depth == 1 and mark == "}":
                yield text[begin:token.end()]
                begin = token.end()
        elif mark == "," and depth == 1:
            yield text[begin:token.start()]
            begin = token.end()


def _leading_objects(text: str) -> tuple[list[str], bool]:
    """Objects at the head of the first array, and whether the array broke off after them."""
    found: list[str] = []
    for piece in _elements(text):
        if piece is None:
            return found, False
        piece = piece.strip()
        if piece and not _is_json(piece):
            break
        if piece.startswith("{"):
            found.append(piece)
    return found, bool(found)


def _few_at_a_time(texts: pa.Array, fn: Callable, kind: pa.DataType) -> pa.Array:
    """``fn`` of every text that is not null.

    A batch holds thousands of whole texts; only ``FEW`` of them and their results are Python objects at once.
    """
    parts = [pa.array([None if t is None else fn(t) for t in texts.slice(s, FEW).to_pylist()], kind)
             for s in range(0, len(texts), FEW)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


_SALVAGED = pa.struct([("items", pa.list_(pa.string())), ("repaired", pa.bool_())])


@F.arrow_udf(T.StructType([T.StructField("items", T.ArrayType(T.StringType())), T.StructField("repaired", T.BooleanType())]))
def _salvage(texts: pa.Array) -> pa.Array:
    return _few_at_a_time(texts, lambda t: dict(zip(("items", "repaired"), _leading_objects(t))), _SALVAGED)


def _clean_items(c: Column) -> Column:
    """STRUCT<items, rest>: the objects of a text that parses whole, or the text that does not."""
    text = trim_ends(F.replace(F.when(c.contains("<think>"), strip_think(c)).otherwise(c), F.lit(END_TOKEN), F.lit("")))
    return let(text, lambda t: let(F.when(t.startswith("["), json_elements(t)), lambda items: F.struct(
        objects_in(items).alias("items"), F.when(items.isNull(), t).alias("rest"))))


_salvage = _salvage.asNondeterministic()


def with_repaired_items(df: DataFrame, column: str) -> DataFrame:
    """Add ``items`` ARRAY<STRING>, the complete leading objects of a storyboard text, and ``repaired``.

    A text that parses whole gives its objects and is not repaired; one that breaks off gives
    the objects before the break and is.
    """
    parsed = df.withColumn("_clean", _clean_items(F.col(column))).withColumn("_rest", _salvage("_clean.rest"))
    return (parsed.withColumn("items", F.coalesce("_clean.items", "_rest.items"))
            .withColumn("repaired", F.coalesce("_rest.repaired", F.lit(False))).drop("_clean", "_rest"))


def explode_items(df: DataFrame) -> DataFrame:
    """One row per item with ``pos`` and ``item``; a plain explode would parse the texts again to filter empty lists."""
    rest = [c for c in df.columns if c != "items"]
    return df.select(*rest, F.posexplode_outer("items").alias("pos", "item")).filter(F.col("pos").isNotNull())


def _opening_of(marks: list[tuple[int, str]], stop: int) -> int:
    """Place of the bracket that the one at ``stop`` closes, walking back; -1 if there is none."""
    depth, quoted = 0, False
    for place, mark in reversed(marks):
        if place > stop:
            continue
        if mark.endswith('"'):
            quoted ^= len(mark) % 2 == 1  # an even number of backslashes leaves the quote bare
        elif not quoted:
            depth += 1 if mark in "]}" else -1
            if depth == 0:
                return place
    return -1


def _last_value(text: str, openings: str) -> str | None:
    """The value that the last closing bracket of the first possible kind ends; a value has one opening bracket."""
    marks = [(m.start(), m.group()) for m in _BRACKETS.finditer(text)]
    for opening in openings:
        stop = text.rfind({"[": "]", "{": "}"}[opening])
        start = _opening_of(marks, stop) if stop >= 0 else -1
        if start >= 0 and text[start] == opening and _is_json(text[start:stop + 1]):
            return text[start:stop + 1]
    return None


def json_recover_last(c: Column, openings: str = "[{") -> Column:
    """JSON value text: the text without its fence if it parses, else the last parsable bracket; else null."""
    bare = trim_all(F.rtrim(trim_all(F.regexp_replace(trim_all(c), r"(?m)^```[^\n]*\n?", "")), F.lit("`")))
    whole = json_strict(bare)

    @F.arrow_udf("string")
    def recover(texts: pa.Array) -> pa.Array:
        return _few_at_a_time(texts, lambda t: _last_value(t, openings), pa.string())

    return F.when(whole, bare).otherwise(recover.asNondeterministic()(F.when(~whole, c)))


def subject_texts(raw: Column, wrap_object: bool) -> Column:
    """Object texts in the raw JSON of ``subjects``; what is no object in it is left out."""
    none = F.array().cast("array<string>")
    return (F.when(raw.startswith("["), F.coalesce(array_items(raw), none))
            .when(raw.startswith("{"), F.array(raw) if wrap_object else none).otherwise(none))


def normalize_shot(item: Column, wrap_object: bool = False) -> Column:
    """Raw object text → STRUCT with the eleven fields; a duration that is no number is null."""
    def fields(raw: Column) -> Column:
        value = {f: raw[f] for f in SHOT_FIELDS}
        value["subjects"] = F.transform(subject_texts(raw["subjects"], wrap_object), lambda x: F.from_json(x, RAW_SUBJECT))
        value["duration"] = raw["duration"].try_cast("double")
        return F.struct(*[v.alias(f) for f, v in value.items()], raw["description_visual"].alias("description_visual"))

    return let(F.from_json(item, RAW_SHOT), fields)


# Inside a JSON text no control character can stand as it is, so two of them can hold the place of escapes.
_ESCAPES = (("\\\\", "\x01"), ("\\\"", "\x02"))
_TOKEN = r'"[^"]*"(?:\s*:)?|[^\s\[\]{},:"]+'


def nested_text(raw: Column) -> Column:
    """Leaf texts of an object or array text of any depth in their order, joined by ``，``; blank ones are left out.

    Joining level by level gives the same text as joining all leaves, so the levels need not be
    followed: the values are what stands between brackets, commas and colons.
    """
    masked = raw
    for text, mark in _ESCAPES:
        masked = F.replace(masked, F.lit(text), F.lit(mark))
    values = F.filter(F.regexp_extract_all(masked, F.lit(_TOKEN), F.lit(0)), lambda x: ~x.endswith(":"))
    named = F.transform(values, lambda x: F.when(x == "true", '"True"').when(x == "false", '"False"').otherwise(x))
    listed = F.concat(F.lit("["), F.array_join(named, ","), F.lit("]"))
    for text, mark in reversed(_ESCAPES):
        listed = F.replace(listed, F.lit(mark), F.lit(text))
    leaves = F.transform(F.from_json(listed, "array<string>"), lambda x: trim_all(x))
    return F.array_join(F.filter(leaves, lambda x: x != ""), "，")


def safe_text(raw: Column, text: Column | None = None) -> Column:
    """Text of a leaf: strings trimmed, numbers and booleans as text, objects and arrays as their leaves joined by ``，``.

    ``text`` says whether a value that looks like an object, array or boolean is a string all the same; it
    is only looked at then.  Without it such a value counts as what it looks like, if it parses.
    """
    def of(t: Column) -> Column:
        odd = t.startswith("{") | t.startswith("[") | t.isin("true", "false")
        string = F.lit(False) if text is None else text
        plain = F.when(string, trim_ends(t)).when(t.isin("true", "false"), F.initcap(t))
        nested = F.when(json_strict(t), nested_text(t)).otherwise(trim_ends(t)) if text is None else nested_text(t)
        return F.when(t.isNull(), "").when(odd, F.coalesce(plain, nested)).otherwise(trim_ends(t))

    return let(raw if text is not None else trim_ends(raw), of)


def safe_fields(item: Column, raw: Column, fields: Sequence[str], *more: Column) -> Column:
    """STRUCT of ``fields`` of an object text and its ``json_fields`` as safe texts, and ``more`` columns.

    The fields go through one expression as an array: a copy of it per field would cost the
    optimizer more time than the data.
    """
    names = F.array(*[F.lit(f) for f in fields])
    texts = F.transform(names, lambda f: safe_text(F.try_element_at(raw, f), is_text(item, f)))
    return let(texts, lambda t: F.struct(*[t[i].alias(f) for i, f in enumerate(fields)], *more))


def safe_shot(item: Column, raw: Column | None = None, fields: Sequence[str] = SHOT_FIELDS) -> Column:
    """Raw object text → STRUCT whose texts went through ``safe_text``; a lone subject object counts as one subject.

    ``raw`` are its ``json_fields`` where the caller has them; ``fields`` limits what is made.
    """
    plain = [f for f in fields if f != "subjects"]

    def of(raw: Column) -> Column:
        subjects = F.transform(subject_texts(raw["subjects"], True), lambda s: let(
            json_fields(s), lambda m: safe_fields(s, m, SUBJECT_FIELDS)))
        return safe_fields(item, raw, plain, *([subjects.alias("subjects")] if "subjects" in fields else []))

    return of(raw) if raw is not None else let(json_fields(item), of)


def first_result_url(raw: Column) -> Column:
    """First non-empty ``url`` in the ``results`` list of a response; else null."""
    urls = F.from_json(F.get_json_object(raw, "$.results"), "array<struct<url:string>>")["url"]
    return F.try_element_at(F.filter(urls, lambda u: F.coalesce(u, F.lit("")) != ""), F.lit(1))
