"""Chat formatting with Spark expressions only.

The turns of a conversation are collected and sorted; adjacent turns of one role become one
message by array functions; messages are concatenated with marks.  Control strings inside roles
and texts are escaped with a backslash, and so are backslashes, so that no text can forge a mark
and every text can be read back.

A formatted conversation is, per message, ``<|turn|>`` role ``<|text|>`` text (``<|next|>`` text)*
``<|end|>`` newline.  The loss mask is run-length coded: one entry (kind, chars, loss) for each
piece of the output in order.

Defined cases: null roles and texts are empty; null turns sort first, equal turns by role and
text; repeated rows are turns of their own; rows with a null conversation id form one conversation;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>\n"
# Control strings of common chat templates that texts must not contain unescaped.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_FORGED = r"<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=INST\]|/INST\])"
_MARKS = r"<\|turn\|>|<\|text\|>|<\|next\|>|<\|end\|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _FORGED, "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def _piece(kind: str, text: Column, loss: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"),
                    (F.lit(False) if loss is None else loss).alias("loss"))


def format_chats(turns: DataFrame, loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id``, ``messages`` (role, texts), ``formatted``, ``loss_mask``."""
    row = F.struct(F.col("turn").cast("bigint").alias("turn"),
                   F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), row.alias("_r"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("_r")).alias("_t"))
    opens = F.filter(F.sequence(F.lit(0), F.size("_t") - 1),
                     lambda i: (i == 0) | (F.get("_t", i)["role"] != F.get("_t", i - 1)["role"]))
    chats = chats.withColumn("_o", opens)

    def message(at: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("_o", k + 1), F.size("_t"))
        return F.struct(F.get("_t", at)["role"].alias("role"),
                        F.transform(F.slice("_t", at + 1, stop - at), lambda t: t["text"]).alias("texts"))

    chats = chats.withColumn("messages", F.transform("_o", message)).drop("_t", "_o")

    def pieces(m: Column) -> Column:
        loss = m["role"].isin(list(loss_roles))
        head = F.array(_piece("mark", F.lit(TURN)), _piece("role", escape(m["role"])))
        body = F.flatten(F.transform(m["texts"], lambda t, i: F.array(
            _piece("mark", F.when(i == 0, F.lit(TEXT)).otherwise(F.lit(NEXT))), _piece("text", escape(t), loss))))
        return F.concat(head, body, F.array(_piece("mark", F.lit(END))))

    chats = chats.withColumn("_p", F.flatten(F.transform("messages", pieces)))
    mask = F.transform("_p", lambda p: F.struct(p["kind"].alias("kind"), F.length(p["text"]).alias("chars"),
                                                p["loss"].alias("loss")))
    return chats.select("conv_id", "messages",
                        F.array_join(F.transform("_p", lambda p: p["text"]), "").alias("formatted"),
                        mask.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id``, ``turns`` (role, text) and ``loss_texts``, from ``formatted`` and ``loss_mask`` alone."""
    bodies = F.slice(F.split("formatted", r"<\|end\|>\n", -1), F.lit(1),
                     F.size(F.split("formatted", r"<\|end\|>\n", -1)) - 1)

    def turns_of(body: Column) -> Column:
        parts = F.split(body, r"<\|turn\|>|<\|text\|>|<\|next\|>", -1)
        return F.transform(F.slice(parts, F.lit(3), F.size(parts) - 2), lambda t: F.struct(
            unescape(F.get(parts, F.lit(1))).alias("role"), unescape(t).alias("text")))

    turns = F.flatten(F.transform(bodies, turns_of))
    # Two marks in a row enclose an empty piece; only the ends of a message have none between them.
    plain = F.split(F.replace("formatted", F.lit(END + TURN), F.lit(TURN)), _MARKS, -1)
    spans = F.filter("loss_mask", lambda m: m["kind"] != "mark")
    under = F.zip_with(F.slice(plain, F.lit(2), F.size(spans)), spans,
                       lambda t, m: F.struct(t.alias("text"), m["loss"].alias("loss")))
    kept = F.transform(F.filter(under, lambda u: u["loss"]), lambda u: unescape(u["text"]))
    return formatted.select("conv_id", turns.alias("turns"), kept.alias("loss_texts"),
                            F.length("formatted").cast("bigint").alias("formatted_chars"))
