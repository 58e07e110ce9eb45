"""Benchmark decontamination by template windows and slot consistency.

Numbers, names and units become typed placeholders, so that a question with other parameters has
the template of the original.  Windows of five template words of the documents are hash-joined
with those of the benchmark.  Matches of one document and item that lie on one diagonal are an
occurrence; it counts if every slot value of the item stands for one value throughout.  A document
is contaminated by an item if consistent occurrences cover at least half of the item's windows.
A capitalised word that opens a sentence may be a name or not: its windows count with the word
itself, and where that isn't enough also with a placeholder.  Last, windows of five plain words
count, in any case of letters: they find verbatim copies of what has no template, such as numbers.

A bitmap of the benchmark's window hashes goes to the tasks, at most 2 MB, and keeps windows that
can't match from the shuffle; a larger benchmark only lets more of them through.

Defined cases: null texts and items are empty and match nothing; an item of fewer than five words
is one window of all its words; template windows with fewer than two ordinary words say too little
and count only as plain words, so items without any other are found verbatim only; null and repeated ids are allowed, repeated rows and
items with one id and text count once; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.llm.common import keyed
from shotloom.llm.word_arrays import hash_words, windows
from shotloom.session import stage

WIDTH, COVERAGE, LITERALS = 5, 0.5, 2
# Words that are units where a number stands before them.
UNITS = ("mm cm m km inch inches foot feet yard yards mile miles g kg mg gram grams kilogram kilograms ton tons lb lbs oz "
         "pound pounds l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours "
         "day days week weeks month months year years mph kmh degree degrees percent dollar dollars euro euros cent cents "
         "meter meters metre metres kilometer kilometers kilometre kilometres").split()
_U = np.uint64
NUMBER, NAME, UNIT = _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3)
PLAIN = 16  # added to the size of a window of plain words
_WINDOWS = "pos long, key long, size int, mode int, slots array<string>"


def _templates(texts: Sequence[str]):
    """Template hash, text index, and slot words of each template word; a run of numbers is one."""
    words = hash_words(texts, kinds=True)
    n = len(words.hashes)
    same = np.zeros(n, bool)
    same[1:] = words.doc[1:] == words.doc[:-1]
    after = np.zeros(n, bool)
    after[1:] = words.number[:-1] & same[1:]
    unit = after & ~words.number & np.isin(words.hashes, hash_words(["\n".join(UNITS)]).hashes)
    key = words.hashes.copy()
    key[words.name], key[unit], key[words.number] = NAME, UNIT, NUMBER
    kept = np.flatnonzero(~(words.number & after))
    slot = (words.name | unit | words.number)[kept]
    stops = np.append(kept[1:], n)
    return words, key[kept], words.doc[kept], slot, (words.opener & ~unit)[kept], kept, stops


def _window_rows(texts: Sequence[str], sizes: Sequence[int], bitmap: np.ndarray | None, whole: bool):
    """(text index, position, key, size, mode, slot values) of the windows that may match; ``whole``: items.

    Mode 0 takes words that open a sentence as they are, 1 as names, and 2 takes all words as they are.
    """
    words, key, doc, slot, opener, kept, stops = _templates(texts)
    opened, either = key.copy(), slot | opener
    opened[opener] = NAME
    none = np.zeros(len(words.hashes), bool)
    modes = ((0, key, doc, slot), (1, opened, doc, either), (2, words.hashes, words.doc, none))
    for mode, keys, owner, slots in modes:
        count = np.bincount(owner, minlength=len(texts))
        first = np.cumsum(count) - count
        literal = np.concatenate(([0], np.cumsum(~slots)))
        openers = np.concatenate(([0], np.cumsum(opener)))
        for named in sizes:
            size = named % PLAIN
            if (mode == 2) != (named > PLAIN):
                continue
            hashes, at = windows(keys, owner, size)
            hashes = hashes ^ _U(named * 0x5851F42D4C957F2D % (1 << 64))
            keep = np.ones(len(at), bool) if mode == 2 else literal[at + size] - literal[at] >= LITERALS
            if mode == 1:
                keep &= openers[at + size] > openers[at]
            if whole and size < WIDTH:
                keep &= count[owner[at]] == size
            if bitmap is not None:
                place = hashes & _U(len(bitmap) * 64 - 1)
                keep &= (bitmap[(place >> _U(6)).astype(np.int64)] >> (place & _U(63)) & _U(1)) == 1
            for h, i in zip(hashes[keep].view(np.int64), at[keep]):
                found = [i + k for k in range(size) if slots[i + k]]
                yield (int(owner[i]), int(i - first[owner[i]]), int(h), named, mode,
                       ["/".join(words.value(w) for w in range(kept[k], stops[k])
                                 if words.number[w] or w == kept[k]).lower() for k in found])


def _runner(sizes: Sequence[int], bitmap: np.ndarray | None, whole: bool, carried: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at:at + 1024]
                rows = list(_window_rows(part["text"].tolist(), sizes, bitmap, whole))
                index = [r[0] for r in rows]
                out = {c: part[c].iloc[index].array for c in carried}
                yield pd.DataFrame(out | {"pos": [r[1] for r in rows], "key": [r[2] for r in rows],
                                          "size": [r[3] for r in rows], "mode": [r[4] for r in rows],
                                          "slots": pd.Series([r[5] for r in rows], dtype="object")})
    return run


def _bitmap(keys: DataFrame, rows: int) -> np.ndarray:
    """About 32 bits per key, at most 2**24 bits: one row per 64 of them reaches the driver."""
    bits = 1 << min(24, max(16, (32 * rows).bit_length()))
    place = F.col("key").bitwiseAND(bits - 1)
    words = (keys.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(63).cast("int").alias("bit"))
             .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")).collect())
    out = np.zeros(bits // 64, np.int64)
    for row in words:
        out[row["word"]] = row["mask"]
    return out.view(_U)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, id_col: str = "doc_id",
                 text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that it contains: ``doc_id``, ``item_id``, ``windows`` matched, ``coverage``,
    ``verbatim`` (all slots hold the item's own values), and the document's keys ``_d``, ``_t``.
    """
    items = keyed(benchmark, item_id_col, item_text_col).select(F.col("_d").alias("item_id"), "text").distinct()
    known = stage(items.mapInPandas(_runner([k + plain for plain in (0, PLAIN) for k in range(1, WIDTH + 1)], None, True, ["item_id"]), f"item_id long, {_WINDOWS}")
                  .select("item_id", F.col("pos").alias("item_pos"), "key", "size", F.col("mode").alias("item_mode"), F.col("slots").alias("item_slots")))
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # 1 to WIDTH, and PLAIN more
    bitmap = _bitmap(known.select("key"), known.count())
    base = keyed(docs, id_col, text_col)
    hits = base.select("doc_id", "_d", "_t", "text").mapInPandas(
        _runner(sizes, bitmap, False, ["doc_id", "_d", "_t"]), f"doc_id long, _d long, _t long, {_WINDOWS}")
    pairs = hits.join(known.drop("size"), "key").select(
        "doc_id", "_d", "_t", "item_id", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"),
        F.greatest("mode", "item_mode").alias("mode"), F.arrays_zip(F.col("item_slots").alias("was"), F.col("slots").alias("now")).alias("swap"))
    # Distinct first: a passage repeated in a document, or a repeated row, adds nothing.
    spot = ["_d", "_t", "item_id", "shift"]
    modes = {"base": F.col("mode") == 0, "open": F.col("mode") <= 1, "plain": F.col("mode") == 2}
    found = pairs.groupBy(*spot).agg(F.first("doc_id").alias("doc_id"), *[c for m, own in modes.items() for c in (
        F.collect_set(F.when(own, F.col("item_pos"))).alias(f"{m}_places"),
        F.array_distinct(F.flatten(F.collect_set(F.when(own, F.col("swap"))))).alias(f"{m}_swaps"))])

    def consistent(m: str, value):
        values = F.size(F.array_distinct(F.transform(f"{m}_swaps", lambda s: s["was"])))
        return F.when(values == F.size(f"{m}_swaps"), value)

    against = F.max(consistent("base", F.lit(True)).isNull())
    covered = found.groupBy("_d", "_t", "item_id").agg(F.first("doc_id").alias("doc_id"), against.alias("against"), *[c for m in modes for c in (
        F.size(F.array_distinct(F.flatten(F.collect_list(consistent(m, F.col(f"{m}_places")))))).alias(f"{m}_n"),
        (~F.coalesce(F.max(consistent(m, F.exists(f"{m}_swaps", lambda s: s["was"] != s["now"]))), F.lit(False)))
        .alias(f"{m}_verbatim"))])
    totals = known.groupBy("item_id").agg(F.countDistinct(F.when(F.col("item_mode") < 2, F.col("item_pos"))).alias("total"),
                                          F.countDistinct(F.when(F.col("item_mode") == 2, F.col("item_pos"))).alias("plain_total"))
    # Half of the plain words say nothing where slot values contradict each other; all of them do.
    least = {"plain": F.when(F.col("against"), F.lit(1.0)).otherwise(coverage)}
    best = F.coalesce(*[F.when(share >= least.get(m, F.lit(coverage)), F.struct(
        F.col(f"{m}_n").cast("bigint").alias("windows"), share.alias("coverage"), F.col(f"{m}_verbatim").alias("verbatim")))
        for m in modes for share in [F.try_divide(f"{m}_n", "plain_total" if m == "plain" else "total")]])
    return covered.join(totals, "item_id").withColumn("best", best).filter("best is not null").select(
        "doc_id", "item_id", "best.*", "_d", "_t")
