"""Maximal periodic runs of words by recompression, and texts without their repeats.

The words of many texts, each closed by a symbol of its own, are one sequence.  Recompression
makes a run-length grammar of it: block compression replaces every maximal stretch of one symbol,
pair compression splits the alphabet at random and replaces each left symbol that a right one
follows; the two alternate.  Equal stretches are parsed alike but for their ends, so the longest
common extension of two places climbs the levels while the symbols agree and descends to the
first word that differs, with a bounded number of steps a level.

A run of period p and length n repeats at least g = max(p, 12 - p) consecutive words at distance
p, so one of the places 0, g, 2g, ... of its text lies inside it.  Each such place and period
whose words agree is a candidate; its extension in both directions says whether it is a run.
Of two candidates with the same bounds the smaller period is the run's own.

Words are what white space of ASCII separates.  Work is n log n in the words of a text.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; rows with
a null or repeated id are answered row by row; a text of any length is worked on whole, alone in
its block of words; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.llm.word_arrays import mix

LEAST = 12
BLOCK = 1 << 17   # words worked on together
LANES = 1 << 19   # candidates tested together
FLOOR = 64        # a level this short is not compressed further
SCHEMA = "doc_id long, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_STEP = 0x9E3779B97F4A7C15


class Level(NamedTuple):
    sym: np.ndarray        # symbols
    size: np.ndarray       # words below each
    head: np.ndarray       # is it the first child of its parent
    up: np.ndarray         # index of its parent
    down: np.ndarray       # index of its first child; one more entry ends the last
    blocks: bool           # does the next level replace blocks, or pairs
    top: bool


def compress(words: np.ndarray) -> list[Level]:
    """The levels of the grammar of ``words``, numbers from 0."""
    none = np.zeros(0, np.int64)
    sym, size, down, levels, turn = words.astype(np.int64), np.ones(len(words), np.int64), none, [], 0
    names, still = int(words.max()) + 1 if len(words) else 0, 0
    while len(sym) > FLOOR and still < 8:
        blocks = turn % 2 == 0
        head = np.ones(len(sym), bool)
        if blocks:
            head[1:] = sym[1:] != sym[:-1]
        else:
            left = mix(sym.astype(np.uint64) + np.uint64(turn * _STEP % (1 << 64))) & np.uint64(1) == 0
            head[1:] = ~(left[:-1] & ~left[1:])
        turn += 1
        at = np.flatnonzero(head)
        if len(at) == len(sym):
            still += 1
            continue
        still = 0
        ends = np.append(at, len(sym))
        width = np.diff(ends)
        new, many = sym[at], np.flatnonzero(width > 1)
        key = (new[many] << 31) + (width[many] if blocks else sym[at[many] + 1])
        codes, found = pd.factorize(key)
        new[many] = codes + names
        names += len(found)
        levels.append(Level(sym, size, head, np.cumsum(head) - 1, down, blocks, False))
        sym, size, down = new, np.add.reduceat(size, at), ends
    return [*levels, Level(sym, size, np.ones(len(sym), bool), none, down, False, True)]


def mirrored(levels: list[Level]) -> list[Level]:
    """The same grammar read from right to left."""
    out = []
    for k, lv in enumerate(levels):
        below = len(levels[k - 1].sym) if k else 0
        above = 0 if lv.top else len(levels[k + 1].sym)
        out.append(Level(lv.sym[::-1], lv.size[::-1], np.append(lv.head[1:], True)[::-1], above - 1 - lv.up[::-1],
                         below - lv.down[::-1], lv.blocks, lv.top))
    return out


def extend(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from place ``a`` on equal those from place ``b`` on; the sequence must end in a symbol of its own."""
    out = np.zeros(len(a), np.int64)
    lane, parked = np.arange(len(a)), []

    def leave(mask):
        parked[-1].append((lane[mask], a[mask], b[mask]))
        return lane[~mask], a[~mask], b[~mask]

    for k, lv in enumerate(levels):
        parked.append([])
        if not len(lane):
            break
        lane, a, b = leave(lv.sym[a] != lv.sym[b])
        while len(lane):
            on = np.arange(len(lane)) if lv.top else np.flatnonzero(~(lv.head[a] & lv.head[b]))
            if not len(on):
                break
            x, y = a[on], b[on]
            if lv.blocks:
                ends = levels[k + 1].down
                go = np.minimum(ends[lv.up[x] + 1] - x, ends[lv.up[y] + 1] - y)
            else:
                go = 1
            out[lane[on]] += go * lv.size[x]
            a[on], b[on] = x + go, y + go
            differ = np.zeros(len(lane), bool)
            differ[on] = lv.sym[a[on]] != lv.sym[b[on]]
            lane, a, b = leave(differ)
        if not lv.top:
            a, b = lv.up[a], lv.up[b]
    lane = a = b = np.zeros(0, np.int64)
    for k in range(len(parked) - 1, 0, -1):
        lane, a, b = (np.concatenate(x) for x in zip((lane, a, b), *parked[k]))
        lv, below = levels[k], levels[k - 1]
        ends, x, y = lv.down, lv.down[a], lv.down[b]
        on = np.flatnonzero(below.sym[x] == below.sym[y])
        go = np.minimum(ends[a[on] + 1] - x[on], ends[b[on] + 1] - y[on]) if below.blocks else 1
        out[lane[on]] += go * below.size[x[on]]
        x[on] += go
        y[on] += go
        a, b = x, y
    return out


def candidates(seq: np.ndarray, first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, place and period of the grid places whose words agree, at most about LANES tested at a time."""
    text = np.repeat(np.arange(len(count)), count // 2)
    period = np.arange(len(text)) - np.repeat(np.cumsum(count // 2) - count // 2, count // 2) + 1
    fits = count[text] >= LEAST
    text, period = text[fits], period[fits]
    step = np.maximum(period, LEAST - period)
    places = (count[text] - period - 1) // step + 1
    stops = np.cumsum(places)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + LANES)))
        n = places[at:to]
        row = np.repeat(np.arange(at, to), n)
        i = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * step[row] + first[text[row]]
        p = period[row]
        same = seq[i] == seq[i + p]
        row, i, p = row[same], i[same], p[same]
        same = (seq[i + 1] == seq[i + 1 + p]) | (seq[i - 1] == seq[i - 1 + p])
        yield text[row[same]], i[same], p[same]
        at = to


def runs_of(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of every run of ``numbers``, word numbers per text, in order."""
    count = np.array([len(x) for x in numbers], np.int64)
    first = np.cumsum(count + 1) - count
    fresh = max([int(x.max()) + 1 for x in numbers if len(x)], default=0)
    seq = np.zeros(int(count.sum()) + len(count) + 1, np.int64)
    seq[0] = fresh
    for k, x in enumerate(numbers):
        seq[first[k]:first[k] + len(x)] = x
        seq[first[k] + len(x)] = fresh + k + 1
    ahead, n = None, len(seq)
    found = [np.zeros((4, 0), np.int64)]
    for text, i, p in candidates(seq, first, count):
        if not len(i):
            continue
        if ahead is None:
            ahead = compress(seq)
            back = mirrored(ahead)
        right = extend(ahead, i, i + p)
        left = extend(back, n - i, n - i - p)
        length = left + right + p
        good = length >= np.maximum(LEAST, 2 * p)
        found.append(np.stack([text, i - left - first[text], length, p])[:, good])
    text, start, length, p = np.concatenate(found, axis=1)
    order = np.lexsort((p, length, start, text))
    text, start, length, p = text[order], start[order], length[order], p[order]
    new = np.ones(len(text), bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(start) != 0) | (np.diff(length) != 0)
    text, start, length, p = text[new], start[new], length[new], p[new]
    order = np.lexsort((p, start, text))
    return text[order], start[order], length[order], p[order]


def _blocks(texts: list[bytes]) -> Iterator[list[list[bytes]]]:
    """Word lists of consecutive texts, at most BLOCK words together unless one text has more."""
    held, size = [], 0
    for text in texts:
        words = (text or b"").split()
        if held and size + len(words) > BLOCK:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def _answer(block: list[list[bytes]]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Word counts, runs and collapsed texts."""
    flat = [w for words in block for w in words]
    count = np.array([len(words) for words in block], np.int64)
    at = np.cumsum(count) - count
    codes = pd.factorize(np.array(flat, dtype=object))[0] if flat else np.zeros(0, np.int64)
    text, start, length, period = runs_of([codes[f:f + n] for f, n in zip(at, count)])
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, at[text] + start + period, 1)
    np.add.at(edge, at[text] + start + length, -1)
    drop = np.cumsum(edge[:-1]) > 0
    some = np.zeros(len(block), bool)
    some[text] = True
    kept = [b" ".join([flat[k] for k in f + np.flatnonzero(~drop[f:f + n])] if z else flat[f:f + n])
            for f, n, z in zip(at, count, some)]
    runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
    ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(block))))).astype(np.int32)
    return pa.array(count), pa.ListArray.from_arrays(pa.array(ends), runs), pa.array(kept, pa.binary()).cast(pa.string())


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for block in _blocks(batch.column("text").to_pylist()):
            ids = batch.column("doc_id").slice(at, len(block))
            at += len(block)
            yield pa.RecordBatch.from_arrays([ids, *_answer(block)], ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    A run is a stretch of at least 12 words and two periods that no neighbouring word extends;
    ``collapsed`` holds the words that no run repeats, joined by one space.  No shuffle.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("text"))
    return rows.mapInArrow(_run, SCHEMA)
