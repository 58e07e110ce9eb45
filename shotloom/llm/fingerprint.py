"""Document fingerprints: quartile codes of hashed byte triplets, compared by a bounded score.

Five byte triplets per place, drawn from a window of twelve bytes, are hashed into buckets.  A
bucket's code is the number of count quartiles it lies above; a digest is a code for the length
followed by the codes of all buckets, in hexadecimal.  Two digests differ by the sum of their
code differences (a difference of three counts six) and of a bounded length difference; likeness
is 1 for equal digests and never below 0.

Neighbours in descending id order are found without a global window: documents are dealt by id
ranges, each task walks its sorted rows, and only the last row of a task meets the first row of
the next task in a join.

Defined cases: null texts are empty and have the digest of zero counts; null ids come last; equal
ids are ordered by a hash of their text; repeated rows are rows of their own; a single document is
its own neighbour; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotloom.llm.common import keyed
from shotloom.session import stage

BUCKETS = 1024
# Byte places of the triplets, relative to the first byte.
TRIPLETS = ((0, 3, 6), (0, 4, 7), (0, 5, 9), (0, 2, 8), (0, 6, 11))
SPAN = 1 << 20
_STEPS = np.array([0, 1, 2, 6], np.int64)


def _counts(data: np.ndarray, buckets: int) -> np.ndarray:
    total = np.zeros(buckets, np.int64)
    reach = max(k for t in TRIPLETS for k in t)
    for at in range(0, max(len(data) - 2, 0), SPAN):  # a very long text is counted span by span
        part = data[at:at + SPAN + reach].astype(np.uint32)
        for salt, (i, j, k) in enumerate(TRIPLETS):
            n = min(len(part) - k, SPAN)
            if n > 0:
                x = part[i:i + n] | part[j:j + n] << 8 | part[k:k + n] << 16 | np.uint32((salt + 1) << 24)
                x = (x ^ x >> 16) * np.uint32(0x7FEB352D)
                x = (x ^ x >> 15) * np.uint32(0x846CA68B)
                total += np.bincount((x ^ x >> 16) % np.uint32(buckets), minlength=buckets)
    return total


def digest(text: str, buckets: int = BUCKETS) -> bytes:
    """One byte for the length, then four bucket codes a byte."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = _counts(data, buckets)
    codes = (counts[:, None] > np.percentile(counts, (25, 50, 75))).sum(axis=1).reshape(-1, 4)
    body = (codes << np.array([6, 4, 2, 0])).sum(axis=1).astype(np.uint8)
    length = min(int(np.log(len(data) + 1) / np.log(1.1)), 255)
    return bytes([length]) + body.tobytes()


def likeness(left: bytes, right: bytes) -> float:
    x, y = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    shifts = np.array([6, 4, 2, 0], np.uint8)
    steps = np.abs((x[1:, None] >> shifts & 3).astype(np.int64) - (y[1:, None] >> shifts & 3))
    apart = _STEPS[steps].sum() + min(abs(int(x[0]) - int(y[0])), 16) * steps.size / 256
    return float(max(0.0, 1.0 - apart / (2.0 * steps.size)))


def likeness_of(left: Column, right: Column) -> Column:
    """Likeness of two columns of hexadecimal digests."""
    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness(bytes.fromhex(a), bytes.fromhex(b)) for a, b in zip(x, y)], dtype="float64")
    return of(left, right)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the ``fingerprint`` of each text."""
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(t).hex() for t in texts], dtype="object")
    return keyed(docs, id_col, text_col).select("doc_id", of("text").alias("fingerprint"))


# Digests stay bytes, half the size of their hexadecimal form, until the result.
_RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
           "near_edited double, near_next double")
_FIELDS = [f.split()[0] for f in _RESULT.split(", ")]


def _compared(doc_id, text: str, own: bytes, after: str, after_own: bytes) -> tuple:
    half = len(text) // 2
    edited = text[:len(text) - half] + after[:half]
    changed = digest(edited)
    return (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own,
            changed, likeness(own, changed), likeness(own, after_own))


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compare each row with the next one of its task; the first and last row also leave their text."""
    columns = [*_FIELDS, "part", "edge", "text"]
    part, last = TaskContext.get().partitionId(), None
    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"]):
            doc_id, own = (None if pd.isna(doc_id) else int(doc_id)), digest(text)
            if last is None:
                rows.append((doc_id, len(text), None, None, None, None, None, part, "first", text))
            else:
                rows.append((*_compared(*last, text, own), part, None, None))
            last = (doc_id, text, own)
        yield _frame(rows, columns)
    if last is not None:
        yield _frame([(last[0], len(last[1]), None, None, None, None, None, part, "last", last[1])], columns)


def _join_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield _frame([_compared(None if pd.isna(d) else int(d), t, digest(t), a, digest(a))
                      for d, t, a in zip(pdf["doc_id"].astype("Int64"), pdf["text"], pdf["after"])], _FIELDS)


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of each text and of its edited text (last half from the next document), and how alike they are.

    Each text is shuffled once, by id range.  The digests are written, so that the rows at the
    edges of the tasks, two per task, are joined from there and no text is digested again.
    """
    base = keyed(docs, id_col, text_col)
    ranged = (base.repartitionByRange(F.col("_d").desc(), F.col("_t")).sortWithinPartitions(F.col("_d").desc(), "_t")
              .select("doc_id", "text"))
    walked = stage(ranged.mapInPandas(_walk, f"{_RESULT}, part int, edge string, text string"))
    firsts = walked.filter("edge = 'first'").select(F.col("part").alias("to"), F.col("text").alias("after"))
    parts = walked.filter("edge = 'first'").select("part")
    order = Window.orderBy("part")  # one number per task
    following = parts.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("to"))
    lasts = walked.filter("edge = 'last'").select("part", "doc_id", "text")
    edges = lasts.join(following, "part").join(firsts, "to").select("doc_id", "text", "after")
    both = walked.filter("edge is null").select(*_FIELDS).unionByName(edges.mapInPandas(_join_edges, _RESULT))
    return both.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
