"""Best-fit packing of tokenised documents into sequences of a fixed size.

Each task tokenises its documents and packs them online: a fixed number of open bins is kept in a
bitset keyed by free space, a piece goes to the open bin that it fills best, and when a new bin is
needed beyond that number the fullest one closes first.  Pieces are held back in blocks and placed
longest first, which fills bins better and keeps memory bounded.  Nothing is shuffled, so the work
grows with the data and a lost task is simply run again.

Defined cases: null texts are empty and hold only the end id; null and repeated ids are allowed,
each row is packed; a text of any length and any run of one character is tokenised whole; a document of over ``size`` tokens is cut into pieces of ``size``, the first
may be shorter; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shotloom.llm.common import keyed

SIZE, OPEN, BLOCK, END_ID = 1024, 4096, 4096, 2
MODEL, VOCABULARY = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"  # the second holds the ranks of the first
SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


class OpenBins:
    """Bounded-space best fit: ``place`` gives the bin number and the place in it."""

    def __init__(self, size: int = SIZE, most: int = OPEN):
        self.size, self.most = size, most
        self.mask, self.count, self.opened = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        found = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask &= ~(1 << free)
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            if self.count >= self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)  # least free space: the fullest closes
            free, found = self.size, self.opened
            self.opened += 1
        rest = free - length
        if rest:
            self.by_free[rest].append(found)
            self.mask |= 1 << rest
            self.count += 1
        return found, self.size - free


def encoder(path: str, model: str | None = None):
    """Function from text to its ids as little-endian unsigned 32-bit numbers; special strings are plain text.

    ``path`` is a file of token ranks.  Its pattern engine gives up on a text with about a million white
    space characters in a row; ``model``, the ``tokenizers`` file of the same vocabulary, encodes such a text.
    """
    import tiktoken
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = []

    def encode(text: str) -> np.ndarray:
        try:
            return coder.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        except ValueError:
            if not slow:
                slow.append(tokenizers.Tokenizer.from_file(model or public_tokenizers.path(MODEL)))
                slow[0].encode_special_tokens = True  # special strings are plain text here as well
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, "<u4")

    return encode


def pack_documents(docs: DataFrame, size: int = SIZE, open_bins: int = OPEN, block: int = BLOCK,
                   end_id: int = END_ID, vocabulary: str | None = None, model: str | None = None, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per piece: its ids (little-endian unsigned 32-bit) and its place in a sequence.

    ``vocabulary`` is a file of token ranks and ``model`` its ``tokenizers`` file; every executor has both.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, bins = encoder(path, model), OpenBins(size, open_bins)
        first_id = TaskContext.get().partitionId() << 40
        full, held = [], []

        def placed(rows: list[tuple]) -> pd.DataFrame:
            out = []
            for doc_id, piece, start, ids in rows:
                number, offset = bins.place(len(ids))
                out.append((doc_id, piece, start, len(ids), ids.tobytes(), first_id + number, offset))
            frame = pd.DataFrame(out, columns=[f.split()[0] for f in SCHEMA.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            return frame

        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"]):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                ids = np.append(encode(text), np.array([end_id], "<u4")).astype("<u4")
                cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    (full if b - a == size else held).append((doc_id, piece, a, ids[a:b].copy()))
                if len(full) >= 1024:
                    yield placed(full)
                    full = []
                if len(held) >= block:
                    yield placed(sorted(held, key=lambda r: -len(r[3])))
                    held = []
        yield placed(full)
        yield placed(sorted(held, key=lambda r: -len(r[3])))

    return keyed(docs, id_col, text_col).select("doc_id", "text").mapInPandas(run, SCHEMA)


def ids_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4")
