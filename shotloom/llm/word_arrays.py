"""Words of many texts as NumPy arrays, for functions that Spark runs over Arrow batches.

A word is a maximal run of letters, digits and underscores; letters of the basic plane are put
in lower case one by one.  Word hashes are polynomial prefix sums, so a batch costs a few passes
over its code points whatever the number of words.  Texts are worked on in blocks of bounded
size; a longer text is cut at white space and its words are joined again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np

BLOCK = 1 << 18
_U = np.uint64
_BASE, _INV = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)


class Words(NamedTuple):
    hashes: np.ndarray  # uint64, one per word
    doc: np.ndarray  # index of its text
    number: np.ndarray  # holds a digit
    name: np.ndarray  # capital first letter, rest lower case, not at the start of a sentence
    opener: np.ndarray  # the same at the start of a sentence, line, text or block
    place: np.ndarray  # block, start and stop of each word
    blocks: list  # text of the blocks

    def value(self, i: int) -> str:
        block, start, stop = self.place[:, i]
        return self.blocks[block][start:stop]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Kept(dict):
    """Tables that a worker builds once; they do not travel with the code."""

    def __reduce__(self):
        return _Kept, ()


_KEPT = _Kept()


def _tables() -> tuple[np.ndarray, ...]:
    if "tables" not in _KEPT:
        _KEPT["tables"] = _build_tables()
    return _KEPT["tables"]


def _build_tables() -> tuple[np.ndarray, ...]:
    chars = [chr(i) for i in range(65536)]
    lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else i for i, c in enumerate(chars)], np.uint32)
    word = np.array([c.isalnum() or c == "_" for c in chars])
    digit = np.array([c.isdigit() for c in chars])
    upper = np.array([c.isupper() for c in chars])
    ends = np.array([c in ".!?\n" for c in chars])
    return lower, word, digit, upper, ends


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(p):
        out = np.full(n, p, _U)
        out[0] = 1
        return np.multiply.accumulate(out)
    if "powers" not in _KEPT:
        _KEPT["powers"] = run(_BASE), run(_INV)
    return _KEPT["powers"]


def blocks(texts: Sequence[str], limit: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """(index, piece) lists of about ``limit`` characters each, in order."""
    held, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > limit:
            cut = max(text.rfind(" ", at + limit // 2, at + limit), text.rfind("\n", at + limit // 2, at + limit))
            cut = cut if cut > at else at + limit
            if held:
                yield held
                held, size = [], 0
            yield [(i, text[at:cut])]
            at = cut
        rest = text[at:] if at else text
        if size + len(rest) > limit and held:
            yield held
            held, size = [], 0
        held.append((i, rest))
        size += len(rest) + 1
    if held:
        yield held


def portions(texts: Sequence[str], limit: int = 2 * BLOCK, most: int = 256) -> Iterator[slice]:
    """Slices of consecutive texts with about ``limit`` characters together, at most ``most``; a longer text is one alone."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if i > at and (size + len(text) > limit or i - at >= most):
            yield slice(at, i)
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield slice(at, len(texts))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def hash_words(texts: Sequence[str], kinds: bool = False) -> Words:
    """Words of ``texts``; their kinds and places only on demand."""
    lower, word, digit, upper, ends = _tables()
    pw, ipw = _powers(BLOCK + 64)
    out, kept = [], []
    for block in blocks(texts):
        joined = "\n".join(piece for _, piece in block)
        cp = code_points(joined)
        plane = np.minimum(cp, 65535)
        low, inside = lower[plane], word[plane]
        if len(cp) and cp.max() > 65535:
            far = np.flatnonzero(cp > 65535)
            low[far] = cp[far]
            inside[far] = [chr(c).isalnum() for c in cp[far]]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        start, stop = edges[::2], edges[1::2]
        run = np.zeros(len(cp) + 1, _U)
        np.cumsum((low.astype(_U) + _U(1)) * pw[:len(cp)], out=run[1:])
        hashes = mix((run[stop] - run[start]) * ipw[start])
        lengths = np.array([len(piece) + 1 for _, piece in block])
        first = np.cumsum(lengths) - lengths
        doc = np.array([i for i, _ in block])[np.searchsorted(first, start, "right") - 1]
        number = name = opener = np.zeros(0, bool)
        place = np.zeros((3, 0), np.int64)
        if kinds:
            count = lambda mask: np.concatenate(([0], np.cumsum(mask[plane])))
            digits, capitals, stops = count(digit), count(upper), count(ends)
            number = digits[stop] > digits[start]
            before = np.concatenate(([0], stop[:-1]))
            opens = (stops[start] > stops[before]) | np.concatenate(([True], doc[1:] != doc[:-1]))[:len(doc)]
            proper = upper[plane[start]] & (capitals[stop] - capitals[start] == 1) & (stop - start > 1) & ~number
            name, opener = proper & ~opens, proper & opens
            place = np.stack([np.full(len(start), len(kept)), start, stop])
            kept.append(joined)
        out.append((hashes, doc, number, name, opener, place))
    if not out:
        none = np.zeros(0, bool)
        return Words(np.zeros(0, _U), np.zeros(0, np.int64), none, none, none, np.zeros((3, 0), np.int64), [])
    return Words(*[np.concatenate(x, axis=-1) for x in zip(*out)], kept)


def windows(hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words inside one text, and the index of its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    total = np.zeros(n, _U)
    factor = 1
    for k in range(width):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        total += hashes[k:k + n] * _U(factor)
    at = np.flatnonzero(doc[:n] == doc[width - 1:])
    return mix(total[at]), at


def shingles(texts: Sequence[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and the index of their text; a text with fewer words is one shingle of all its words."""
    words = hash_words(texts)
    hashes, at = windows(words.hashes, words.doc, width)
    doc = words.doc[at]
    count = np.bincount(words.doc, minlength=len(texts)) if len(words.doc) else np.zeros(len(texts), np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(words.doc, short)
        extra = [windows(words.hashes[f:f + count[s]], words.doc[f:f + count[s]], int(count[s]))[0][0]
                 ^ _U(0x5851F42D4C957F2D * int(count[s]) % (1 << 64)) for s, f in zip(short, first)]
        hashes, doc = np.concatenate([hashes, np.array(extra, _U)]), np.concatenate([doc, short])
    return hashes, doc


def bags(texts: Sequence[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multisets of shingles: text index, shingle hash and count, sorted by both."""
    hashes, doc = shingles(texts, width)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc)))
