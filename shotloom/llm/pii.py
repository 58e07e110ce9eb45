"""Personal data: many overlapping candidates, boosted trees, calibrated thresholds.

Fixed patterns with validators give the base spans.  Generators then propose overlapping spans:
address-like words around an at sign, and every run of number groups of up to 19 digits but for
single digits.  Boosted trees
score a candidate by its format and its context; they are trained on a bounded sample: about ``SAMPLE``
texts, and of each at most ``PER_TEXT`` candidates, both drawn by a hash.  There base spans are right; candidates that the validator of their own
kind rejects or that overlap a base span are wrong; the rest is judged by weak rules of format and
context, which are no features, and stays out inside a rejected match where these do not speak for it.  Per kind the
least threshold that keeps the precision on held-out candidates selects spans; of overlapping
ones the best stays, and base spans always do.

Defined cases: null texts are empty and have no spans; null and repeated ids are allowed, every
row is scanned; of equal scores the longer, then the earlier span stays; a run of digits or letters of any length
costs one pass; without candidates to learn from the base spans stand alone; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.llm.common import keyed

KINDS = ("email", "ip", "card", "phone")
SAMPLE, PER_TEXT, TREES, DEPTH, RATE, PRECISION, DIGITS = 8_000, 50, 60, 4, 0.2, 0.97, 19
SPANS = "array<struct<kind:string,start:int,stop:int,score:double>>"
# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# The same from the head of a run on, without going back into a run: every character is met once.
HEAD_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
NEXT_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
HEAD_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
ADDRESS = re.compile(r"(?<![^\s@<>,;:\"'|])[^\s@<>,;:\"'|]+(?:@| ?[\[(]at[\])] ?)[^\s@<>,;:\"'|]++")
RUN = re.compile(r"\+?\(?[0-9][0-9().\x20+-]*[0-9]")
DIGIT = re.compile("[0-9]")
# Weak rules for what no base pattern judges: addresses with any letters or a written-out at sign, national numbers.
WEAK_EMAIL = re.compile(r"[^\s@()\[\]]+(?:@| ?[\[(]at[\])] ?)[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
WEAK_CARD = re.compile(r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(\1[0-9]{1,3})?|3[0-9]{3}([ -])[0-9]{6}\3[0-9]{5}")
WEAK_PHONE = re.compile(r"(\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,5}\)[ .-]?[0-9]{2,8}([ .-][0-9]{2,4}){0,3}|[0-9]{3}([ .-])[0-9]{3}\3[0-9]{4}"
                        r"|0[0-9]([ .-])[0-9]{2}(\4[0-9]{2}){3}|0[0-9]{2,4}[ -][0-9]{3,4}[ -]?[0-9]{3,4}")
PHONE_WORD, CARD_WORD = re.compile(r"\b(tel|phone|telephone|call|fax|mobile)\b"), re.compile(r"\b(card|visa|credit)\b")
NUMBER_BEFORE, NUMBER_AFTER = re.compile(r"[0-9][ .()+-]*$"), re.compile(r"[ .()+-]*[0-9]")
CONTEXT = (("mail", "contact", "write"), ("ip", "host", "server", "address"), ("card", "visa", "credit", "account"),
           ("tel", "phone", "call", "fax", "mobile"))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in text.split("."))
    digits = digits_of(text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def emails(text: str) -> Iterator[re.Match]:
    """The matches of EMAIL.  One begins at the head of a run or where the last one ended."""
    at = 0
    while m := (at and NEXT_EMAIL.match(text, at)) or HEAD_EMAIL.search(text, at):
        yield m
        at = m.end()


def base_matches(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, stop, passed) of every pattern match."""
    out = []
    numbers = DIGIT.search(text) is not None
    find = (emails, HEAD_IP.finditer, CARD.finditer, PHONE.finditer)
    for kind, matches, wanted in zip(KINDS, find, ("@" in text, numbers, numbers, "+" in text)):
        if wanted:
            out += [(kind, m.start(), m.end(), valid(kind, m.group())) for m in matches(text)]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "@" in text or "at]" in text or "at)" in text:
        out += [("email", m.start(), m.end() - (m.group()[-1] in ".!?")) for m in ADDRESS.finditer(text)]
    if DIGIT.search(text) is None:
        return out
    for run in RUN.finditer(text):
        groups, at = [], run.start()
        for group in run.group().split(" "):
            if n := len(digits_of(group)):
                groups.append((at, at + len(group), n))
            at += len(group) + 1
        for i in range(len(groups)):
            n = 0
            for j in range(i, len(groups)):
                n += groups[j][2]
                if n > DIGITS:
                    break
                if n < 1.5 * (j - i + 1):  # digits one by one, as in a row of a table: no number is written so
                    continue
                start, stop = groups[i][0], groups[j][1]
                part = text[start:stop]
                if i == j and IP.fullmatch(part):
                    out.append(("ip", start, stop))
                elif 13 <= n <= 19:
                    out.append(("card", start, stop))
                if 7 <= n <= 15 and part.count(".") < 3:
                    out.append(("phone", start, stop))
    return out


def weak(text: str, kind: str, start: int, stop: int) -> bool:
    """A format that only its kind has, or a plain one after a word that names the kind; never a part of more digits."""
    part, before = text[start:stop], text[max(0, start - 24):start].lower()
    if kind == "email":
        return bool(WEAK_EMAIL.fullmatch(part))
    if kind == "ip" or NUMBER_BEFORE.search(before) or NUMBER_AFTER.match(text[stop:stop + 8]):
        return False
    if before[-1:].isalnum() or text[stop:stop + 1].isalnum() or scattered(part):
        return False
    if kind == "card":
        return luhn(digits_of(part)) and bool(WEAK_CARD.fullmatch(part) or CARD_WORD.search(before))
    return bool(WEAK_PHONE.fullmatch(part) or PHONE_WORD.search(before) and not IP.fullmatch(part))


def scattered(part: str) -> bool:
    """Digits one by one, as in a row of a table."""
    return len(digits_of(part)) < 1.5 * len(part.split(" "))


def features(text: str, kind: str, start: int, stop: int) -> list[float]:
    part, before, after = text[start:stop], text[max(0, start - 24):start].lower(), text[stop:stop + 8]
    digits = digits_of(part)
    octets = [int(p) for p in part.split(".") if p.isdigit() and len(p) < 6] if kind == "ip" else []
    domain = part.partition("@")[2]
    return [
        float(KINDS.index(kind)), len(digits), len(part), len(digits) / max(len(part), 1), part.count(" "),
        part.count("-"), part.count("."), float("(" in part), float(part[:1] == "+"), float(part[:1] == "("),
        float(bool(digits) and luhn(digits)), float(max(octets, default=-1)), float(len(octets)),
        float(bool(EMAIL.fullmatch(part))), float("." in domain.strip(".")), float(len(domain.rpartition(".")[2])),
        float(before[-1:].isdigit()), float(bool(re.search(r"[0-9)][ .-]?$", before))), float(before[-2:-1] == "+" or before[-1:] == "+"),
        float(before[-1:].isalpha()), float(after[:1].isalpha()), float(after[:1].isdigit()), float(bool(re.match(r"[ .-]?[(]?[0-9]", after))),
        *[float(any(w in before for w in words)) for words in CONTEXT],
        float(scattered(part)), *_shape(part), float(bool(NUMBER_BEFORE.search(before))), float(bool(NUMBER_AFTER.match(after)))]


def _shape(part: str) -> list[float]:
    """Lengths of the first four digit groups, and how many different separators stand between them."""
    groups, marks = re.findall("[0-9]+", part[:64]), re.findall("[^0-9]+", part[:64].strip("+( "))
    return [*[float(len(g)) for g in (groups + [""] * 4)[:4]], float(len(groups)), float(len(set(marks)))]


@dataclass
class Boosted:
    """Boosted regression trees for the logistic loss; a tree is (feature, cut, left, right) or a number."""

    start: float = -6.0
    trees: list = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.start)
        for tree in self.trees:
            odds += RATE * _leaf(tree, x)
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def _leaf(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    feature, cut, left, right = tree
    goes = x[:, feature] <= cut
    out = np.empty(len(x))
    out[goes], out[~goes] = _leaf(left, x[goes]), _leaf(right, x[~goes])
    return out


def _grow(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int):
    """Best splits by gain of the second-order loss, over at most 32 cuts a feature."""
    g, h = slope.sum(), curve.sum()
    best = (1e-3, None, None)
    if depth and len(x) >= 8:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            if len(values) < 2:
                continue
            cuts = values[:-1] if len(values) <= 32 else np.unique(np.quantile(values, np.linspace(0.02, 0.98, 32)))
            place = np.searchsorted(cuts, x[:, f], "left")
            gs = np.cumsum(np.bincount(place, slope, len(cuts) + 1))[:-1]
            hs = np.cumsum(np.bincount(place, curve, len(cuts) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], f, cuts[at])
    if best[1] is None:
        return float(g / (h + 1))
    goes = x[:, best[1]] <= best[2]
    return (best[1], float(best[2]), _grow(x[goes], slope[goes], curve[goes], depth - 1),
            _grow(x[~goes], slope[~goes], curve[~goes], depth - 1))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Boosted:
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(rate / (1 - rate))))
    for _ in range(trees):
        p = model.score(x)
        model.trees.append(_grow(x, y - p, p * (1 - p), depth))
    return model


@dataclass
class Detector:
    model: Boosted
    thresholds: dict[str, float]


def _labelled(text: str) -> Iterator[tuple[list[float], int, str]]:
    matched = base_matches(text)
    right = {(k, a, b) for k, a, b, passed in matched if passed}
    failed = {(k, a, b) for k, a, b, passed in matched if not passed}
    # Numbers that pass the check digit are the hard ones; in a table of digits they are few, so they are drawn first.
    def draw(c):
        return c[0] == "card" and not luhn(digits_of(text[c[1]:c[2]])), zlib.crc32(repr(c).encode())

    proposed = sorted(candidates(text), key=draw)[:PER_TEXT]
    good = {c for c in proposed if weak(text, *c)}
    for kind, a, b in proposed:
        if (kind, a, b) in right:
            yield features(text, kind, a, b), 1, kind
        elif (kind, a, b) in failed or any(a < y and x < b for _, x, y in right):
            yield features(text, kind, a, b), 0, kind
        elif (kind, a, b) in good:
            yield features(text, kind, a, b), 1, kind
        elif any(k == kind and a < y and x < b for k, x, y in good):  # a part of it, or more than it
            yield features(text, kind, a, b), 0, kind
        elif kind != "email" and scattered(text[a:b]) or not any(
                x <= a and b <= y and (x, y) != (a, b) for _, x, y in failed):
            yield features(text, kind, a, b), 0, kind


def train(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Detector:
    """Trees from at most about ``sample`` texts with a digit or an at sign, chosen by a hash; a fifth calibrates."""
    base = keyed(docs, id_col, text_col).filter(F.col("text").rlike("[0-9@]")).select("_d", "_t", "text")
    share = min(1.0, sample / max(base.count(), 1))
    chosen = base.filter(F.pmod(F.xxhash64("_d", "_t"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(x, y, k, int(t) % 5 == 0) for t, text in zip(pdf["_t"], pdf["text"]) for x, y, k in _labelled(text)]
            yield pd.DataFrame(rows, columns=["x", "y", "kind", "aside"])

    got = chosen.mapInPandas(run, "x array<double>, y int, kind string, aside boolean").toPandas()
    if len(got) < 20 or got["y"].nunique() < 2:
        return Detector(Boosted(), {})
    got = got.sort_values(["kind", "y", "x"], key=lambda c: c.map(tuple) if c.name == "x" else c).reset_index(drop=True)
    x, y, aside = np.stack(got["x"].to_numpy()), got["y"].to_numpy(float), got["aside"].to_numpy(bool)
    fitted = ~aside if 0 < y[~aside].sum() < (~aside).sum() else np.ones(len(y), bool)
    model = boost(x[fitted], y[fitted])
    held = aside if aside.sum() >= 20 else np.ones(len(y), bool)
    score, thresholds = model.score(x[held]), {}
    for kind in KINDS:
        own = got["kind"].to_numpy()[held] == kind
        thresholds[kind] = _threshold(score[own], y[held][own])
    return Detector(model, thresholds)


def _threshold(score: np.ndarray, truth: np.ndarray) -> float:
    """Least score, from one half, above which the share of right candidates is at least PRECISION."""
    for cut in np.unique(np.append(score[score >= 0.5], 0.5)):
        above = score >= cut
        if above.any() and truth[above].mean() >= PRECISION:
            return float(cut)
    return 2.0


def _spans(text: str, detector: Detector) -> list[tuple]:
    found = [(k, a, b, 1.0) for k, a, b, passed in base_matches(text) if passed]
    proposed = [c for c in candidates(text) if c[0] in detector.thresholds] if detector.model.trees else []
    if proposed:
        scores = detector.model.score(np.array([features(text, *c) for c in proposed]))
        taken = sorted((a, b) for _, a, b, _ in found)
        good = [(s, c) for s, c in zip(scores, proposed) if s >= detector.thresholds[c[0]]]
        free = _Free(taken)
        for s, (kind, a, b) in sorted(good, key=lambda g: (-round(g[0], 9), g[1][1] - g[1][2], g[1])):
            if free.take(a, b):
                found.append((kind, a, b, min(float(s), 0.999999)))  # 1 is for base spans
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


class _Free:
    """Places of a text that no span has taken."""

    def __init__(self, taken: list[tuple[int, int]]):
        self.used = {p for a, b in taken for p in range(a, b)}

    def take(self, a: int, b: int) -> bool:
        if any(p in self.used for p in range(a, b)):
            return False
        self.used.update(range(a, b))
        return True


def scan(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` and its ``spans`` (kind, start, stop, score) in code points, by kind and start."""
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "start", "stop", "score"), s)) for s in _spans(t, detector)] for t in texts],
                         dtype="object")
    find_udf = F.pandas_udf(find, SPANS)
    return keyed(docs, id_col, text_col).select("doc_id", "text", find_udf("text").alias("spans"))


def redact(found: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with every span replaced by its kind in angle brackets."""
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans):
            at, parts = 0, []
            for s in sorted(own, key=lambda s: (s["start"], -s["stop"])):
                if s["start"] >= at:
                    parts += [text[at:s["start"]], f"<{s['kind']}>"]
                at = max(at, s["stop"])
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype="object")
    return found.select("doc_id", F.pandas_udf(cut, "string")("text", "spans").alias("text"))
