"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters are single words (a short lexicon of insults, and words that mark the toxic training rows)
and patterns over them.  The label model is fitted to the votes alone by expectation
maximisation: for each voter how often it speaks in toxic and in clean texts.  Voters that speak
together within a class count less, by their correlations given the estimated class.  A linear
classifier is trained on the posteriors and scores every whole text.

The fit uses a bounded sample of labelled rows, at most ``SAMPLE``, those with the smallest hash
of their id; rows with crc32(id as text) mod 5 = 0 are held out.  What reaches the driver is the
words of highest weight and one feature row per sampled text.

Defined cases: null texts are empty and get the score of a text without votes; null ids are
scored and never learned from; without usable labels the lexicon alone votes; repeated rows are
scored each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shotloom.llm.common import keyed
from shotloom.llm.word_arrays import hash_words

SAMPLE, MINED, FOLDS, CHUNK = 20_000, 64, 5, 256  # CHUNK: texts whose words are in memory at once
# Insults that begin the lexicon.
LEXICON = ("idiot moron stupid loser scum trash pathetic worthless disgusting clown dumb jerk imbecile fool garbage vermin "
           "filth bastard dumbass crap idiote imbécile connard salaud ordure dummkopf arschloch abschaum trottel estúpido "
           "imbécil basura escoria").split()


@dataclass
class Model:
    words: list[str]
    hashes: np.ndarray  # sorted word hashes
    weights: np.ndarray
    bias: float


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _features(texts: Sequence[str], hashes: np.ndarray) -> np.ndarray:
    """Per text: how often each lexicon word occurs (log), then the patterns."""
    words = hash_words(texts)
    n, k = len(texts), len(hashes)
    at = np.minimum(np.searchsorted(hashes, words.hashes), max(k - 1, 0))
    hit = hashes[at] == words.hashes if k else np.zeros(len(at), bool)
    counts = np.bincount(words.doc[hit] * k + at[hit], minlength=n * k).reshape(n, k).astype(np.float64)
    total, kinds = counts.sum(axis=1), (counts > 0).sum(axis=1)
    length = np.bincount(words.doc, minlength=n)
    place = np.flatnonzero(hit)
    close = place[1:][(np.diff(place) <= 20) & (words.doc[place[1:]] == words.doc[place[:-1]])]
    near = np.bincount(words.doc[close], minlength=n) > 0
    dense = total > 0.005 * np.maximum(length, 1)
    patterns = np.stack([total > 0, kinds > 1, total > 2, near, dense], axis=1)
    return np.concatenate([np.log1p(counts), patterns.astype(np.float64)], axis=1)


PATTERNS = 5


def label_model(votes: np.ndarray, prior: float, rounds: int = 60) -> np.ndarray:
    """Posterior that each row is toxic, from 0/1 votes; accuracies and correlations by EM."""
    n, k = votes.shape
    rate = np.clip(votes.mean(axis=0), 1e-4, 1 - 1e-4)
    toxic, clean = np.clip(5 * rate, 0.05, 0.9), np.clip(rate * 0.1, 1e-4, 0.5)
    weight, belief = np.ones(k), np.full(n, prior)
    for turn in range(rounds):
        odds = (votes @ (weight * np.log(toxic / clean)) + (1 - votes) @ (weight * np.log((1 - toxic) / (1 - clean)))
                + np.log(prior / (1 - prior)))
        belief = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        mass = belief.sum()
        prior = float(np.clip((mass + 1) / (n + 10), 1e-3, 0.5))
        toxic = np.clip((belief @ votes + 0.5) / (mass + 1), 1e-4, 1 - 1e-4)
        clean = np.clip(((1 - belief) @ votes + 0.05) / (n - mass + 1), 1e-5, 1 - 1e-4)
        if turn == rounds // 2:  # correlations given the class, once the classes have settled
            rest = votes - belief[:, None] * toxic - (1 - belief)[:, None] * clean
            spread = np.sqrt((rest**2).mean(axis=0)) + 1e-9
            corr = (rest.T @ rest) / n / np.outer(spread, spread)
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.maximum(corr, 0).sum(axis=1))
    return belief


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton steps for soft labels; the last weight is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _mined(rows: DataFrame) -> list[str]:
    """Words that mark the toxic rows: those of highest likelihood ratio, beyond chance."""
    totals = rows.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    pos, n = int(totals[0] or 0), int(totals[1])
    if pos == 0 or pos == n:
        return []
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)))
    counts = (rows.select("toxic", F.explode(words).alias("word")).groupBy("word")
              .agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).filter("a >= 3"))
    a, b = F.col("a"), F.col("b")
    both, expected = a + b, (a + b) * pos / n
    gain = 2 * (a * F.log(a / expected) + F.when(b > 0, b * F.log(b / (both - expected))).otherwise(F.lit(0.0)))
    strong = (a / pos) > 20 * ((b + 0.5) / (n - pos))
    return [r["word"] for r in counts.filter(strong & (gain > 25)).orderBy(gain.desc(), "word").limit(MINED).collect()]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Model:
    base = keyed(docs, id_col, text_col)
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    usable = marks.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = base.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` small rows
    words = list(dict.fromkeys([*LEXICON, *_mined(rows)]))
    hashes = hash_words(["\n".join(words)]).hashes
    hashes = np.sort(hashes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), CHUNK):
                part = pdf.iloc[at:at + CHUNK]
                found = _features(part["text"].tolist(), hashes)
                yield pd.DataFrame({"toxic": part["toxic"].array, "x": pd.Series(list(found), dtype="object")})

    got = rows.select("toxic", "text").mapInPandas(run, "toxic int, x array<double>").toPandas()
    if not len(got):
        x, toxic = np.zeros((1, len(words) + PATTERNS)), np.zeros(1)
    else:
        x, toxic = np.stack(got["x"].to_numpy()), got["toxic"].to_numpy(float)
    votes = (x > 0).astype(float)
    prior = float(np.clip(toxic.mean(), 0.02, 0.5))
    belief = label_model(votes, prior)
    # Words that no sampled text has are known to the lexicon: each is one toxic text, beside many silent ones.
    unheard = np.flatnonzero(votes[:, :len(words)].sum(axis=0) == 0)
    heard = np.zeros((len(unheard), x.shape[1]))
    heard[np.arange(len(unheard)), unheard], heard[:, len(words)] = np.log(2.0), 1.0
    silent = np.zeros((10 * len(unheard) + 2, x.shape[1]))
    x_all = np.concatenate([x, silent, heard])
    y_all = np.concatenate([belief, np.zeros(len(silent)), np.ones(len(unheard))])
    w = _logistic(x_all, y_all)
    return Model(words, hashes, w[:-1], float(w[-1]))


def score(docs: DataFrame, model: Model, keep: Sequence[str] = (), id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` of every row, and ``_keep``, a struct of the columns in ``keep``."""
    hashes, weights, bias = model.hashes, model.weights, model.bias

    @F.pandas_udf("double")
    def likely(texts: pd.Series) -> pd.Series:
        parts = [_features(texts.iloc[k:k + CHUNK].tolist(), hashes) @ weights + bias for k in range(0, len(texts), CHUNK)]
        odds = np.concatenate(parts) if parts else np.zeros(0)
        return pd.Series(1 / (1 + np.exp(-np.clip(odds, -40, 40))))

    scored = keyed(docs, id_col, text_col, keep).select("doc_id", "_keep", likely("text").alias("score"))
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "_keep")
