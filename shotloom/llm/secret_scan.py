"""Secret scan: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order models over character pairs are trained from labelled samples, one on random
strings, one on ordinary identifiers.  A long token is a secret if the ratio of the two
likelihoods is high.  Everything on the data is a built-in function; the models are one array of
128 x 128 log ratios, whatever the data.

``samples_from`` labels a bounded sample of documents, about ``SAMPLE`` chosen by a hash of id and
text: values of the fixed patterns are random strings, words are identifiers.

Defined cases: null texts are empty and have no spans; null and repeated ids are allowed, every
row is scanned; without samples of a kind its model is uniform; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotloom.llm.common import keyed, matches

KINDS = ("assign", "access", "hex", "markov")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The base patterns.  Runs of access and hex matches are maximal, so the least length is in the pattern.
_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")),
                   _either_case("api") + "_?" + _either_case("key")])
ASSIGN = "(" + _NAMES + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "(?<![0-9a-f])[0-9a-f]{16,}"
TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
WORD = "(?<![A-Za-z0-9_])[A-Za-z_]{4,}(?![A-Za-z0-9_])"
LEAST_VALUE, SAMPLE, PER_CHAR, IN_ALL, ALPHABET, STRENGTH = 12, 4000, 0.5, 12.0, 66, 8.0
_SPAN = "array<struct<start:bigint,stop:bigint,value:string>>"


def _found(wanted: Column, pattern: str) -> Column:
    """Matches where a cheap test allows any."""
    return F.when(wanted, matches(F.col("text"), pattern)).otherwise(F.array().cast(_SPAN))


def _base(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    assigned = _found(F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")), ASSIGN)
    long_enough = F.filter(assigned, lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= LEAST_VALUE)
    return docs.withColumns({"_assign": long_enough, "_access": _found(F.contains(text, F.lit("AKIA")), ACCESS),
                             "_hex": _found(text.rlike(HEX), HEX)})


def samples_from(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled samples ``token``, ``secret`` from about ``sample`` documents."""
    base = keyed(docs, id_col, text_col)
    share = min(1.0, sample / max(base.count(), 1))
    chosen = _base(base.filter(F.pmod(F.xxhash64("_d", "_t"), F.lit(1 << 20)) < int(share * (1 << 20)))
                   .select("text"))
    values = F.concat(F.transform("_assign", lambda m: F.regexp_extract(m["value"], ASSIGN, 2)),
                      F.transform("_access", lambda m: m["value"]), F.transform("_hex", lambda m: m["value"]))
    rest = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), "AKIA[A-Z0-9]+", " ")
    words = F.regexp_extract_all(rest, F.lit(WORD), F.lit(0))
    return (chosen.select(F.explode(values).alias("token"), F.lit(True).alias("secret"))
            .unionByName(chosen.select(F.explode(words).alias("token"), F.lit(False).alias("secret"))))


def train(samples: DataFrame) -> list[float]:
    """128 x 128 log ratios of next-character probabilities, random strings over identifiers.

    Tokens are counted before their pairs, and at most 2 x 128 x 128 counts reach the driver.
    """
    counted = samples.filter(F.col("token").isNotNull() & F.col("secret").isNotNull()).groupBy("secret", "token").agg(
        F.count(F.lit(1)).alias("n")).filter(F.length("token") >= 2)
    chars = F.split("token", "")
    pairs = F.zip_with(F.slice(chars, F.lit(1), F.length("token") - 1), F.slice(chars, F.lit(2), F.length("token") - 1),
                       lambda a, b: F.ascii(a) * 128 + F.ascii(b))
    rows = (counted.select("secret", "n", F.explode(pairs).alias("pair")).filter("pair between 0 and 16383")
            .groupBy("secret", "pair").agg(F.sum("n").alias("n")).collect())
    seen = {(r["secret"], r["pair"]): r["n"] for r in rows}
    before, single, total = Counter(), Counter(), Counter()
    for (secret, pair), n in seen.items():
        before[secret, pair // 128] += n
        single[secret, pair % 128] += n
        total[secret] += n

    def chance(secret: bool, pair: int) -> float:
        """Next-character probability, smoothed by the plain frequency of the character."""
        alone = (single[secret, pair % 128] + 1) / (total[secret] + ALPHABET)
        return (seen.get((secret, pair), 0) + STRENGTH * alone) / (before[secret, pair // 128] + STRENGTH)

    # Random strings come in many alphabets, so half of their model is uniform.
    return [math.log((0.5 * chance(True, p) + 0.5 / ALPHABET) / chance(False, p)) for p in range(128 * 128)]


def log_ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token of ASCII characters."""
    table = F.lit(model)
    chars = F.split(token, "")
    pairs = F.zip_with(F.slice(chars, F.lit(1), F.length(token) - 1), F.slice(chars, F.lit(2), F.length(token) - 1),
                       lambda a, b: F.get(table, F.ascii(a) * 128 + F.ascii(b)))
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def scan(docs: DataFrame, model: list[float], per_char: float = PER_CHAR, in_all: float = IN_ALL,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (start, kind, stop, value) in code points, by start and kind.

    A token that overlaps no base span is added if its ratio is over ``in_all`` and over
    ``per_char`` for each of its characters.
    """
    found = _base(keyed(docs, id_col, text_col).select("doc_id", "text"))
    found = found.withColumn("_tokens", _found(F.col("text").rlike(TOKEN), TOKEN))

    def of(name: str, number: int) -> Column:
        return F.transform(f"_{name}", lambda m: F.struct(
            m["start"].alias("start"), F.lit(number).alias("kind"), m["stop"].alias("stop"), m["value"].alias("value")))

    found = found.withColumn("_base", F.concat(*[of(k, i) for i, k in enumerate(KINDS[:3])]))
    apart = F.filter("_tokens", lambda m: ~F.exists(
        "_base", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])))
    likely = F.filter(apart, lambda m: log_ratio(m["value"], model) > F.greatest(
        F.lit(in_all), per_char * F.length(m["value"])))
    found = found.withColumn("_markov", likely)
    spans = F.array_sort(F.concat("_base", of("markov", 3)))
    names = F.array(*map(F.lit, KINDS))
    return found.select("doc_id", F.transform(spans, lambda s: F.struct(
        F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"),
        s["value"].alias("value"))).alias("spans"))
