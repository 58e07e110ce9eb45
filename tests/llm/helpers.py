"""Small tables with every awkward row, and plain Python versions of the operators."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

LONG = "alpha beta gamma delta epsilon zeta eta theta " * 40_000  # 1.8 million characters, few words
DOCS = [
    (1, "One line here\nTwo lines\n  ONE LINE HERE ", "en"), (2, None, "en"), (3, "", "fr"), (4, "x", None),
    (5, "same text of two rows, word for word", "de"), (5, "same text of two rows, word for word", "de"),
    (6, "same text of two rows, word for word", "es"), (None, "a row without an id but with some words", "en"),
    (None, None, None), (7, "id seven with one text about ships and sails", "en"),
    (7, "id seven again with another text about trains", "en"), (8, "\n\n \t\n", "en"),
    (9, "Ünïcode Straße 𝔘𝔫𝔦 ǅ \U0001f600 naïve café " * 3, "de"), (10, LONG, "en"), (11, "!!! ??? ---", "en"),
]


def awkward(spark, rows=DOCS):
    """Documents with nulls, repeats and extra columns whose names operators might use themselves."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return docs.withColumns({c: F.lit(7) for c in (
        "_d", "_t", "_keep", "_lines", "score", "kind", "class_id", "label", "bands", "pos", "key", "spans", "piece",
        "part", "edge", "turn", "value", "start", "item_id")})


def empty(spark):
    return awkward(spark).filter("false")


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def bag(text, width=5):
    w = words(text)
    return Counter(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else Counter()


def classes(texts, threshold=0.8):
    """{id: smallest id of its class} over all pairs that share a shingle; texts without words class by themselves."""
    bags = {i: bag(t) for i, t in texts.items()}
    by_shingle, parent, shared = defaultdict(list), {i: i for i in texts}, defaultdict(int)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, b in bags.items():
        for s in b:
            by_shingle[s].append(i)
    for s, ids in by_shingle.items():
        for x in range(len(ids)):
            for y in range(x):
                shared[ids[x], ids[y]] += min(bags[ids[x]][s], bags[ids[y]][s])
    size = {i: sum(b.values()) for i, b in bags.items()}
    links = [p for p, n in shared.items() if n / (size[p[0]] + size[p[1]] - n) >= threshold]
    bare = defaultdict(list)
    for i, t in texts.items():
        if not bags[i]:
            bare[t or ""].append(i)
    links += [(ids[0], i) for ids in bare.values() for i in ids[1:]]
    for x, y in links:
        a, b = sorted((find(x), find(y)))
        parent[b] = a
    return {i: find(i) for i in texts}
