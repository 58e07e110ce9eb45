import hashlib
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from helpers import DOCS, awkward, bag, classes, empty, words  # noqa: E402

import corpus_pipeline  # noqa: E402
from shotloom.llm import decontaminate, fingerprint, minhash, token_packing, toxicity, word_arrays  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_words_and_bags_equal_plain():
    texts = [t or "" for _, t, _ in DOCS] + ["a b c d", "a b c d e", "A_b 1,000 x" * 50]
    doc, item, count = word_arrays.bags(texts, 5)
    for i, text in enumerate(texts):
        assert sorted(count[doc == i]) == sorted(bag(text).values())
    assert [len(words(t)) for t in texts] == list(np.bincount(word_arrays.hash_words(texts).doc, minlength=len(texts)))


def test_long_text_in_blocks_has_the_words_of_the_whole(monkeypatch):
    texts = ["one two three four five six seven " * 30, "short", "no_blank" * 40]
    whole = word_arrays.hash_words(texts)
    monkeypatch.setattr(word_arrays.blocks, "__defaults__", (100,))
    parts = word_arrays.hash_words(texts)
    keep = whole.doc < 2
    assert list(parts.hashes[parts.doc < 2]) == list(whole.hashes[keep])


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(1)
    item = rng.integers(0, 2**63, 60).astype(np.uint64)
    left, right = rng.integers(0, 6, 60), rng.integers(0, 6, 60)
    doc = np.repeat([0, 1], 60)
    count = np.concatenate([left, right])
    seen = count > 0
    times = minhash.bag_minhash(doc[seen], np.concatenate([item, item])[seen], count[seen], 2, 4096)
    truth = np.minimum(left, right).sum() / np.maximum(left, right).sum()
    assert abs((times[0] == times[1]).mean() - truth) < 0.03


def edited(text, every, at):
    out = text.split(" ")
    for i in range(at, len(out), every):
        out[i] = f"edit{i}"
    return " ".join(out)


def test_near_duplicates_equal_plain_classes(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(12):
        base = " ".join(rng.choice(vocabulary, 220))
        rows += [(1000 * g + k, edited(base, int(rng.integers(45, 200)), k), "") for k in range(8)]
        rows += [(1000 * g + 500 + k, base, "") for k in range(5)]
        rows += [(1000 * g + 700 + k, " ".join(base.split(" ")[:90]) + " " + " ".join(rng.choice(vocabulary, 130)), "") for k in range(6)]
    rows += [(20_000, None, ""), (20_001, "", ""), (20_002, "!!!", ""), (20_003, "!!!", ""), (20_004, "???", ""),
             (20_005, "one two", ""), (20_006, "Two one", ""), (20_007, "ONE, two!", "")]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(awkward(spark, rows)).collect()}
    assert got == classes({i: t for i, t, _ in rows})


def test_hot_group_of_near_copies_is_one_class(spark):
    base = " ".join(f"t{i}" for i in range(300))
    rows = [(i, edited(base, 97, i % 97), "") for i in range(900)]
    got = {r.class_id for r in minhash.near_duplicates(awkward(spark, rows)).collect()}
    assert got == {0}


def test_hot_group_keeps_links_to_members_that_lead_no_bucket(spark):
    rng = np.random.default_rng(4)
    base, rows = [f"t{i}" for i in range(200)], []
    for k in range(150):
        member = list(base)
        member[int(rng.integers(4, 196))] = f"own{k}"
        rows.append((k, " ".join(member), ""))
        if k < 100:  # four more words: 0.81 to this member, 0.77 and less to all others
            for j in rng.permutation(np.arange(10, 190, 12))[:4]:
                member[int(j)] = f"more{k}_{j}"
            rows.append((1000 + k, " ".join(member), ""))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(awkward(spark, rows)).collect()}
    assert got == classes({i: t for i, t, _ in rows})


def test_pieces_link_all_labels_of_a_bucket(spark):
    rows = [(0, 1, i % 3, 5, i, i) for i in range(60)] + [(1, 2, 2, 2, i, 7) for i in range(50)] + [(2, 3, 3, 3, i, i) for i in range(5)]
    frame = spark.createDataFrame(rows, "band int, key long, key2 long, key3 long, node long, label long")
    pairs = {tuple(r) for r in minhash._pieces(frame).collect()}
    assert {(x, y) for x in range(5) for y in range(x + 1, 5)} <= pairs
    assert all((i, i + 3) in pairs for i in range(57)) and len(pairs) < 200


def test_pieces_tell_the_labels_of_their_pairs(spark):
    rows = [(0, 1, i % 3, 5, i, i % 7, 100 + i) for i in range(60)] + [(2, 3, 3, 3, i, i % 2, 100) for i in range(5)]
    frame = spark.createDataFrame(rows, "band int, key long, key2 long, key3 long, node long, label long, weight long")
    got = minhash._pieces(frame, 0.8, ("x", "y", "lx", "ly")).collect()
    labels = {r[4]: {t[5] for t in rows if t[4] == r[4]} for r in rows}
    assert len({(r.x, r.y, r.lx, r.ly) for r in got}) == len(got)
    assert all(r.lx != r.ly and r.lx in labels[r.x] and r.ly in labels[r.y] for r in got)
    assert {(0, 1), (0, 3), (1, 2), (1, 4), (2, 3), (3, 4)} <= {(r.x, r.y) for r in got}


def test_components_and_roots(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 90), (96, 95), (200, 200)]
    frame = spark.createDataFrame(edges, "x long, y long")
    assert {r.node: r.label for r in minhash.components(frame).collect()} == {
        **{i: 0 for i in range(41)}, 100: 90, 95: 90, 96: 90, 90: 90, 200: 200}
    forest = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 90)], "x long, y long")
    assert {r.node: r.label for r in minhash.roots(forest).collect()} == {**{i: 0 for i in range(41)}, 100: 90, 90: 90}


def test_near_duplicates_of_awkward_rows(spark):
    got = minhash.near_duplicates(awkward(spark)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.class_id)
    assert len(got) == len(DOCS) and by[5] == [5, 5] and by[6] == [5] and by[2] == by[3] == [2]
    assert sorted(map(str, by[None])) == ["2", "None"] and by[7] == [7, 7]
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_fingerprints(spark):
    rows = [(i, t, lang) for i, t, lang in DOCS]
    got = fingerprint.compare_edited(awkward(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert {r.n_chars for r in got if r.doc_id == 10} == {len(DOCS[13][1])}
    prints = {r.doc_id: r.fingerprint for r in fingerprint.fingerprint(awkward(spark, rows)).collect()}
    assert prints[5] == prints[6] and prints[2] == prints[3] and prints[1] != prints[4]
    assert fingerprint.compare_edited(empty(spark)).count() == 0
    one = fingerprint.compare_edited(awkward(spark, [(4, "abcdef", "")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0
    same = spark.createDataFrame([(one.fingerprint, one.edited_fingerprint)], "a string, b string")
    assert same.select(fingerprint.likeness_of(F.col("a"), F.col("b"))).first()[0] == one.near_edited


def plain_codes(text, buckets):
    """Length code and bucket codes, byte by byte."""
    data, counts = (text or "").encode(), [0] * buckets
    for p in range(len(data)):
        for salt, places in enumerate(((0, 3, 6), (0, 4, 7), (0, 5, 9), (0, 2, 8), (0, 6, 11))):
            if p + places[2] < len(data):
                x = sum(data[p + k] << 8 * n for n, k in enumerate(places)) + ((salt + 1) << 24)
                for factor in (0x7FEB352D, 0x846CA68B):
                    x = (x ^ x >> (16 if factor == 0x7FEB352D else 15)) * factor % 2**32
                counts[(x ^ x >> 16) % buckets] += 1
    ranked = sorted(counts)

    def quartile(q):
        at = (buckets - 1) * q / 4
        low = int(at)
        return ranked[low] + (ranked[min(low + 1, buckets - 1)] - ranked[low]) * (at - low)

    length = 0
    while 1.1 ** (length + 1) <= len(data) + 1 and length < 255:
        length += 1
    return length, [sum(n > quartile(q) for q in (1, 2, 3)) for n in counts]


def plain_likeness(left, right):
    (a, x), (b, y) = left, right
    apart = sum((0, 1, 2, 6)[abs(i - j)] for i, j in zip(x, y)) + min(abs(a - b), 16) * len(x) / 256
    return max(0.0, 1.0 - apart / (2.0 * len(x)))


def test_fingerprints_equal_a_plain_count(monkeypatch):
    texts = ["", "a", "abcdefghijk", "abcdefghijkl", "Straße 𝔘 naïve " * 30, "some words that stay the same " * 40, "0123456789" * 150]
    for span in (7, 64, 1 << 20):
        monkeypatch.setattr(fingerprint, "SPAN", span)
        for text in texts:
            length, codes = plain_codes(text, fingerprint.BUCKETS)
            got = fingerprint.digest(text)
            assert got[0] == length and [b >> s & 3 for b in got[1:] for s in (6, 4, 2, 0)] == codes
    for one in texts:
        for other in texts:
            assert fingerprint.likeness(fingerprint.digest(one), fingerprint.digest(other)) == pytest.approx(
                plain_likeness(plain_codes(one, 1024), plain_codes(other, 1024)))


def test_fingerprint_neighbours_over_many_tasks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = fingerprint.compare_edited(docs.repartition(7)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for r in got:
        text, half = texts[r.doc_id], len(texts[r.doc_id]) // 2
        want = text[:len(text) - half] + texts[after[r.doc_id]][:half]
        assert r.edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert r.near_next == fingerprint.likeness(fingerprint.digest(text), fingerprint.digest(texts[after[r.doc_id]]))
    assert len(got) == len(texts) and np.mean([r.near_edited > r.near_next for r in got]) > 0.95


def test_likeness_is_bounded_and_falls_with_edits():
    text = "some words that stay the same for a while " * 40
    a = fingerprint.digest(text)
    near, far = fingerprint.digest(edited(text, 30, 3)), fingerprint.digest("0123456789" * 150)
    assert fingerprint.likeness(a, a) == 1.0 and 1 > fingerprint.likeness(a, near) > fingerprint.likeness(a, far) >= 0


def test_packing_equals_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    rows = DOCS + [(30, "<|endoftext|> is text", ""), (31, "  \n\n lots   of\tspace \n", ""), (32, "word " * 3000, "")]
    rows += [(33, " " * 1_000_000, ""), (34, "a" + " \n" * 400_000 + "<|endoftext|>", "")]  # more than one engine's pattern stack holds
    got = token_packing.pack_documents(awkward(spark, rows)).collect()
    per = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) // 4 and 0 < r.length <= 1024
        per[r.doc_id].append(r)
    for doc_id in {r[0] for r in rows}:
        want = Counter(tuple([*coder.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, _ in rows if i == doc_id)
        if sum(want.values()) == 1:
            parts = sorted(per[doc_id], key=lambda r: r.piece)
            assert [r.piece for r in parts] == list(range(len(parts))) and all(r.length == 1024 for r in parts[1:])
            assert Counter([tuple(np.concatenate([token_packing.ids_of(r.ids) for r in parts]))]) == want
    check_layout(got)
    assert token_packing.pack_documents(empty(spark)).count() == 0


def check_layout(rows, size=1024):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_is_tight(spark):
    rows = token_packing.pack_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert check_layout(rows) <= 1.02 * -(-sum(r.length for r in rows) // 1024)


@pytest.mark.parametrize("most", [1, 4, 100])
def test_open_bins_equal_plain_best_fit(most):
    rng = np.random.default_rng(most)
    bins, plain, closed = token_packing.OpenBins(100, most), {}, 0
    for length in rng.integers(1, 101, 2000).tolist():
        number, offset = bins.place(length)
        fits = [free for free in plain.values() if free >= length]
        if fits:
            assert plain[number] == min(fits)
        else:
            if len(plain) >= most:
                least = min(plain.values())
                plain.pop(next(k for k in plain if plain[k] == least and not any(k in b for b in bins.by_free)))
                closed += 1
            plain[number] = 100
        assert offset == 100 - plain[number]
        plain[number] -= length
        if not plain[number]:
            del plain[number]
        assert len(plain) == bins.count <= most


def test_toxicity_on_planted_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.filter(~F.lower("text").rlike("|".join(toxicity.LEXICON))).limit(60)
    planted = clean.select((F.col("doc_id") + 100_000).alias("doc_id"), F.concat("text", F.lit(" you worthless clown")).alias("text"))
    both = clean.select("doc_id", "text").union(planted)
    labels = both.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") >= 100_000).cast("int").alias("toxic"))
    scored = toxicity.score(both, toxicity.train(both, labels)).collect()
    assert len(scored) == 120 and all((r.doc_id >= 100_000) == (r.predicted == 1) for r in scored)


def test_toxicity_never_learns_from_held_out_rows(spark):
    rows = [(i, f"plain text number {i} " + ("grumblefink " * 2 if zlib.crc32(str(i).encode()) % 5 == 0 else ""), "") for i in range(400)]
    docs = awkward(spark, rows)
    labels = docs.select("doc_id", F.contains("text", F.lit("grumblefink")).cast("int").alias("toxic"))
    assert "grumblefink" not in toxicity.train(docs, labels).words
    everywhere = awkward(spark, [(i, f"plain text {i}" + (" grumblefink" if i % 7 == 0 else ""), "") for i in range(400)])
    marks = everywhere.select("doc_id", F.contains("text", F.lit("grumblefink")).cast("int").alias("toxic"))
    assert "grumblefink" in toxicity.train(everywhere, marks).words


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(5)
    truth = rng.random(5000) < 0.15
    votes = np.stack([np.where(truth, rng.random(5000) < p, rng.random(5000) < q) for p, q in
                      ((0.8, 0.02), (0.7, 0.01), (0.6, 0.02), (0.5, 0.01))], axis=1).astype(float)
    votes = np.concatenate([votes, votes[:, :1]], axis=1)  # a copy of a voter says nothing new
    belief = toxicity.label_model(votes, 0.1)
    assert ((belief > 0.5) == truth).mean() > 0.95


def test_toxicity_of_awkward_rows(spark):
    none = spark.createDataFrame([(None, None), (1, None), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train(awkward(spark), none)
    scored = toxicity.score(awkward(spark), model, keep=("lang",)).collect()
    assert len(scored) == len(DOCS) and all(0 <= r.score <= 1 and r.predicted == 0 for r in scored)
    assert toxicity.score(awkward(spark, [(1, "you idiot", "")]), model).first().predicted == 1
    assert toxicity.score(empty(spark), toxicity.train(empty(spark), none)).count() == 0


ITEMS = [(1, "If Anna buys 12 apples and 7 pears for 3 euros each, how much money does Anna spend on fruit in total today?"),
         (2, "A train drives 120 km in 2 hours and then 60 km in 1 hour, what is its average speed over the whole way?"),
         (3, None), (4, ""), (5, "what is love"), (6, "12 13 14 15 16 17 18"), (2, "A train drives 120 km in 2 hours and then 60 km in 1 hour, what is its average speed over the whole way?")]


def test_decontamination_by_templates_and_slots(spark):
    pad = "some ordinary words stand here before and after the question "
    rows = [
        (1, pad + ITEMS[0][1] + pad, ""), (2, pad + ITEMS[0][1].replace("Anna", "Bert").replace("12", "45").replace("3", "9") + pad, ""),
        (3, pad + ITEMS[0][1].replace("Anna spend", "Carla spend") + pad, ""),  # one name became two
        (4, pad + "A train drives 90 miles in 3 hours and then 40 miles in 2 hours, what is its average speed over the whole way?", ""),
        (5, "If Anna buys 12 apples. " + pad, ""), (6, "tell me what is love and why", ""), (7, None, ""),
        (8, ITEMS[1][1], ""), (8, ITEMS[1][1], ""), (None, ITEMS[1][1].upper(), ""), (9, "20 21 22 23 24 25 26", ""),
        (10, (pad + ITEMS[1][1] + " ") * 500, "")]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("key", F.lit("clash"))
    found = decontaminate.contaminated(awkward(spark, rows), bench).collect()
    got = {(r.doc_id, r.item_id): r for r in found}
    assert set(got) >= {(1, 1), (2, 1), (4, 2), (8, 2), (10, 2), (None, 2)}
    assert {k for k in got if k[0] in (5, 7, 9)} == set() and got[1, 1].verbatim and not got[2, 1].verbatim
    assert got[1, 1].coverage > 0.9 and (3, 1) not in got
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(awkward(spark, rows), bench.filter("false")).count() == 0


def test_decontamination_of_names_that_open_sentences(spark):
    bench = spark.createDataFrame([(1, "Tom has 5 apples. Anna has 3 pears. Bob has 7 plums. How many fruits are there?"),
                                   (2, "Maria sells red paper boats")], "item_id long, text string")
    rows = [(1, "Max has 8 apples. Lena has 2 pears. Jon has 4 plums. How many fruits are there?", ""),
            (2, "Max has 8 apples. Max has 2 pears. Max has 4 plums. Who many fruits are there?", ""),
            (3, "we saw that Maria sells red paper boats here", ""), (4, "WE SAW MARIA SELLS RED PAPER BOATS", "")]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(awkward(spark, rows), bench).collect()}
    assert {(1, 1), (3, 2), (4, 2)} <= set(got) and not got[1, 1].verbatim and got[3, 2].verbatim


def test_decontamination_finds_items_without_ordinary_words_verbatim(spark):
    items = ["Compute 12 + 35 * 4", "12 13 14 15 16 17 18", "3 4\n5 6\n7 8", "Anna, Bert, Carla, Dora, Emil, Franz"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(i, f"some words 11 {t} 19 and more", "") for i, t in enumerate(items)]
    rows += [(10, "Compute 13 + 35 * 4", ""), (11, "22 23 24 25 26 27 28", "")]
    found = decontaminate.contaminated(awkward(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in range(4)} and all(r.verbatim for r in found)


def test_verbatim_decontamination_equals_plain(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    grams = defaultdict(set)
    size = {}
    for r in bench.collect():
        w = words(r.text)
        size[r.item_id] = len(w) - 4
        for k in range(len(w) - 4):
            grams[tuple(w[k:k + 5])].add((r.item_id, k))
    want = set()
    for r in docs.collect():
        w, hit = words(r.text), defaultdict(set)
        for k in range(len(w) - 4):
            for item, at in grams.get(tuple(w[k:k + 5]), ()):
                hit[item].add(at)
        want |= {(r.doc_id, i) for i, s in hit.items() if len(s) / size[i] >= 0.5}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == want and want


def test_pipeline_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, apply in corpus_pipeline.STAGES:
        out = corpus_pipeline.stage(apply(spark, docs, SF))
        rows = out.collect()
        if name == "best-fit packing":
            assert {r.doc_id for r in rows} == set(before)
            check_layout(rows)
            break
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in rows}
        if name == "toxicity":
            insults = set(toxicity.LEXICON)
            assert set(after) == {i for i, t in before.items() if not insults & set(words(t))}
        if name == "line dedup":
            key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
            seen = Counter(k for t in before.values() for k in {key(x) for x in t.split("\n")})
            assert after == {i: "\n".join(x for x in t.split("\n") if not key(x) or seen[key(x)] < 10) for i, t in before.items()}
            assert all(r.n_chars == len(r.text) for r in rows)
        if name == "MinHash near-dedup":
            assert after == {i: before[i] for i in set(classes(before).values())}
        if name == "benchmark decontamination":
            def leaks(text):
                grams = {tuple(w[k:k + 5]) for w in [words(text)] for k in range(len(w) - 4)}
                return any(sum(tuple(w[k:k + 5]) in grams for k in range(len(w) - 4)) >= 0.5 * (len(w) - 4) for w in bench)
            assert after == {i: t for i, t in before.items() if not leaks(t)}
        docs, before = out, after


@pytest.mark.parametrize("rows", [DOCS, []])
def test_pipeline_survives_awkward_rows(spark, rows):
    docs = awkward(spark, rows or DOCS)
    docs = docs if rows else docs.filter("false")
    for _, apply in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(apply(spark, docs, SF))
    got = docs.collect()
    assert bool(got) == bool(rows) and (not rows or {1, 10, 9} <= {r.doc_id for r in got})

