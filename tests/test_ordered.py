import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from shotloom.operators import ordered as O


def _rows(spark, n=200):
    rng = random.Random(1)
    # One group holds most of the rows.
    rows = [("hot" if rng.random() < 0.7 else rng.choice("ab"), i, rng.randint(0, 9)) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, pos long, v long")


def _dense(spark):
    df = _rows(spark)
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("pos")) - 1)


def _same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_rank_in_group_equals_row_number(spark):
    df = _rows(spark)
    got = O.rank_in_group(df, ["g"], [F.col("pos")], F.floor(F.col("pos") / 7), "r").select("g", "pos", "r")
    w = Window.partitionBy("g").orderBy("pos")
    _same(got, df.select("g", "pos", (F.row_number().over(w) - 1).cast("long").alias("r")))


def test_neighbours_cross_chunk_edges(spark):
    df = _dense(spark)
    got = O.neighbours(df, ["g"], "pos", ["v"], chunk=5).select("g", "pos", "prev_v", "next_v")
    w = Window.partitionBy("g").orderBy("pos")
    _same(got, df.select("g", "pos", F.lag("v").over(w).alias("prev_v"), F.lead("v").over(w).alias("next_v")))


def test_running_sum_and_max(spark):
    df = _rows(spark)
    for fn, agg in (("sum", F.sum), ("max", F.max)):
        for inclusive in (True, False):
            got = O.running(df, ["g"], "pos", F.col("v"), "x", fn, 6, inclusive).select("g", "pos", "x")
            w = Window.partitionBy("g").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
            want = agg("v").over(w)
            _same(got, df.select("g", "pos", (F.coalesce(want, F.lit(0)) if fn == "sum" else want).alias("x")))


def test_attach_stats_keeps_rows_once(spark):
    df = _rows(spark)
    stats = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    assert O.attach_stats(df, stats, ["g"]).count() == df.count()


def test_first_per_key_and_limit_by_hash(spark):
    df = _rows(spark)
    first = {r["g"]: r["pos"] for r in O.first_per_key(df, ["g"], ["pos"], ["v"]).collect()}
    want = {r["g"]: r["p"] for r in df.groupBy("g").agg(F.min("pos").alias("p")).collect()}
    assert first == want
    key = O.hash_order(F.lit(3), F.col("pos"))
    assert O.limit_by_hash(df, 10, key).collect() == O.limit_by_hash(df, 10, key).collect()
    assert O.limit_by_hash(df, 0, key).count() == df.count()


def test_long_limits_are_cut_at_their_rank(spark, monkeypatch):
    df = _rows(spark)
    key = O.hash_order(F.lit(3), F.col("pos"))
    short = [r["pos"] for r in O.limit_by_hash(df, 20, key).collect()], [r["pos"] for r in O.first_rows(df, 20, "pos").collect()]
    long = [r["pos"] for r in O.limit_by_hash(df, 20, key).collect()], [r["pos"] for r in O.first_rows(df, 20, "pos").collect()]
    assert list(map(sorted, short)) == list(map(sorted, long))


def test_ranks_by_range_with_a_shared_prefix_and_one_odd_name(spark):
    names = [f"segment_{i:05d}.mp4" for i in range(3000)] + ["Z.mp4"]
    random.Random(2).shuffle(names)
    rows = [(f"d{i % 2}", n) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "g string, name string")
    ranked = O.rank_by_range(df, [F.col("name")], "r")
    assert [(r["name"], r["r"]) for r in ranked.orderBy("r").collect()] == [(n, i) for i, n in enumerate(sorted(names))]
    got = {(r["g"], r["name"]): r["r"] for r in O.rank_by_text(df, ["g"], ["name"], "r").collect()}
    want = {(g, n): i for g in ("d0", "d1") for i, n in enumerate(sorted(n for h, n in rows if h == g))}
    assert got == want


def test_first_keys_and_first_rows(spark):
    df = spark.range(2000).select((F.col("id") % 500).alias("k"), "id")
    kept = O.first_keys(df, 40, ["k"], [F.md5(F.col("k").cast("string"))])
    order = sorted(range(500), key=lambda k: __import__("hashlib").md5(str(k).encode()).hexdigest())
    assert {r["k"] for r in kept.collect()} == set(order[:40]) and kept.count() == 160
    assert O.first_keys(df, 0, ["k"], []).count() == 2000
    assert sorted(r["id"] for r in O.first_rows(df, 70, "id").collect()) == list(range(70))
    assert O.first_rows(df.filter("false"), 5, "id").count() == 0
