"""Hard-negative mining, stratified sampling, presample tables and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotloom.functions import vectors as V
from shotloom.functions.vectors import r6
from shotloom.operators import negatives as N
from shotloom.operators.ordered import first_per_key
from shotloom.plans import bindings as B
from shotloom.plans.bindings import sql
from shotloom.plans.registry import query
from shotloom.sources import sinks
from shotloom.session import stage

SEED = 7
TOPK = 5


def _mined_sql(topk: int, extra: str = "") -> str:
    return f"""
    sims as (select a.shot_id as anchor, b.shot_id as neg, a.drama, ROUND(list_dot_product(a.img, b.img) * 1e7)::bigint as q
        from imgs a join imgs b on a.drama = b.drama and a.shot_id <> b.shot_id {extra}),
    limits as (select anchor, quantile_cont(q::double, 0.9) as top from sims group by anchor),
    mined as (select * from (select anchor, neg, q, row_number() over (partition by anchor order by q desc, neg)::int as rank
        from sims join limits using (anchor) where q < top) where rank <= {topk})"""


def _mined(spark, sf, topk=TOPK, **kw):
    return N.mine_hard_negatives(N.image_vectors(B.shots(spark, sf)), topk=topk, **kw)


@query("mine_hard_negatives", sql(f"with {_mined_sql(50)} select anchor, neg, q, rank from mined"))
def _mine(spark, sf):
    return _mined(spark, sf, 50)


@query("mine_hard_negatives_other_episode", sql(
    f"with {_mined_sql(TOPK, 'and a.episode <> b.episode')} select anchor, neg, q, rank from mined"))
def _mine_other(spark, sf):
    return _mined(spark, sf, exclude_same_episode=True)


@query("hard_negative_stats", sql(f"""with {_mined_sql(TOPK)}
    select count(*) as anchors, count(n) as with_negatives, round(avg(coalesce(n, 0)), 6) as avg_negatives,
      round(avg(top / 1e7), 6) as top1_similarity, count(n) as same_drama
    from shots left join (select anchor, count(*) as n, max(q) as top from mined group by anchor) on anchor = shot_id"""))
def _stats(spark, sf):
    s = stage(B.shots(spark, sf))
    stats = N.hard_negative_stats(s, N.mine_hard_negatives(N.image_vectors(s), topk=TOPK))
    return stats.withColumns({c: r6(F.col(c)) for c in ("avg_negatives", "top1_similarity")})


@query("export_hard_negatives", sql(f"""with {_mined_sql(TOPK)}
    select anchor, '["' || string_agg(neg, '","' order by rank) || '"]' as negs from mined group by anchor"""))
def _export(spark, sf):
    return sinks.hard_negative_documents(_mined(spark, sf)).select("anchor", F.to_json("negs").alias("negs"))


@query("load_hard_negatives", sql(f"""with {_mined_sql(TOPK)},
    raw as (select anchor, rank - 1 as rank, neg from mined
        union all select anchor, 100, anchor from mined where rank = 1
        union all select anchor, 101, 'gone|0|0' from mined where rank = 1)
    select anchor, rank::int as rank, neg from raw where neg <> anchor and neg in (select shot_id from shots)"""))
def _load(spark, sf):
    s = stage(B.shots(spark, sf))
    docs = sinks.hard_negative_documents(N.mine_hard_negatives(N.image_vectors(s), topk=TOPK))
    spoiled = docs.select("anchor", F.concat("negs", F.array("anchor", F.lit("gone|0|0"))).alias("negs"))
    text = spoiled.select(F.to_json(F.create_map("anchor", "negs")).alias("doc"))
    parsed = text.select(F.explode(F.from_json("doc", "map<string,array<string>>")).alias("anchor", "negs"))
    return N.load_hard_index(parsed, s)


# ---------------------------------------------------------------- sampling

LAID = """
    eps as (select drama, episode, count(*) as e_n, min(p) as e_start from laid0 group by all),
    drs as (select drama, count(*) as d_n, min(p) as d_start from laid0 group by all),
    laid0 as (select shot_id, drama, episode, shot_index, row_number() over (order by drama, episode, shot_index) - 1 as p
        from shots),
    laid as (select l.*, e_n, e_start, d_n, d_start, (select count(*) from shots) as total,
        p - (select count(*) from laid0 x where x.drama = l.drama and x.episode = l.episode
             and x.shot_index between l.shot_index - 5 and l.shot_index - 1) as w_start,
        (select count(*) from laid0 x where x.drama = l.drama and x.episode = l.episode
             and x.shot_index between l.shot_index - 5 and l.shot_index + 5) as w_n
        from laid0 l join eps using (drama, episode) join drs using (drama))"""


def _draw_sql(name: str, tier: str, k: str) -> str:
    start, n, gap, gap_n = N.POOLS[tier]
    gap = "p" if gap == "pos" else gap

    def hashed(mark: str, x: str) -> str:
        return f"('0x' || substr(md5('{SEED}|{tier}|{mark}|' || shot_id || '|' || {x}), 1, 15))::bigint"

    at = f"({hashed('try', 'x[1]')} % (x[1] + 1))"
    return f"""
    {name} as (select anchor, '{tier}' as tier, draw, t.shot_id as neg from (
        select anchor, draw, base + j + case when base + j >= gap then gap_n else 0 end as pos from (
          select *, shot_id as anchor, row_number() over (partition by shot_id order by {hashed('order', 'j')}, j) - 1 as draw from (
            select *, unnest(list_reduce(list_prepend([]::bigint[], list_transform(range(m - kk, m), lambda x: [x])),
                lambda a, x: list_append(a, case when list_contains(a, {at}) then x[1] else {at} end))) as j from (
              select *, least({k}, m) as kk from (
                select shot_id, {start or 0} as base, {gap} as gap, {gap_n or 1} as gap_n, {n} - {gap_n or 1} as m,
                  l.* exclude (shot_id) from laid l)) where kk > 0)))
        join laid t on t.p = pos)"""


def _laid_first(text: str) -> str:
    """Order the layout CTEs so that each follows what it reads."""
    parts = LAID.split("laid0 as", 1)
    head, tail = parts[0], "laid0 as" + parts[1]
    base, rest = tail.split("laid as", 1)
    return f"with {base.rstrip().rstrip(',')}, {head.strip().rstrip(',')}, laid as{rest}, {text}"


def _pool_query(name: str, tier: str, k: int):
    @query(name, sql(_laid_first(f"{_draw_sql('d', tier, str(k))} select anchor, tier, draw::int as draw, neg from d")))
    def _run(spark, sf):
        return N.sample_pool(B.shots(spark, sf), tier, k, seed=SEED)


_pool_query("neg_pool_windowed", "windowed", 9)
_pool_query("neg_pool_cross_episode", "cross_episode", 9)
_pool_query("neg_sample_cross_drama", "cross_drama", 9)

INFONCE_N = 27


def _infonce_sql(n: int, n_max: int, name: str = "infonce") -> str:
    per = n // 3
    k1, k2 = f"least({per}, e_n - w_n)", f"least({per}, d_n - e_n)"
    k3 = f"least({n} - {k1} - {k2}, total - d_n)"
    return f"""
    {_draw_sql(name + '1', 'windowed', str(n_max // 3))}, {_draw_sql(name + '2', 'cross_episode', str(n_max // 3))},
    {_draw_sql(name + '3', 'cross_drama', str(n_max))},
    {name} as (select anchor, tier, draw::int as draw, neg, ({n} - {k1} - {k2} - {k3})::int as short_by
        from (select * from {name}1 union all select * from {name}2 union all select * from {name}3) d
        join laid l on l.shot_id = d.anchor
        where draw < case tier when 'windowed' then {k1} when 'cross_episode' then {k2} else {k3} end)"""


@query("sample_infonce_negatives", sql(_laid_first(
    f"{_infonce_sql(INFONCE_N, INFONCE_N)} select anchor, tier, draw, neg, short_by from infonce")))
def _infonce(spark, sf):
    return N.sample_infonce_negatives(B.shots(spark, sf), INFONCE_N, seed=SEED)


def _hard_sql(k: int) -> str:
    return f"""
    {_draw_sql('same', 'same_drama', str(2 * k))}, {_draw_sql('far', 'cross_drama', f"case when d_n - 1 < {k} then {2 * k} else 0 end")},
    hard_all as (select anchor, neg, 0 as t, row_number() over (partition by anchor order by
          md5('{SEED}|' || anchor || '|' || neg), neg) - 1 as draw from mined
        union all select anchor, neg, 1, draw from same union all select anchor, neg, 2, draw from far),
    hard_once as (select anchor, neg, min(row(t, draw)) as o from hard_all group by anchor, neg),
    hard as (select *, ({k} - count(*) over (partition by anchor))::int as short_by from (
        select anchor, (row_number() over (partition by anchor order by o))::int as rank, neg,
          case o[1] when 0 then 'listed' when 1 then 'same_drama' else 'cross_drama' end as tier from hard_once) where rank <= {k})"""


@query("sample_hard_negatives", sql(_laid_first(
    f"{_mined_sql(TOPK)}, {_hard_sql(8)} select anchor, rank, neg, tier, short_by from hard")))
def _hard(spark, sf):
    s = stage(B.shots(spark, sf))
    return N.sample_hard_negatives(s, N.mine_hard_negatives(N.image_vectors(s), topk=TOPK), 8, SEED)


def _presample(spark, sf):
    s = stage(B.shots(spark, sf))
    hard = stage(N.mine_hard_negatives(N.image_vectors(s), topk=TOPK))
    return s, N.presample_grid(s, hard, (4, 8), (9, 18), seed=SEED, done=[(8, 18)])


PRESAMPLE = _laid_first(f"""{_mined_sql(TOPK)}, {_hard_sql(8)}, {_infonce_sql(9, 18, 'a')}, {_infonce_sql(18, 18, 'b')},
    soft as (select 9 as n, * from a union all select 18, * from b),
    softr as (select n, anchor, neg, (row_number() over (partition by n, anchor order by
        case tier when 'windowed' then 0 when 'cross_episode' then 1 else 2 end, draw))::int as rank from soft),
    combos as (select unnest([4, 4, 8]) as num_neg, unnest([9, 18, 9]) as infonce_neg),
    pre as (select anchor, num_neg, infonce_neg, 'hard' as kind, rank, neg from hard join combos on rank <= num_neg
        union all select anchor, num_neg, infonce_neg, 'infonce', rank, neg from softr join combos on n = infonce_neg)""")


@query("presample_grid", sql(PRESAMPLE + " select * from pre"))
def _grid(spark, sf):
    return _presample(spark, sf)[1]


@query("export_presample", sql(PRESAMPLE + """
    select num_neg, infonce_neg, kind, count(*) as n, count(distinct anchor) as anchors from pre group by all"""))
def _export_presample(spark, sf):
    back = sinks.write_presample(_presample(spark, sf)[1])
    return back.groupBy("num_neg", "infonce_neg", "kind").agg(F.count(F.lit(1)).alias("n"),
                                                              F.countDistinct("anchor").alias("anchors"))


@query("assemble_training_rows", sql(PRESAMPLE + """,
    v as (select anchor, kind, count(*) as n, sum(s.depth[1]) as d, arg_min(s.text[1], rank) as t
        from pre join shots s on s.shot_id = neg where num_neg = 4 and infonce_neg = 9 group by all)
    select s.shot_id as anchor, round(s.depth[1], 6) as own_depth, coalesce(h.n, 0) as n_hard, coalesce(i.n, 0) as n_infonce,
      round(h.d, 6) as hard_depth, round(i.t, 6) as first_text
    from shots s left join v h on h.anchor = s.shot_id and h.kind = 'hard'
      left join v i on i.anchor = s.shot_id and i.kind = 'infonce'"""))
def _assemble(spark, sf):
    s, pre = _presample(spark, sf)
    rows = N.assemble_training_rows(s, pre.filter("num_neg = 4 and infonce_neg = 9"))
    depth = F.aggregate("hard_depth", F.lit(0.0), lambda acc, x: acc + x[0])
    return rows.select("anchor", V.r6(F.col("depth")[0]).alias("own_depth"), F.size("hard_depth").alias("n_hard"),
                       F.size("infonce_depth").alias("n_infonce"), V.r6(depth).alias("hard_depth"),
                       V.r6(F.col("infonce_text")[0][0]).alias("first_text"))


@query("dedupe_keep_first", sql("""
    select source, arg_min(doc_id, doc_id) as doc_id, arg_min(text, doc_id) as text from documents group by source, md5(text)"""))
def _dedupe(spark, sf):
    d = B.table(spark, sf, "documents").select("source", F.md5("text").alias("fp"), "doc_id", "text")
    return first_per_key(d, ["source", "fp"], ["doc_id"], ["text"]).drop("fp")


# ---------------------------------------------------------------- splits

def _split(spark, sf):
    return N.random_split(B.shots(spark, sf).select("shot_id", "drama"), "shot_id", 0.1, 0.2, SEED)


SPLIT = f"""ranked as (select shot_id, drama, row_number() over (order by md5('{SEED}|' || shot_id)) - 1 as r,
        count(*) over () as n from shots),
    split as (select shot_id, drama, r, case when r < greatest(1, floor(n * 0.1)) then 'test'
        when r < greatest(1, floor(n * 0.1)) + greatest(1, floor(n * 0.2)) then 'val' else 'train' end as split from ranked)"""


@query("random_split", sql(f"with {SPLIT} select shot_id, split from split"))
def _random_split(spark, sf):
    return _split(spark, sf).select("shot_id", "split")


@query("split_counts", sql(f"with {SPLIT} select split, count(*) as n from split group by split"))
def _split_counts(spark, sf):
    return _split(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("corpus_distribution", sql(f"""with {SPLIT},
    eps as (select s.split, x.drama, x.episode, count(*) as frames from shots x join split s using (shot_id) group by all)
    select split, sum(eps)::bigint as episodes, sum(frames)::bigint as frames, min(eps) as min_episodes, max(eps) as max_episodes
    from (select split, drama, count(*) as eps, sum(frames) as frames from eps group by all) group by split"""))
def _distribution(spark, sf):
    from shotloom.operators.metrics import corpus_distribution
    s = B.shots(spark, sf).select("shot_id", "drama", "episode")
    return corpus_distribution(s.join(_split(spark, sf).select("shot_id", "split"), "shot_id"))
