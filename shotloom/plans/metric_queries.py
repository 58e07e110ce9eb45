"""Recall, losses, leaderboards, run logs and model scores."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from shotloom.functions import text as X
from shotloom.functions import vectors as V
from shotloom.operators import metrics as M
from shotloom.operators import negatives as N
from shotloom.operators.ordered import hash_int
from shotloom.operators.scoring import score_two_tower
from shotloom.plans import bindings as B
from shotloom.plans.bindings import BATCH, sql
from shotloom.plans.negative_queries import SEED, _infonce_sql, _laid_first, _mined_sql
from shotloom.plans.registry import query
from shotloom.plans.text_queries import WEAK
from shotloom.session import stage
from shotloom.sources import sinks

TAU = 0.07
KS = (1, 5, 10, 20)


def _pairs(spark, sf, image="depth"):
    s = B.shots(spark, sf)
    img = V.fuse_mean(F.col("depth"), F.col("pose")) if image == "mean" else F.col(image)
    return s.select(F.floor(F.col("vec_id") / BATCH).alias("batch"), F.col("shot_id").alias("id"), "text", img.alias("image"))


def _recall_sql(image: str) -> str:
    return sql(f"""
    with u as (select vec_id // {BATCH} as batch, shot_id as id,
        list_transform(text, lambda x: x / greatest(sqrt(list_dot_product(text, text)), 1e-12)) as t,
        list_transform({image}, lambda x: x / greatest(sqrt(list_dot_product({image}, {image})), 1e-12)) as i from imgs),
    q as (select a.id, b.id as other, ROUND(list_dot_product(a.t, b.i) * 1e7) as q from u a join u b using (batch)),
    r as (select p.id, p.q as pos, 1 + count(*) filter (o.other <> p.id and (o.q > p.q or (o.q = p.q and o.other < p.id))) as rank
        from (select * from q where id = other) p join q o on o.id = p.id group by p.id, p.q)
    select count(*) as n, {', '.join(f'round(avg((rank <= {k})::int), 6) as recall_{k}' for k in KS)},
      round(avg(pos / 1e7), 6) as mean_pos_score from r""")


def _rounded(df, skip=("n",)):
    return df.select(*[c if c in skip else V.r6(F.col(c)).alias(c) for c in df.columns])


@query("recall_at_k", _recall_sql("depth"))
def _recall(spark, sf):
    return _rounded(M.recall_at_k(_pairs(spark, sf), KS))


@query("recall_at_k_raw", _recall_sql("m"))
def _recall_raw(spark, sf):
    return _rounded(M.recall_at_k(_pairs(spark, sf, "mean"), KS))


UNIT = """u as (select shot_id, img as i, list_transform(text, lambda x: x / greatest(sqrt(list_dot_product(text, text)), 1e-8)) as t from imgs)"""


def _loss_sql(name: str, source: str) -> str:
    return f"""
    {name}_c as (select anchor, 't2i' as direction, list_dot_product(a.t, n.i) as sim, false as positive from {source} s
          join u a on a.shot_id = s.anchor join u n on n.shot_id = s.neg
        union all select anchor, 'i2t', list_dot_product(a.i, n.t), false from {source} s join u a on a.shot_id = s.anchor join u n on n.shot_id = s.neg
        union all select shot_id, d, list_dot_product(t, i), true from u, (values ('t2i'), ('i2t')) v(d)),
    {name} as (select anchor, direction, ln(sum(exp(sim / {TAU}::double))) - max(case when positive then sim / {TAU}::double end) as loss
        from {name}_c group by all)"""


def _unit_shots(spark, sf):
    s = stage(B.shots(spark, sf))
    unit = s.select("shot_id", V.l2_normalize(F.col("text")).alias("text"),
                    V.l2_normalize(V.fuse_mean(F.col("depth"), F.col("pose"))).alias("image"))
    return s, stage(unit)


def _hard_loss(s, unit):
    mined = N.mine_hard_negatives(N.image_vectors(s), topk=5).select("anchor", "neg")
    return M.contrastive_loss(M.negative_candidates(unit, mined), TAU)


@query("contrastive_loss", sql(f"with {_mined_sql(5)}, {UNIT}, {_loss_sql('hl', 'mined')} select anchor, direction, round(loss, 6) as loss from hl"))
def _loss(spark, sf):
    return _hard_loss(*_unit_shots(spark, sf)).withColumn("loss", V.r6(F.col("loss")))


@query("contrastive_loss_in_batch", sql(f"""
    with {UNIT}, b as (select vec_id // {BATCH} as batch, u.* from u join shots using (shot_id)),
    p as (select a.batch, a.shot_id, b.shot_id as other, list_dot_product(a.t, b.i) / {TAU}::double as ti, list_dot_product(a.i, b.t) / {TAU}::double as it
        from b a join b b using (batch)),
    l as (select batch, shot_id, ln(sum(exp(ti))) - max(case when shot_id = other then ti end) as lt,
        ln(sum(exp(it))) - max(case when shot_id = other then it end) as li from p group by all)
    select batch, count(*) as n, round((avg(lt) + avg(li)) / 2, 6) as loss from l group by batch"""))
def _in_batch(spark, sf):
    return M.in_batch_loss(_pairs(spark, sf, "mean"), TAU).withColumn("loss", V.r6(F.col("loss")))


@query("loss_report", sql(_laid_first(f"""{_mined_sql(5)}, {_infonce_sql(9, 9)}, {UNIT}, {_loss_sql('hl', 'mined')}, {_loss_sql('il', 'infonce')}
    select round((select avg(loss) from hl), 6) as hard_loss, round((select avg(loss) from il), 6) as infonce_loss,
      round(1.0::double * (select avg(loss) from il) + 0.5::double * (select avg(loss) from hl), 6) as total""")))
def _report(spark, sf):
    s, unit = _unit_shots(spark, sf)
    soft = N.sample_infonce_negatives(s, 9, seed=SEED).select("anchor", "neg")
    infonce = M.contrastive_loss(M.negative_candidates(unit, soft), TAU)
    return _rounded(M.loss_report(_hard_loss(s, unit), infonce, 0.5, 1.0), ())


@query("weak_label_bce", sql(f"""
    with p as (select {WEAK} as y, case sample_index % 50 when 0 then 0.0 when 1 then 1.0 else ('0x' || substr(md5(user_text), 1, 15))::bigint % 1000 / 1000.0 end::double as p
        from (select *, model_output as t from model_outputs))
    select count(*) as n, round(avg(-(y * case when p > 0 then greatest(ln(p), -100) else -100 end
      + (1 - y) * case when p < 1 then greatest(ln(1 - p), -100) else -100 end)), 6) as loss from p"""))
def _bce(spark, sf):
    m = B.model_outputs(spark, sf)
    p = (F.when(F.col("sample_index") % 50 == 0, 0.0).when(F.col("sample_index") % 50 == 1, 1.0)
         .otherwise((hash_int("user_text") % 1000) / 1000.0))
    rows = m.select(X.weak_label(F.col("model_output")).alias("y"), p.alias("p"))
    return rows.agg(F.count(F.lit(1)).alias("n"), V.r6(F.avg(M.bce(F.col("p"), F.col("y")))).alias("loss"))


@query("grid_leaderboard", sql("""
    select (row_number() over (order by metric desc, signature, seq))::int as rank, signature, seq, status, metric from runs where status = 'done'
    order by metric desc, signature, seq limit 10"""))
def _leaderboard(spark, sf):
    return M.grid_leaderboard(B.runs(spark, sf), "metric")


@query("append_runs", sql("select status, count(*) as n, round(sum(metric), 6) as total from runs group by status"))
def _append(spark, sf):
    path = sinks.new_path(spark, "runs")
    r = B.runs(spark, sf)
    columns = ["signature", "seq", "status", "metric"]
    sinks.append_runs(r.filter("status <> 'done'"), path, columns)
    log = sinks.append_runs(r.filter("status = 'done'"), path, columns)
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n"), V.r6(F.sum("metric")).alias("total"))


def weights(spark, sf, dim=64, hidden=16):
    """Stand-in model weights: entry i of a tensor is a hash of its name and i."""
    shapes = {}
    for tower in ("text", "depth", "pose"):
        shapes |= {f"{tower}.in.weight": (hidden, dim), f"{tower}.in.bias": (hidden,), f"{tower}.norm.weight": (hidden,),
                   f"{tower}.norm.bias": (hidden,), f"{tower}.out.weight": (hidden, hidden), f"{tower}.out.bias": (hidden,)}
    shapes |= {"fuse.qkv.weight": (3 * hidden, hidden), "fuse.qkv.bias": (3 * hidden,), "fuse.attn_out.weight": (hidden, hidden),
               "fuse.attn_out.bias": (hidden,), "fuse.norm.weight": (hidden,), "fuse.norm.bias": (hidden,),
               "fuse.out.weight": (hidden, hidden), "fuse.out.bias": (hidden,)}
    rows = [(name, list(shape), math.prod(shape)) for name, shape in shapes.items()]
    table = spark.createDataFrame(rows, "name string, shape array<int>, n int")
    value = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: (
        F.pmod(F.xxhash64(F.col("name"), i), F.lit(2001)) / 1000.0 - 1.0).cast("float"))
    return table.select("name", "shape", value.alias("vals"))


@query("score_two_tower")
def _score(spark, sf):
    s = B.shots(spark, sf).select(F.col("shot_id").alias("id"), "text", "depth", "pose")
    out = score_two_tower(s, weights(spark, sf))
    return out.select("id", F.round("score", 4).alias("score"), F.size("text_vec").alias("text_dim"), F.size("image_vec").alias("image_dim"))
