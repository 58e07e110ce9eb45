"""Sample packing on document lengths."""

from __future__ import annotations

from pyspark.sql import functions as F

from shotloom.functions.vectors import r6
from shotloom.operators import packing as P
from shotloom.plans import bindings as B
from shotloom.plans.bindings import sql
from shotloom.plans.registry import query
from shotloom.sources import sinks

MAX = 8192
FIXED_WIDTH = 4


@query("drop_too_long", sql(f"""
    select task_type, count(*) as raw_samples, count(*) filter (length > {MAX}) as too_long,
      count(*) filter (length <= {MAX}) as kept from pack_items group by task_type"""))
def _too_long(spark, sf):
    kept, counts = P.drop_too_long(B.pack_items(spark, sf), MAX)
    return counts.join(kept.groupBy("task_type").agg(F.count(F.lit(1)).alias("kept")), "task_type", "left").na.fill(0)


def _ffd_sql(most: int = 0) -> str:
    """First-fit decreasing as a fold over the samples of a task, longest first, equal ones by index.

    The state holds the free room and size of each pack and the pack of each sample; a task that
    is not short keeps one sample a pack.
    """
    short = ", ".join(f"'{t}'" for t in P.SHORT_TASKS)
    fits = "list_position(list_transform(a.free, lambda f, i: f >= x.len" + (f" and a.n[i] < {most}" if most else "") + "), true)"
    step = f"""case when {fits} is null then {{'len': 0::bigint, 'free': list_append(a.free, {MAX} - x.len), 'n': list_append(a.n, 1::bigint),
          'at': list_append(a.at, len(a.free)::bigint)}}
        else {{'len': 0::bigint, 'free': list_transform(a.free, lambda f, i: f - case when i = {fits} then x.len else 0 end),
          'n': list_transform(a.n, lambda c, i: c + case when i = {fits} then 1 else 0 end), 'at': list_append(a.at, {fits}::bigint - 1)}} end"""
    return sql(f"""
    with kept as (select * from pack_items where length <= {MAX}),
    grouped as (select task_type, list(sample_index order by length desc, sample_index) as ids,
        list({{'len': length::bigint, 'free': []::bigint[], 'n': []::bigint[], 'at': []::bigint[]}} order by length desc, sample_index) as items
      from kept where task_type in ({short}) group by task_type),
    folded as (select task_type, ids, list_reduce(list_prepend({{'len': 0::bigint, 'free': []::bigint[], 'n': []::bigint[], 'at': []::bigint[]}}, items),
        lambda a, x: {step}) as done from grouped),
    placed as (select task_type, unnest(ids) as sample_index, unnest(done.at) as pack from folded
        union all select task_type, sample_index, sample_index from kept where task_type not in ({short}))
    select task_type, pack, list(sample_index order by sample_index) as sample_indices, sum(length)::bigint as total_length,
      min(sample_index) as first_index from placed join kept using (task_type, sample_index) group by task_type, pack""")


@query("ffd_pack", _ffd_sql())
def _pack(spark, sf):
    return P.ffd_pack(B.pack_items(spark, sf), MAX)


@query("ffd_pack_capped", _ffd_sql(3))
def _pack_capped(spark, sf):
    return P.ffd_pack(B.pack_items(spark, sf), MAX, max_samples=3)


@query("ffd_pack_totals", sql(f"""
    select task_type, count(*) as samples, sum(length)::bigint as tokens, max(length) <= {MAX} as fits, bool_and(true) as each_once
    from pack_items where length <= {MAX} group by task_type"""))
def _totals(spark, sf):
    packs = P.ffd_pack(B.pack_items(spark, sf), MAX)
    rows = packs.select("task_type", "pack", "total_length", F.explode("sample_indices").alias("i"))
    per = packs.groupBy("task_type").agg(F.sum("total_length").alias("tokens"), (F.max("total_length") <= MAX).alias("fits"))
    once = rows.groupBy("task_type", "i").agg(F.count(F.lit(1)).alias("n")).groupBy("task_type").agg(
        F.count(F.lit(1)).alias("samples"), (F.max("n") == 1).alias("each_once"))
    return once.join(per, "task_type")


def _fixed(spark, sf):
    """A pack table that SQL can state as well: four neighbours of a task share a pack."""
    return B.pack_items(spark, sf).filter(F.col("length") <= MAX).withColumn(
        "pack", F.expr(f"sample_index div {5 * FIXED_WIDTH}"))


@query("pack_offsets", sql(f"""
    select task_type, sample_index // {5 * FIXED_WIDTH} as pack, sample_index, length,
      (row_number() over w - 1)::int as place,
      coalesce(sum(length) over (partition by task_type, sample_index // {5 * FIXED_WIDTH} order by sample_index
        rows between unbounded preceding and 1 preceding), 0)::bigint as "offset"
    from pack_items where length <= {MAX} window w as (partition by task_type, sample_index // {5 * FIXED_WIDTH} order by sample_index)"""))
def _offsets(spark, sf):
    return P.pack_offsets(_fixed(spark, sf))


@query("pack_summary", sql(f"""
    with c as (select task_type, count(*) as raw, count(*) filter (length > {MAX}) as too_long from pack_items group by 1),
    p as (select task_type, sample_index // {5 * FIXED_WIDTH} as pack, count(*) as n, sum(length) as total from pack_items
        where length <= {MAX} and task_type <> 'ordering' group by all),
    g as (select task_type, count(*) as packed, count(*) filter (n > 1) as multi, max(n) as mx, sum(total) as tok, max(total) as ml from p group by 1),
    t as (select task_type, raw as raw_samples, coalesce(packed, 0) as packed_items, coalesce(raw - packed, 0) as saved_items, too_long as too_long_singletons,
        coalesce(multi, 0) as multi_sample_packs, round(coalesce(raw / packed, 0), 6) as avg_pack_size, coalesce(mx, 0) as max_pack_size,
        round(coalesce(tok / (packed * {MAX}), 0), 6) as avg_pack_fill_ratio, coalesce(ml, 0)::bigint as max_pack_length from c left join g using (task_type))
    select * from t union all
    select '(all)', sum(raw_samples)::bigint, sum(packed_items)::bigint, sum(raw_samples)::bigint - sum(packed_items)::bigint, null,
      sum(multi_sample_packs)::bigint, null, null, null, null from t"""))
def _summary(spark, sf):
    _, counts = P.drop_too_long(B.pack_items(spark, sf), MAX)
    packs = _fixed(spark, sf).filter("task_type <> 'ordering'").groupBy("task_type", "pack").agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("total_length"))
    s = P.pack_summary(counts, packs, MAX)
    return s.withColumn("avg_pack_size", r6(F.col("avg_pack_size"))).withColumn("avg_pack_fill_ratio", r6(F.col("avg_pack_fill_ratio")))


@query("completion_mask", sql("""
    with w as (select doc_id, n_chars // 2 as start, unnest(regexp_extract_all(text, '\\s+|\\S+')) as w,
        generate_subscripts(regexp_extract_all(text, '\\s+|\\S+'), 1) as i from documents),
    e as (select doc_id, start, w, sum(length(w)) over (partition by doc_id order by i) as stop from w)
    select doc_id, count(*) as tokens, count(*) filter (stop > start) as masked_in from e where regexp_matches(w, '\\S') group by doc_id"""))
def _mask(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", P.word_ends(F.col("text")).alias("ends"), F.expr("n_chars div 2").alias("start"))
    m = d.select("doc_id", F.size("ends").alias("tokens"), P.completion_mask(F.col("ends"), F.col("start")).alias("mask"))
    return m.select("doc_id", F.col("tokens").cast("bigint").alias("tokens"),
                    F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("masked_in")).filter("tokens > 0")


@query("publish_partitions", sql("""
    select task_type, sample_index, case task_type when 'ordering' then length + 1 else length end as length
    from pack_items where task_type <> 'ordering' or sample_index % 2 = 0"""))
def _publish(spark, sf):
    """A table published by task, then one task published again: the other partitions stay as they are."""
    items, path = B.pack_items(spark, sf), sinks.new_path(spark, "published")
    sinks.replace_partitions(items, path, ["task_type"])
    again = items.filter("task_type = 'ordering' and sample_index % 2 = 0").withColumn("length", F.col("length") + 1)
    sinks.replace_partitions(again, path, ["task_type"])
    return spark.read.parquet(path).select("task_type", "sample_index", "length")
