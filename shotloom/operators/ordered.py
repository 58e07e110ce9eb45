"""Ordered operators that never put one whole group into one task.

A window over a hot key (a third of all frames in one video) would run in a single
task.  Each operator here cuts the group into buckets that follow its order, works
inside (group, bucket), and carries what crosses the edge in a table with one row per
bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shotloom.session import stage

CHUNK = 65536


def attach_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str], salts: int = 16,
                 how: str = "inner") -> DataFrame:
    """Join one-row-per-group ``stats`` onto ``df``; a hot group is spread over ``salts`` join keys."""
    value_cols = [c for c in df.columns if c not in keys] or list(keys)
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*_hashable(df, value_cols)), F.lit(salts)).cast("int"))
    right = stats.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def _hashable(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Scalar columns only: hashing vectors or texts for a salt is wasted work."""
    simple = [f.name for f in df.schema.fields
              if f.name in names and f.dataType.typeName() not in ("array", "map", "struct", "variant")]
    return simple or list(names)


def rank_in_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], bucket: Column,
                  name: str) -> DataFrame:
    """0-based ``row_number`` within ``group``.

    ``bucket`` must not decrease along ``order``.  Ranks are taken inside (group, bucket)
    and shifted by the number of rows in the earlier buckets of the group.
    """
    group = list(group)
    part = [*group, "__b"]
    rows = df.withColumn("__b", bucket)
    local = F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1
    counts = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    return (rows.withColumn("__r", local).join(offsets, part)
            .withColumn(name, (F.col("__r") + F.col("__off")).cast("bigint"))
            .drop("__r", "__off", "__b"))


def rank_by_range(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """0-based rank over the whole table by ``order``, which should leave no ties.

    The sort deals rows to ranges whose bounds are sampled from the data, so neither a common prefix nor one
    odd key fills a task.  A row's place in its range comes with the sort; the ranges' sizes, one row per
    range, make the rest.  The sorted rows are written once, so that a task that runs again finds the same
    ranges: pass keys, not payload.
    """
    rows = stage(df.orderBy(*order).withColumn("__i", F.monotonically_increasing_id()))
    rows = rows.withColumns({"__p": F.shiftright("__i", 33), "__i": F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    # One row per range of the sort, whatever the data.
    return rows.join(F.broadcast(offsets), "__p").withColumn(name, F.col("__i") + F.col("__off")).drop("__i", "__off", "__p")


def rank_by_text(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """0-based rank within ``group`` by text columns: ranks of the whole table, less that of the group's first row."""
    ranked = rank_by_range(df, [*map(F.col, group), *map(F.col, order)], name)
    first = ranked.groupBy(*group).agg(F.min(name).alias("__first"))
    return attach_stats(ranked, first, group).withColumn(name, F.col(name) - F.col("__first")).drop("__first")


def neighbours(df: DataFrame, group: Sequence[str], pos: str, cols: Sequence[str],
               chunk: int = CHUNK) -> DataFrame:
    """Add ``prev_<c>`` and ``next_<c>`` for a dense integer ``pos``.

    Rows at a chunk edge are copied into the chunk next to it, so both windows stay inside a chunk.
    """
    here = F.floor(F.col(pos) / chunk)
    copies = F.array_distinct(F.array(here, F.floor((F.col(pos) - 1) / chunk), F.floor((F.col(pos) + 1) / chunk)))
    spread = df.withColumn("__c", F.explode(copies))
    w = Window.partitionBy(*group, "__c").orderBy(pos)
    out = spread.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in cols],
                        *[F.lead(c).over(w).alias(f"next_{c}") for c in cols])
    return out.filter(F.col("__c") == here).drop("__c")


def running(df: DataFrame, group: Sequence[str], pos: str, value: Column, name: str, fn: str = "max",
            chunk: int = CHUNK, inclusive: bool = True) -> DataFrame:
    """Running ``max`` or ``sum`` of ``value`` in ``pos`` order, up to each row (or up to the row before)."""
    group = list(group)
    part = [*group, "__c"]
    agg = {"max": F.max, "sum": F.sum}[fn]
    rows = df.withColumn("__c", F.floor(F.col(pos) / chunk)).withColumn("__v", value)
    w = Window.partitionBy(*part).orderBy(pos).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    per_chunk = rows.groupBy(*part).agg(agg("__v").alias("__cv"))
    before = Window.partitionBy(*group).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(*part, agg("__cv").over(before).alias("__in"))
    total = (F.greatest("__l", "__in") if fn == "max"
             else F.coalesce("__l", F.lit(0)) + F.coalesce("__in", F.lit(0)))
    return (rows.withColumn("__l", agg("__v").over(w)).join(carried, part)
            .withColumn(name, total).drop("__c", "__v", "__l", "__in"))


def running_last(df: DataFrame, group: Sequence[str], pos: str, value: Column, name: str,
                 chunk: int = CHUNK, inclusive: bool = True) -> DataFrame:
    """Largest non-null ``value`` so far; with a value that grows along ``pos`` this is the last one."""
    return running(df, group, pos, value, name, "max", chunk, inclusive)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """First row per key in ``order``; of equal ones that with the smallest payload.

    The winners are found on keys and order alone, so copies are dropped before the shuffle and
    no long payload is sorted; only the winners' payload is joined.
    """
    more = [c for c in payload if c not in order and c not in keys]
    low = F.min(order[0]) if len(order) == 1 else F.min(F.struct(*order))
    best = df.groupBy(*keys).agg(low.alias("__o"))
    wins = best.select(*keys, *[(F.col("__o") if len(order) == 1 else F.col("__o")[c]).alias(c) for c in order])
    if not more:
        return wins
    names = [*keys, *order]
    named = wins.select(*[F.col(c).alias(f"__{c}") for c in names])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names])
    rows = df.select(*names, *more).join(named, same, "left_semi")
    return rows.groupBy(*names).agg(F.min(F.struct(*more)).alias("__p")).select(*names, "__p.*")


def hash_order(*parts: Column | str) -> Column:
    """Deterministic shuffle key: md5 of the parts joined by ``|``."""
    return F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string")
                                    for p in parts]))


def hash_int(*parts: Column | str) -> Column:
    """60-bit non-negative integer from ``hash_order``."""
    return F.conv(F.substring(hash_order(*parts), 1, 15), 16, 10).cast("bigint")


def global_rank(df: DataFrame, key: Column, name: str, prefix: int = 3) -> DataFrame:
    """0-based rank over the whole table by a hex ``key``; at most ``16**prefix`` offsets."""
    hashed = df.withColumn("__k", key).withColumn("__one", F.lit(1))
    return rank_in_group(hashed, ["__one"], [F.col("__k")], F.substring("__k", 1, prefix), name).drop("__k", "__one")


def first_keys(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows whose distinct ``keys`` are among the first ``n`` in ``order``; ``n <= 0`` keeps everything.

    Only keys are sorted, and they are cut at their rank, so that no selection, however long, gathers in one task.
    """
    if n <= 0:
        return df
    ranked = rank_by_range(df.select(*keys).distinct(), [*order, *map(F.col, keys)], "__rank")
    return df.join(ranked.filter(F.col("__rank") < n).select(*keys), list(keys), "left_semi")


def limit_by_hash(df: DataFrame, n: int, key: Column) -> DataFrame:
    """A reproducible random sample of ``n`` rows; ``n <= 0`` keeps everything."""
    if n <= 0:
        return df
    return rank_by_range(df, [key], "__i").filter(F.col("__i") < n).drop("__i")


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The ``n`` rows that come first in ``order``; cut at their rank, so they never gather in one task."""
    return rank_by_range(df, [F.col(c) for c in order], "__i").filter(F.col("__i") < n).drop("__i")
