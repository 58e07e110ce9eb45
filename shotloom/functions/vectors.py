"""Vector arithmetic as Spark column expressions over ARRAY<FLOAT|DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column, eps: float = 1e-8) -> Column:
    """Unit vector; the norm is clipped from below so a zero vector stays zero."""
    scale = F.greatest(norm(v), F.lit(eps))
    return F.transform(as_double(v), lambda x: x / scale)


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def to_unit_interval(score: Column) -> Column:
    """Rescale a cosine from [-1, 1] to [0, 1]."""
    return (score + 1.0) / 2.0


def fuse_mean(a: Column, b: Column) -> Column:
    """Element-wise mean of two modalities; null when the dimensions differ."""
    mean = F.zip_with(as_double(a), as_double(b), lambda x, y: (x + y) / 2.0)
    return F.when(F.size(a) == F.size(b), mean)


def fuse_error(a: Column, b: Column) -> Column:
    """Null when two modalities can be fused, else what is wrong."""
    return F.when(
        F.size(a) != F.size(b),
        F.concat(F.lit("dimension mismatch: "), F.size(a).cast("string"), F.lit(" vs "), F.size(b).cast("string")),
    )


def minmax_u8(v: Column) -> Column:
    """Scale to 0..255 and truncate; a constant vector gives zeros."""
    d = as_double(v)
    lo, span = F.array_min(d), F.array_max(d) - F.array_min(d)
    return F.transform(d, lambda x: F.coalesce(F.try_divide(x - lo, span) * 255.0, F.lit(0.0)).cast("int"))


def mean_abs_diff(a: Column, b: Column) -> Column:
    diffs = F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)


def r6(x: Column) -> Column:
    """Six digits; the nudge makes exact ties independent of summation order."""
    return F.round((x.cast("double") + 1e-9) * 1e6) / 1e6
