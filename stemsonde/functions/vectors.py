"""Vector expressions over array columns; arithmetic is done in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in index order."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; null where either vector has no length."""
    return let(norm(a) * norm(b), lambda scale: F.when(scale > 0, F.lit(1.0) - dot(a, b) / scale))


def mean_of(arr: Column) -> Column:
    """Mean of the non-null entries, null where there is none; one pass."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    return F.aggregate(arr, start, lambda a, x: F.struct(
        (a["s"] + F.coalesce(x, F.lit(0.0))).alias("s"), (a["n"] + x.isNotNull().cast("int")).alias("n")),
        lambda a: F.when(a["n"] > 0, a["s"] / a["n"]))


def guarded_ratio(num: Column, den: Column, floor: float = 1e-10) -> Column:
    """num / den, 0.0 where the denominator is at or below the floor."""
    return F.when(den > floor, num / den).otherwise(F.lit(0.0))
