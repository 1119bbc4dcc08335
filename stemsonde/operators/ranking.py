"""Ranks, quantiles and prefix sums that never put one whole group in one task.

A window over ``partitionBy(group)`` sorts the group in a single task, which is
fine while a group is one record's positions and fatal when one group holds a
third of the table.  Here a group is first cut into ordered buckets; counts per
bucket are partial-aggregated, their running sums are taken over the (bounded)
bucket rows, and only a bucket is ever sorted in one task.  Bucketing depends on
the data alone, so a recomputed task gives the same answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ALL = "__all"


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    by = list(by)
    return (df, by) if by else (df.withColumn(ALL, F.lit(0)), [ALL])


def draw_rank(df: DataFrame, by: Sequence[str], digest: str, tie: Sequence[str],
              out: str = "rank", digits: int = 2) -> DataFrame:
    """1-based rank of each row by a hex digest within ``by``.

    Digests are uniform, so their leading ``digits`` cut every group into
    16^digits near-equal ordered buckets whatever its size.
    """
    df, keys = _keyed(df, by)
    cut = df.withColumn("__b", F.substring(digest, 1, digits))
    counts = cut.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__off", F.coalesce(F.sum("__n").over(
        W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))) \
        .drop("__n")
    inner = F.row_number().over(W.partitionBy(*keys, "__b").orderBy(digest, *tie))
    return (cut.withColumn("__r", inner).join(before, [*keys, "__b"])
            .withColumn(out, F.col("__r") + F.col("__off")).drop("__r", "__off", "__b", ALL))


def value_counts(df: DataFrame, by: Sequence[str], value: str,
                 extra: Sequence[Column] = ()) -> DataFrame:
    """Multiplicity of each distinct value, combined map-side."""
    return (df.filter(F.col(value).isNotNull()).groupBy(*by, value)
            .agg(F.count(F.lit(1)).alias("n"), *extra))


#: Groups of more distinct values are cut; values sampled of one for its bounds, about; steps of the search, for 2^STEPS buckets.
SMALL, SAMPLED, STEPS = 1024, 8192, 10


def ordered_buckets(counts: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """counts with a number ``out`` that orders its values in near-equal parts within each group.

    The bounds are quantiles of a sample of the distinct values: those whose hash falls into a
    share that follows from the group's size, so about ``SAMPLED`` of any group, the same ones
    in every partitioning and retry.  No scale is assumed; one extreme value, or many, take
    the room of any other value.  A group of few distinct values is one bucket.
    """
    v = F.col(value).cast("double")
    sizes = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("__distinct"))
    cut = counts.join(sizes, list(keys))
    part = F.pmod(F.xxhash64(v), F.greatest(F.floor(F.col("__distinct") / SAMPLED), F.lit(1)))
    sample = cut.filter((F.col("__distinct") > SMALL) & (part == 0)).groupBy(*keys).agg(F.sort_array(F.collect_list(v)).alias("__cuts"))
    n = 1 << STEPS
    bounds = sample.select(*keys, F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda k: F.get(
        "__cuts", F.floor(k * F.size("__cuts") / n).cast("int"))).alias("__cuts"))
    # binary search for the number of bounds below the value
    powers = F.array(*[F.lit(1 << k) for k in reversed(range(STEPS))])
    below = F.aggregate(powers, F.lit(0), lambda at, step: F.when(F.get("__cuts", at + step - 1) < v, at + step).otherwise(at))
    return cut.join(bounds, list(keys), "left").withColumn(out, F.when(F.col("__cuts").isNotNull(), below).otherwise(F.lit(0))).drop("__cuts", "__distinct")


def cumulative_counts(counts: DataFrame, by: Sequence[str], value: str, weights: Sequence[str] = ("n",), bucket: str | None = None) -> DataFrame:
    """Running totals over the ordered distinct values of each group.

    Adds ``lo`` (rows with a smaller value), ``total``, and the average rank
    ``avg_rank`` of the tied rows, for each column in ``weights`` (suffixed for
    all but the first).  ``counts`` has one row per (by, value).  Only the buckets
    of ``ordered_buckets`` are sorted; ``bucket`` keeps their number.
    """
    counts, keys = _keyed(counts, by)
    cut = ordered_buckets(counts, keys, value, "__b")
    per = cut.groupBy(*keys, "__b").agg(*[F.sum(w).alias(f"__s_{w}") for w in weights])
    over_group = W.partitionBy(*keys)
    running = over_group.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    for w in weights:
        per = (per.withColumn(f"__off_{w}", F.coalesce(F.sum(f"__s_{w}").over(running), F.lit(0)))
               .withColumn(f"__tot_{w}", F.sum(f"__s_{w}").over(over_group)))
    per = per.drop(*[f"__s_{w}" for w in weights])
    inside = W.partitionBy(*keys, "__b").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    for w in weights:
        cut = cut.withColumn(f"__in_{w}", F.coalesce(F.sum(w).over(inside), F.lit(0)))
    out = cut.join(per, [*keys, "__b"])
    for n, w in enumerate(weights):
        tag = "" if n == 0 else f"_{w}"
        out = (out.withColumn(f"lo{tag}", F.col(f"__in_{w}") + F.col(f"__off_{w}"))
               .withColumn(f"total{tag}", F.col(f"__tot_{w}")))
        if n == 0:
            out = out.withColumn("avg_rank", F.col("lo") + (F.col(w) + 1) / 2.0)
    if bucket:
        out = out.withColumn(bucket, F.col("__b"))
    return out.drop("__b", ALL, *[f"__{p}_{w}" for p in ("in", "off", "tot") for w in weights])


def average_ranks(df: DataFrame, by: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Average rank of every row's value within ``by`` (ties share the mean rank)."""
    ranks = cumulative_counts(value_counts(df, by, value), by, value)
    return df.join(ranks.select(*by, value, F.col("avg_rank").alias(out)), [*by, value])


def dense_index(df: DataFrame, by: Sequence[str], key: str, out: str = "idx") -> DataFrame:
    """0-based position of a unique key in its order within ``by``."""
    ranks = cumulative_counts(value_counts(df, by, key), by, key)
    return df.join(ranks.select(*by, key, F.col("lo").alias(out)), [*by, key])


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str,
                    probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles, one row per group, columns named by ``probs``."""
    cum = cumulative_counts(value_counts(df, by, value), by, value)
    v = F.col(value).cast("double")
    picks = []
    for name, p in probs.items():
        h = (F.col("total") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("lo") <= rank) & (rank < F.col("lo") + F.col("n"))
            picks.append(F.max(F.when(hit, v)).alias(f"__{name}_{side}"))
    picks.append(F.max("total").alias("__n"))
    got = cum.groupBy(*by).agg(*picks)
    out = []
    for name, p in probs.items():
        h = (F.col("__n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return got.select(*by, *out)


def bounded_percentile(value: Column, p) -> Column:
    """Exact percentile for groups whose size is bounded by a parameter (replicates, splits)."""
    return F.percentile(value, F.lit(p))


def first_by(df: DataFrame, by: Sequence[str], score: str, prefer_low: Sequence[str],
             carry: Sequence[str] = ()) -> DataFrame:
    """Row of the largest score per group, smallest ``prefer_low`` on ties.

    One hash aggregate: the largest score with negated tie keys, no sort.
    """
    order = F.struct(F.col(score), *[(-F.col(c)).alias(c) for c in prefer_low])
    row = F.struct(score, *prefer_low, *carry)
    return (df.filter(F.col(score).isNotNull()).groupBy(*by).agg(F.max_by(row, order).alias("__best"))
            .select(*by, "__best.*"))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int,
          out: str = "rank", split: int = 64, key: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` rows per group: a salted local top-k, then a top-k of at most
    ``split * k`` survivors."""
    df, keys = _keyed(df, by)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*(key or df.columns)), F.lit(split)))
    local = (salted.withColumn("__r", F.row_number().over(W.partitionBy(*keys, "__salt").orderBy(*order)))
             .filter(F.col("__r") <= k))
    return (local.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
            .filter(F.col(out) <= k).drop("__salt", "__r", ALL))
