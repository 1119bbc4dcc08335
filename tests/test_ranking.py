"""Distributed ranks against brute force, with one group holding a third of the rows or more."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stemsonde.functions.draws import draw
from stemsonde.operators import aggregates as G
from stemsonde.operators import ranking as K
from stemsonde.operators import resampling as R


def skewed(spark, n=4000):
    g = F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 11).cast("string")))
    v = F.when(F.col("id") % 5 == 0, F.lit(1.5)).otherwise(F.exp((F.hash("id") % 1000) / 200.0) - 5)
    return spark.range(n).select("id", g.alias("g"), v.alias("v"), (F.col("id") % 13).alias("w"))


def cut_small(monkeypatch):
    for name, n in (("SMALL", 16), ("SAMPLED", 200), ("STEPS", 4)):
        monkeypatch.setattr(K, name, n)


def test_buckets_are_even_behind_extreme_values(spark, monkeypatch):
    """One value far below and one far above all others, or a heavy tail: no bucket holds more than a few percent."""
    values = [F.when(F.col("id") == 0, -1e12).when(F.col("id") == 1, 1e15).otherwise(F.col("id") / 7.0), F.exp(F.col("id") / 40.0), F.lit(1.0) - F.exp(-F.col("id") / 900.0)]
    for v in values:
        df = spark.range(20000).select(F.lit("hot").alias("g"), v.alias("v"), F.lit(1).alias("n"))
        counts = [r["count"] for r in K.ordered_buckets(df, ["g"], "v", "b").groupBy("b").count().collect()]
        assert len(counts) > 900 and max(counts) < 0.02 * 20000
        order = K.ordered_buckets(df, ["g"], "v", "b").groupBy("b").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
        assert all(x.hi < y.lo for x, y in zip(order, order[1:]))


def test_cumulative_counts_in_buckets(spark, monkeypatch):
    cut_small(monkeypatch)
    df = skewed(spark)
    got = K.cumulative_counts(K.value_counts(df, ["g"], "v"), ["g"], "v").toPandas().set_index(["g", "v"])
    pdf = df.toPandas()
    pdf["r"] = pdf.groupby("g")["v"].rank(method="average")
    for (g, v), part in pdf.groupby(["g", "v"]):
        assert got.loc[(g, v), "avg_rank"] == part["r"].iloc[0]
    assert (got["total"].groupby("g").first() == pdf.groupby("g").size()).all()


def test_exact_quantiles(spark):
    df = skewed(spark)
    got = K.exact_quantiles(df, ["g"], "v", {"a": 0.05, "m": 0.5, "z": 0.9}).toPandas().set_index("g")
    for g, part in df.toPandas().groupby("g"):
        assert np.allclose(got.loc[g, ["a", "m", "z"]].astype(float), np.percentile(part["v"], [5, 50, 90]), rtol=1e-12)


def test_draw_rank_is_a_permutation(spark):
    df = skewed(spark).withColumn("h", draw("s", F.col("id")))
    pdf = K.draw_rank(df, ["g"], "h", ["id"]).toPandas()
    want = pdf.sort_values("h").groupby("g").cumcount() + 1
    assert (pdf["rank"] == want.sort_index()).all()


def test_top_k_ties(spark):
    pdf = K.top_k(skewed(spark), ["g"], [F.desc("v"), F.col("id")], 3).toPandas()
    ref = skewed(spark).toPandas().sort_values(["v", "id"], ascending=[False, True]).groupby("g").head(3)
    assert set(pdf["id"]) == set(ref["id"])


def test_spearman_both_forms(spark):
    a = G.spearman(skewed(spark), "v", "w", ["g"]).toPandas().set_index("g")["rho"]
    b = G.spearman(skewed(spark), "v", "w", ["g"], bounded=True).toPandas().set_index("g")["rho"]
    ref = skewed(spark).toPandas().groupby("g").apply(
        lambda p: np.corrcoef(p["v"].rank(), p["w"].rank())[0, 1], include_groups=False)
    assert np.allclose(a.sort_index(), ref.sort_index(), atol=1e-9)
    assert np.allclose(b.sort_index(), ref.sort_index(), atol=1e-9)


def test_bh_adjust(spark, monkeypatch):
    cut_small(monkeypatch)
    df = skewed(spark).withColumn("p", F.pmod(F.hash("id"), F.lit(977)) / 977.0)
    got = R.bh_adjust(df, "p", ["g"], "id").toPandas()
    for _, part in got.groupby("g"):
        p = part.sort_values("p")
        n = len(p)
        adj = np.minimum.accumulate((p["p"] * n / np.arange(1, n + 1))[::-1])[::-1]
        want = pd.Series(adj.to_numpy(), index=p["p"].to_numpy()).groupby(level=0).min()
        assert np.allclose(p["p_adjusted"], want.loc[p["p"]])


def test_bootstrap_is_independent_of_partitioning(spark):
    df = skewed(spark)
    one = R.bootstrap_ci(df.repartition(1), ["g"], "id", "v", 30, "b").toPandas().sort_values("g")
    many = R.bootstrap_ci(df.repartition(17), ["g"], "id", "v", 30, "b").toPandas().sort_values("g")
    assert np.allclose(one[["ci_low", "ci_high"]], many[["ci_low", "ci_high"]], rtol=1e-12)


def test_duplicate_members_keep_every_copy(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("t"))
    got = G.duplicate_members(df, F.col("t"), "id")
    assert got.count() == 1000 and got.select("copies").distinct().collect()[0][0] == 1000


def test_set_digest_has_one_rule_at_every_size(spark):
    """Order and partitioning do not matter, a changed or repeated name does, for 300 names as for three."""
    for n in (300, 3):
        df = spark.range(2 * n).select((F.col("id") % 2 == 0).alias("g"), F.col("id").cast("string").alias("n"))
        told = lambda d: {r["g"]: (r["n_names"], r["digest"]) for r in G.set_digest(d, ["g"], F.col("n")).collect()}
        one = told(df.repartition(1))
        assert one == told(df.repartition(17)) == told(df.orderBy(F.col("n").desc()))
        assert all(k == n and len(d) == 16 for k, d in one.values()) and one[True][1] != one[False][1]
        assert told(df.replace("1", "x", "n"))[False] != one[False]
        assert told(df.unionByName(df.where("n = '0'")))[True] != one[True]
