"""Tail probabilities and nulls against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemsonde.functions import special as X
from stemsonde.operators import aggregates as G
from stemsonde.operators import resampling as R
from stemsonde.operators import scores as N


def test_binomial_tail():
    for n, k, p in ((10, 7, 0.5), (40, 3, 1 / 3), (200, 90, 0.4), (5, 0, 0.2), (5, 5, 0.2)):
        want = sum(math.comb(n, x) * p ** x * (1 - p) ** (n - x) for x in range(k, n + 1))
        assert float(X.binomial_upper([k], [n], [p])[0]) == pytest.approx(want, rel=1e-10)


def test_clopper_pearson():
    low = float(X.beta_quantile([0.025], [8], [13])[0])
    assert sum(math.comb(20, x) * low ** x * (1 - low) ** (20 - x) for x in range(8, 21)) == pytest.approx(0.025, rel=1e-8)


def test_t_two_sided():
    # two degrees of freedom have a closed form
    for t in (0.3, 1.7, 4.0):
        assert float(X.t_two_sided([t], [2])[0]) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-10)


def test_rank_tails():
    for n, w in ((6, 17), (9, 30)):
        ranks = range(1, n + 1)
        hits = sum(sum(r for r, s in zip(ranks, sign) if s) >= w for sign in itertools.product((0, 1), repeat=n))
        assert X._rank_sum_tail(n, w) == pytest.approx(hits / 2 ** n)
    n1, n2 = 4, 5
    us = [sum(c) - n1 * (n1 - 1) // 2 for c in itertools.combinations(range(n1 + n2), n1)]
    for u in (3, 12, 18):
        assert X._u_tail(n1, n2, u) == pytest.approx(np.mean([x >= u for x in us]))


def test_sign_tests(spark):
    cases = {(19, 7, 0): 971712 / 2 ** 26, (13, 4, 0): 3214 / 2 ** 17, (8, 1, 0): 10 / 2 ** 9, (5, 0, 3): 1 / 2 ** 5, (0, 0, 4): 1.0}
    rows = [(str(k), v) for k in cases for v in [0.9] * k[0] + [0.1] * k[1] + [0.5] * k[2]]
    got = {r["g"]: r["p"] for r in R.sign_test(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for k, p in cases.items():
        assert got[str(k)] == pytest.approx(p, rel=1e-10)


def test_best_layer_ties(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.6), ("a", 2, 0.55), ("b", 0, 0.3), ("b", 1, 0.3), ("b", 2, 0.1)], "unit_id string, layer int, ps double")
    got = {r["unit_id"]: r["layer"] for r in G.best_layer(df, ["unit_id"], "ps").collect()}
    assert got == {"a": 1, "b": 0}


def test_verdict_minimums(spark):
    def verdict(all_units, close_units):
        df = spark.createDataFrame([("m", "family_all", all_units, 0.001), ("m", "family_close", close_units, 0.001)], "model string, tag string, units long, p double")
        return N.decoy_verdict(df, ["model"], F.col("p")).collect()[0]
    assert verdict(13, 8)["identity_void"] and not verdict(14, 8)["identity_void"]
    assert verdict(14, 7)["guard_void"] and not verdict(14, 8)["guard_void"]
    assert verdict(14, 8)["guard_met"] and not verdict(13, 8)["guard_met"]


def test_grades(spark):
    rows = [(10, 10, 10, 0.2, 0.8), (10, 10, 2, 0.2, 0.8), (10, 3, 2, 0.2, 0.8), (2, 2, 2, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "a int, b int, c int, ps double, h3 double")
    assert [r[0] for r in df.select(N.grade(*[F.col(c) for c in ("a", "b", "c", "ps", "h3")])).collect()] == ["A", "B", "C", "D"]


def null_input(spark, n=120):
    sym = F.element_at(F.array(*[F.lit(c) for c in "ACGUN"]), (F.pmod(F.hash("unit_id", "pos"), F.lit(5)) + 1).cast("int"))
    df = spark.range(3).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("unit_id")) \
        .select("unit_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pos"))
    df = df.withColumns({"sym": sym, "label": F.when(F.pmod(F.hash("pos", "unit_id"), F.lit(3)) == 0, "paired").otherwise("unpaired")})
    df = df.withColumn("layer", F.explode(F.array(F.lit(0), F.lit(1))))
    v = F.pmod(F.hash("unit_id", "pos", "layer"), F.lit(1000)) / 1000.0
    # an absent value on one layer, and an unlisted symbol that keeps its label
    return df.withColumns({"value": F.when((F.col("pos") != 7) | (F.col("layer") != 1), v), "stratum": F.when(F.col("sym") != "N", F.col("sym"))}) \
        .filter(F.col("value").isNotNull())


def test_packed_null_equals_relational(spark):
    d = null_input(spark)
    valid = G.label_ratio(d)
    a = N.permutation_null(d, valid, 15, "z").toPandas().set_index(["unit_id", "rep"])["null_max"].sort_index()
    b = N.permutation_null_packed(N.pack_dist(d, valid), 15, "z").toPandas().set_index(["unit_id", "rep"])["null_max"].sort_index()
    assert len(a) == 45 and np.allclose(a, b, atol=1e-12)


def test_null_does_not_depend_on_partitioning(spark):
    d = null_input(spark)
    valid = G.label_ratio(d)
    a = N.permutation_null(d.repartition(1), valid, 5, "z").toPandas().sort_values(["unit_id", "rep"])["null_max"]
    b = N.permutation_null(d.repartition(17), valid, 5, "z").toPandas().sort_values(["unit_id", "rep"])["null_max"]
    assert np.allclose(a, b, atol=1e-12)


def test_exact_u_tail_of_a_large_second_sample():
    from itertools import combinations

    from stemsonde.functions.special import _u_tail
    for n1, n2 in ((3, 4), (1, 9), (4, 6)):
        us = [sum(c) - n1 * (n1 - 1) // 2 for c in combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            assert abs(_u_tail(n1, n2, u) - sum(x >= u for x in us) / len(us)) < 1e-12
    # 8 against 5,000 values: still exact, symmetric about the middle
    assert abs(_u_tail(8, 5000, 20_001) + _u_tail(8, 5000, 20_000) - 1) < 1e-9
    assert abs(_u_tail(2, 5000, 10_000) - 1 / (5002 * 5001 / 2)) < 1e-15
    # the far tail is a count over all arrangements, however long the larger sample
    for n2 in (200, 2_000, 200_000, 10**9):
        assert _u_tail(8, n2, 8 * n2) == 1 / math.comb(n2 + 8, 8) > 0
        assert _u_tail(8, n2, 8 * n2 - 1) == 2 / math.comb(n2 + 8, 8) and _u_tail(8, n2, 0) == 1
    assert _u_tail(1, 10**9, 10**9 - 4) == 5 / (10**9 + 1)


def test_pair_samples_are_whole_and_distinct(spark):
    """As many distinct pairs as asked for, up to all there are."""
    from stemsonde.operators import aggregates as G
    columns = spark.createDataFrame([(m, 10 * c + m) for m in range(2, 24) for c in range(m)], "family int, col int")
    sizes = lambda n: spark.createDataFrame([(m, n(m)) for m in range(1, 24)], "family int, n_pairs int")
    for n in (lambda m: m * (m - 1) // 2, lambda m: max(1, m * (m - 1) // 2 - 1), lambda m: 10_000, lambda m: 3):
        got = {}
        for r in G.sample_unpaired_pairs(columns, sizes(n)).collect():
            assert r.c1 < r.c2
            got.setdefault(r.family, set()).add((r.c1, r.c2))
        assert {m: len(p) for m, p in got.items()} == {m: min(n(m), m * (m - 1) // 2) for m in range(2, 24)}
    few = spark.createDataFrame([(f, c) for f in range(3000) for c in range(4)], "family int, col int")
    one = G.sample_unpaired_pairs(few, few.select("family").distinct().withColumn("n_pairs", F.lit(1)))
    counts = [r["count"] for r in one.groupBy("c1", "c2").count().collect()]
    assert len(counts) == 6 and all(400 < c < 600 for c in counts)


def test_significant_figures_and_rounding(spark):
    from stemsonde.operators.reports import rounds_to, significant_figures
    rows = [("10.5", 3, 10.52, True), ("10.5", 3, 10.2, False), ("20.0", 3, 19.97, True), ("-0.12", 2, -0.1249, True), ("-0.12", 2, -0.126, False), ("0.0040", 2, 0.00404, True),
            ("7", 1, 7.4, True), ("0.000", 1, 0.0004, True), ("120", 3, 119.6, True), ("1.5", 2, 1.44, False),
            ("1e-3", 1, 0.0012, True), ("1e-3", 1, 0.04, False), ("1.2e-5", 2, 1.24e-5, True), ("1.2e-5", 2, 0.01, False), ("1.2e-5", 2, 1.4e-5, False), ("4E2", 1, 380.0, True), ("4E2", 1, 460.0, False), ("3.5e+1", 2, 35.4, True)]
    df = spark.createDataFrame(rows, "literal string, figures int, value double, prints boolean")
    got = df.select("literal", "figures", "prints", significant_figures(df.literal).alias("f"), rounds_to(df.value, df.literal).alias("r")).collect()
    assert all(r.figures == r.f and r.prints == r.r for r in got)


def test_poisson_steps_have_mean_and_variance_one():
    from stemsonde.operators.resampling import poisson_steps
    steps = poisson_steps()
    edges = [0, *steps, 2**32]
    p = [(b - a) / 2**32 for a, b in zip(edges, edges[1:])]
    mean = sum(k * x for k, x in enumerate(p))
    assert abs(mean - 1) < 1e-6 and abs(sum(k * k * x for k, x in enumerate(p)) - mean**2 - 1) < 1e-6


def test_bootstrap_exchanges_no_replicates_of_rows(spark):
    """What is exchanged is combined by (group, replicate) first, whatever the number of rows."""
    from pyspark.sql import functions as F

    from stemsonde.operators.resampling import bootstrap_replicates
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("x"))
    out = bootstrap_replicates(df, ["g"], "k", ["x"], 200, "s")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan[plan.index("Exchange"):] and "Join" not in plan
    r = out.groupBy("g").agg(F.avg("x").alias("m"), F.stddev("x").alias("s"), F.count("*").alias("n")).collect()
    assert all(x.n == 200 and abs(x.m - 3) < 0.02 and abs(x.s - 2 / 50) < 0.01 for x in r)
