"""Geometry against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemsonde.operators import vectors as E


def matrix(spark, n=400, d=6, parts=7):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d)) @ np.diag([5, 3, 2, 1, .5, .1])
    key = np.where(np.arange(n) % 3 > 0, "hot", "cold")
    df = spark.createDataFrame([(str(k), int(i), [float(v) for v in r]) for i, (k, r) in enumerate(zip(key, x))],
                               "k string, row int, vec array<double>").repartition(parts)
    return df, key, x


def test_spectra(spark):
    df, key, x = matrix(spark)
    got = {r["k"]: r for r in E.spectra(df, ["k"], keep=3).collect()}
    for k in ("hot", "cold"):
        m = x[key == k] - x[key == k].mean(axis=0)
        assert np.allclose(got[k]["values"], np.linalg.svd(m, compute_uv=False) ** 2, rtol=1e-9)
    dims = {r["k"]: r["effective_dim"] for r in E.effective_dim(E.spectra(df, ["k"]), ["k"]).collect()}
    for k in ("hot", "cold"):
        m = x[key == k] - x[key == k].mean(axis=0)
        share = np.cumsum(np.linalg.svd(m, compute_uv=False) ** 2)
        assert dims[k] == int(np.searchsorted(share / share[-1], 0.95) + 1)


def test_principal_angles():
    a, t = np.eye(4)[:2], 0.3
    b = np.array([[np.cos(t), 0, np.sin(t), 0], [0, 1, 0, 0]])
    assert np.allclose(E.principal_angles(a, b), [t, 0.0], atol=1e-12)
    small = np.array([[np.cos(1e-9), 0, np.sin(1e-9), 0], [0, 1, 0, 0]])
    assert np.isclose(E.principal_angles(a, small)[0], 1e-9, rtol=1e-5)


def test_component_correlation(spark):
    df, key, x = matrix(spark)
    got = E.component_correlation(df.withColumn("cov", F.get("vec", F.lit(0)) * 2 + F.get("vec", F.lit(3))), "cov", ["k"], 4)
    for k in ("hot", "cold"):
        m = x[key == k]
        y = 2 * m[:, 0] + m[:, 3]
        _, _, vt = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)
        want = [abs(np.corrcoef((m - m.mean(axis=0)) @ vt[c], y)[0, 1]) for c in range(4)]
        have = [r["abs_r"] for r in got.filter(F.col("k") == k).orderBy("component").collect()]
        assert np.allclose(have, want, atol=1e-9)


def test_fold_plan_is_greedy_by_size(spark):
    df = spark.createDataFrame([("a", 10), ("b", 9), ("c", 8), ("d", 3), ("e", 2)], "unit_id string, n long")
    got = {r["unit_id"]: r["fold"] for r in E.fold_plan(df, 2).collect()}
    # 10 | 9, then 8 to the lighter, and so on
    assert got == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 0}


def test_attention_agreement_of_long_and_whole_heads(spark):
    """Long cells and whole matrices agree with Spearman's rho of numpy ranks; ties, a flat head and a unit without contacts."""
    from stemsonde.operators import vectors as E
    rng, rows, long, want = np.random.default_rng(8), [], [], {}
    contacts = {"a": [(0, 5), (1, 4), (2, 9)], "b": [], "c": [(0, 3)]}
    for unit, n in (("a", 10), ("b", 6), ("c", 4)):
        for head in range(3):
            w = np.full((n, n), 0.25) if head == 2 else rng.integers(0, 4, (n, n)) / 4.0 if head else rng.random((n, n))
            rows.append((unit, 0, head, w.ravel().tolist(), contacts[unit]))
            long += [(unit, 0, head, r, c, float(w[r, c])) for r in range(n) for c in range(n)]
            i, j = np.triu_indices(n, 1)
            x, y = (w[i, j] + w[j, i]) / 2, np.array([(a, b) in contacts[unit] for a, b in zip(i, j)], float)
            if head < 2:
                rank = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
                want[unit, head] = np.corrcoef(rank, y)[0, 1] if y.any() else 0.0
    heads = spark.createDataFrame(rows, "unit_id string, layer int, head int, w array<double>, contacts array<struct<r: int, c: int>>")
    cells = spark.createDataFrame(long, "unit_id string, layer int, head int, r int, c int, w double")
    pairs = spark.createDataFrame([(u, r, c) for u, p in contacts.items() for r, c in p], "unit_id string, r int, c int")
    for got in (E.head_agreement(heads, ["unit_id", "layer", "head"]), E.attention_contact(cells, pairs)):
        found = {(r.unit_id, r.head): r.rho for r in got.collect()}
        assert found == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
    best = {r.unit_id: (r.best_corr, r.best_layer) for r in E.best_head(E.head_agreement(heads, ["unit_id", "layer", "head"])).collect()}
    assert best["b"] == (0.0, 0) and best["a"][0] == pytest.approx(max(0.0, want["a", 0], want["a", 1]), abs=1e-12)


def test_heads_made_where_they_are_read(spark):
    """Matrices made in the task, batch by batch, equal those in the row; sums that are equal in whole numbers tie."""
    from stemsonde.catalog.vectors import _N, _drawn_heads
    from stemsonde.catalog.views import PRIME
    from stemsonde.functions.draws import seeds
    units = spark.range(90).select("id", F.lit(0).alias("layer"), F.expr("cast(id % 2 as int)").alias("head")).repartition(2)
    contacts = F.expr("transform(sequence(0, 9), k -> struct(k as r, cast(74 - k as int) as c))")
    heads = units.select("*", F.when(F.col("head") == 0, seeds("t", F.col("id"))).alias("b"), contacts.alias("contacts"))
    cells = F.expr(f"transform(sequence(0L, {_N * _N - 1}L), r -> case when b is null then 5.0D else cast(((b[2] * r + b[1]) % {PRIME} * r + b[0]) % {PRIME} as double) end)")
    keys = ["id", "layer", "head"]
    a = {r.id: (r.n, r.rho) for r in E.head_agreement(heads, keys, weights=_drawn_heads).collect()}
    b = {r.id: (r.n, r.rho) for r in E.head_agreement(heads.withColumn("w", cells), keys).collect()}
    assert a == b and sorted(a) == list(range(0, 90, 2))
    # as shares of the prime these two sums differ in the last place
    many = np.random.default_rng(2).integers(1, PRIME // 2, (500, 3)).tolist()
    p, q, r, s = next((x, y + k, x + k, y) for x, y, k in many if x / PRIME + (y + k) / PRIME != (x + k) / PRIME + y / PRIME)
    w = np.array([[0, p, r], [q, 0, 1], [s, 1, 0]], np.int64)
    assert E.rank_agreement(np.array([p + q, r + s, 2.0]), np.array([0])) == pytest.approx(0.5, abs=1e-12)
    one = spark.createDataFrame([(1, 0, 0, [(0, 1)])], "id long, layer int, head int, contacts array<struct<r: int, c: int>>")
    got = E.head_agreement(one, keys, weights=lambda batch: np.repeat(w[None], batch.num_rows, axis=0)).collect()
    assert [(x.n, x.rho) for x in got] == [(3, pytest.approx(0.5, abs=1e-12))]


def test_probe_steps_all_fits_together(spark):
    """Same optimum as a plain Newton fit; jobs do not grow with layers and folds."""
    rng = np.random.default_rng(3)
    rows = [(u, layer, r, rng.normal(size=4).tolist()) for u in range(10) for layer in range(3) for r in range(12)]
    labels = {(u, layer, r): int(v[0] + 0.7 * rng.normal() > 0.2) for u, layer, r, v in rows}
    emb = spark.createDataFrame(rows, "unit_id int, layer int, row int, vec array<double>")
    lab = spark.createDataFrame([(*k, v) for k, v in labels.items()], "unit_id int, layer int, row int, label int")
    sc, ids = spark.sparkContext, []
    for group in ("probe-before", "probe-after"):
        sc.setJobGroup(group, group)
        spark.range(3).count()
        ids.append(sc.statusTracker().getJobIdsForGroup(group)[0])
        if len(ids) == 1:
            got = {r.layer: r for r in E.probe(emb, lab, keys=("unit_id", "layer", "row")).collect()}
    assert ids[1] - ids[0] < 100
    fold = {r.unit_id: r.fold for r in E.fold_plan(emb.groupBy("unit_id").count().withColumnRenamed("count", "n"), 5).collect()}
    for layer in range(3):
        x = np.array([[*v, 1.0] for u, k, r, v in rows if k == layer])
        y = np.array([labels[(u, k, r)] for u, k, r, v in rows if k == layer])
        f, scores = np.array([fold[u] for u, k, r, v in rows if k == layer]), []
        for one in range(5):
            a, b, w, ridge = x[f != one], y[f != one], np.zeros(5), np.diag([1.0] * 4 + [1e-12])
            for _ in range(30):
                p = 1 / (1 + np.exp(-a @ w))
                w = w - np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (p - b) + ridge @ w)
            hit = (x[f == one] @ w > 0) == (y[f == one] == 1)
            scores.append(np.mean([hit[y[f == one] == k].mean() for k in (0, 1) if (y[f == one] == k).any()]))
        assert abs(got[layer].mean_accuracy - np.mean(scores)) < 1e-9 and got[layer].n_rows == 120
