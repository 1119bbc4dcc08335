"""Choices of the k smallest draws: the same in one record, over many records and in plain Python, without rows by replicates."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemsonde.functions.draws import PRIME, replicate_draw, seeds
from stemsonde.operators import choice
from stemsonde.operators import resampling as R
from stemsonde.operators import scores as N


def numbers(*parts):
    h = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    return [int(h[a: a + 8], 16) % PRIME for a in (0, 8, 16)]


def plain_draw(b, r):
    return ((b[2] * r + b[1]) % PRIME * r + b[0]) % PRIME


def plain_null(rows, reps, seed):
    """Largest ratio over layers of each replicate: rows (pos, stratum, label, layer, value) of unit u."""
    items = {}
    for pos, stratum, label, layer, value in rows:
        items.setdefault(pos, (stratum, label, []))[2].append((layer, value))
    out = []
    for r in range(1, reps + 1):
        paired = {p for p, (s, label, _) in items.items() if s is None and label == "paired"}
        for s in {v[0] for v in items.values()} - {None}:
            own = [p for p, v in items.items() if v[0] == s]
            k = sum(items[p][1] == "paired" for p in own)
            paired |= set(sorted(own, key=lambda p: (plain_draw(numbers(seed, "u", p), r), p))[:k])
        best = 0.0
        for layer in {x[3] for x in rows}:
            a = [v for p, (_, _, c) in items.items() for n, v in c if n == layer and p in paired]
            b = [v for p, (_, _, c) in items.items() for n, v in c if n == layer and p not in paired]
            if a and b and np.mean(b) > 1e-10:
                best = max(best, np.mean(a) / np.mean(b))
        out.append(best)
    return out


@pytest.fixture(scope="module")
def dist(spark):
    rng = np.random.default_rng(4)
    rows = [(p, [None, "A", "B"][p % 3] if p % 11 else None, "paired" if rng.random() < 0.3 else "unpaired", layer, float(rng.random())) for p in range(120) for layer in (0, 1)]
    rows = [(p, s, rows[2 * p][2], layer, v) for p, s, _, layer, v in rows]
    return rows, spark.createDataFrame([("u", *r) for r in rows], "unit_id string, pos int, stratum string, label string, layer int, value double")


def test_draws_are_the_same_in_sql_and_numpy(spark):
    got = spark.range(20).select("id", seeds("s", F.col("id")).alias("b")).select("id", "b", replicate_draw(F.col("b"), F.lit(7)).alias("d")).collect()
    for r in got:
        assert r.b == numbers("s", r.id) and r.d == plain_draw(r.b, 7) == choice.draw_table(np.array([r.b]), 7, 7)[0, 0]


@pytest.mark.parametrize("block", [4096, 40, 9])
def test_permutation_null_over_records(spark, dist, block):
    rows, df = dist
    valid = df.select("unit_id", "layer").distinct()
    got = N.permutation_null(df.repartition(5), valid, 40, "z", block=block).orderBy("rep").collect()
    assert [r.rep for r in got] == list(range(1, 41))
    assert np.allclose([r.null_max for r in got], plain_null(rows, 40, "z"), atol=1e-12)


def test_equal_draws_go_by_key(spark, monkeypatch):
    """With draws of a few values the boundary is decided by the key, in one record and over several."""
    monkeypatch.setattr(choice, "seeds", lambda *p: F.transform(F.array(p[-1] % 2), lambda x: F.array(x.cast("bigint"), F.lit(0).cast("bigint"), F.lit(0).cast("bigint")))[0])
    df = spark.createDataFrame([("u", i, float(2 ** i)) for i in range(12)], "u string, key int, v double").withColumn("c", F.array(F.struct(F.lit(0).alias("cell"), F.col("v").alias("value"))))
    for block in (100, 3):
        got = choice.chosen_sums(df, ["u"], F.lit("g"), "key", F.lit(8) + 0 * F.count(F.lit(1)), F.lit(False), "c", 2, "s", block).collect()
        assert [(r.n_in, r.s_in) for r in got] == [(8, sum(2.0 ** i for i in (0, 2, 4, 6, 8, 10, 1, 3)))] * 2


def test_half_splits_over_records(spark):
    rng = np.random.default_rng(9)
    rows = [("m", u, layer, float(rng.random()), u % 3 / 3.0 + layer, u % 4 / 4.0) for u in range(31) for layer in range(3)]
    df = spark.createDataFrame(rows, "model string, unit_id int, layer int, ps double, precision double, chance double")
    names = ("model", "split", "layer", "ps", "precision", "chance")
    got = {b: [tuple(r[c] for c in names) for r in R.heldout(df.repartition(3), ["model"], 25, "8", block=b).orderBy("split").collect()] for b in (4096, 6)}
    assert len(got[4096]) == 25
    for (a, b) in zip(got[4096], got[6]):
        assert a[:3] == b[:3] and np.allclose(a[3:], b[3:], atol=1e-12)
    for model, split, layer, ps, precision, chance in got[6]:
        first = set(sorted(range(31), key=lambda u: (plain_draw(numbers("8", "m", u), split), u))[:15])
        mean = lambda k, units, layer: np.mean([r[k] for r in rows if r[1] in units and r[2] == layer])
        best = max(range(3), key=lambda n: (round(mean(3, first, n), 12), -n))
        assert layer == best and np.isclose(ps, mean(3, first, best)) and np.isclose(precision, mean(4, set(range(31)) - first, best))


def test_rows_do_not_meet_replicates(spark, dist):
    """What is exchanged does not grow with rows times replicates: the widest exchange after the records has a row for
    each unit, replicate and layer, and no join or window runs over items of a replicate."""
    _, df = dist
    n = N.permutation_null(df, df.select("unit_id", "layer").distinct(), 200, "z")
    plan = n._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") == 1 and "Generate" not in plan
    sums = choice.chosen_sums(df.withColumn("c", F.array(F.struct(F.col("layer").alias("cell"), "value"))).dropDuplicates(["pos"]), ["unit_id"], F.col("stratum"), "pos",
                              F.count_if(F.col("label") == "paired"), F.col("label") == "paired", "c", 200, "z")
    assert sums.count() == 200


def test_a_hot_unit_is_spread_over_records(spark):
    """One unit with most rows: no record holds more than its share."""
    df = spark.range(3000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id").cast("string"))).alias("u"), F.col("id").alias("key"),
                                  F.array(F.struct(F.lit(0).alias("cell"), F.lit(1.0).alias("value"))).alias("c"))
    got = {(r.u, r.rep): (r.n_in, r.n_out) for r in choice.chosen_sums(df, ["u"], F.lit("g"), "key", F.floor(F.count(F.lit(1)) / 2), F.lit(False), "c", 5, "s", 64).collect()}
    assert all(got["hot", r] == (1350, 1350) for r in range(1, 6)) and got["u0", 1] == (0, 1)


@pytest.mark.parametrize("block", [4096, 60])
def test_threshold_of_small_units_is_found_in_their_record(spark, dist, block):
    """The quantile equals that of exchanged replicates, for units below and above a record; invalid layers count for nothing."""
    rows, df = dist
    many = df.unionByName(df.filter("pos < 50").withColumn("unit_id", F.lit("v"))).unionByName(df.filter("pos < 5").withColumn("unit_id", F.lit("none")))
    valid = spark.createDataFrame([("u", 0), ("u", 1), ("v", 1)], "unit_id string, layer int")
    best = valid.select("unit_id", F.lit(1.0).alias("ratio")).distinct()
    want = N.null_threshold(N.permutation_null(many, valid, 40, "z"), best)
    got = N.permutation_threshold(many.repartition(3), valid, 40, "z", block=block)
    a, b = ({r.unit_id: r.null_95 for r in d.collect()} for d in (want, got))
    assert sorted(a) == ["u", "v"] and b == {k: pytest.approx(x, abs=1e-12) for k, x in a.items()}
    small, sums = choice.chosen_maxima(*N._shuffled_items(many, ["unit_id"], "pos", "stratum"), 40, "z", 0.95)
    assert sums.count() == 0 and small.count() == 3 and "Exchange" not in small._jdf.queryExecution().executedPlan().toString()
