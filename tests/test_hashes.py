"""Draws of many keys at once, choices in rows of items, and the packed null that rests on them."""

import hashlib

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from stemsonde.catalog.joins import rounded, swiftly_rounded
from stemsonde.functions.draws import PRIME, draw_head, draw_unit
from stemsonde.functions.hashes import key_numbers, slabs, with_draws
from stemsonde.operators import aggregates as G
from stemsonde.operators import choice
from stemsonde.operators import scores as N


def test_key_numbers_are_those_of_md5():
    heads = ["x" * k for k in range(70)] + ["é|", "s|12|"]
    last = np.r_[np.tile([0, 9, 10, 99, 100, 1234, 9999, 10000, -3, 10 ** 12], len(heads))]
    which = np.repeat(np.arange(len(heads)), 10)
    got = key_numbers(heads, which, last)
    for h, x, mine in zip(which, last, got):
        digest = hashlib.md5(f"{heads[h]}{x}".encode()).hexdigest()
        assert mine.tolist() == [int(digest[a: a + 8], 16) for a in (0, 8, 16)]
    assert np.array_equal(key_numbers(heads, which, last, 1)[:, 0], got[:, 0])
    assert key_numbers([], np.zeros(0, int), np.zeros(0, int)).shape == (0, 3)


def test_slabs_hold_every_row_once():
    for sizes in ([], [5], [9, 1, 1, 0, 8, 3], [0, 0]):
        got = list(slabs(np.array(sizes, int), 8))
        assert [k for a, b in got for k in range(a, b)] == list(range(len(sizes)))
        assert all(sum(sizes[a:b]) <= 8 or b == a + 1 for a, b in got)


def test_draws_beside_a_row_equal_those_of_sql(spark):
    df = spark.createDataFrame([(1, 3), (None, 2), (22, 0)], "id long, n int")
    ends = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    got = with_draws(df, F.array(*[draw_head("d", F.col("id"), F.lit(k)) for k in (0, 7)]), F.array(ends, F.slice(ends, 1, 1)), "x")
    one = lambda k, at: F.transform(at, lambda p: draw_unit("d", F.col("id"), F.lit(k), p))
    want = df.withColumn("x", F.array(one(0, ends), one(7, F.slice(ends, 1, 1))))
    assert rows(got) == rows(want) and got.columns == ["id", "n", "x"]


@pytest.mark.parametrize("n, groups", [(75, 4), (75, 17), (200, 2), (9, 1), (1, 1)])
def test_rows_of_items_choose_as_tables_do(n, groups):
    rng = np.random.default_rng(n + groups)
    for top in (PRIME, 3):  # with draws of three values most boundaries are ties
        b, own, group = rng.integers(0, top, (n, 3)), rng.random(n) < 0.6, rng.integers(-1, groups, n)
        b[:, 1:] *= top == PRIME
        for first, last in ((1, 200), (1440, 1460)):
            draws = choice.draw_table(b, first, last)
            want = np.tile(own, (len(draws), 1))
            for g in range(groups):
                at = np.flatnonzero(group == g)
                want[:, at] = choice.smallest(draws[:, at], int(own[at].sum()))
            assert np.array_equal(choice.draw_rows(b, first, last), draws.T)
            assert np.array_equal(choice.ordered_items(b, first, last), np.argsort(draws, axis=1, kind="stable"))
            assert np.array_equal(choice.shuffled_rows(choice.draw_rows(b, first, last), own, group).T, want)


@pytest.fixture(scope="module")
def packed(spark):
    """Units with absent values, other labels, open strata and a layer that is not valid; one unit in two rows."""
    rng = np.random.default_rng(3)
    out = []
    for u in (1, 2, 3, 3):
        n = 40 + u
        labels = rng.choice(["paired", "unpaired", "unpaired", "other"], n).tolist()
        strata = [None if x == 0 else str(x) for x in rng.integers(0, 5, n)]
        d = [[None if rng.random() < 0.2 else float(rng.random()) for _ in range(n)] for _ in range(2)]
        layers = [(0, d[0]), (1, d[1]), (2, [0.9 if k < 3 + u else None for k in range(n)] if u > 1 else [None] * n)]
        out.append((u, labels, strata, layers))
    return spark.createDataFrame(out, "unit_id long, labels array<string>, strata array<string>, layers array<struct<layer: int, d: array<double>>>")


def test_sums_of_the_audit_give_the_ratios(spark, packed):
    long = packed.select("unit_id", "labels", F.inline("layers")).select("unit_id", "labels", "layer", F.posexplode("d").alias("pos", "value")) \
        .withColumn("label", F.get("labels", F.col("pos")))
    short = lambda df: rows(df.select("unit_id", "layer", *[F.round(c, 9).alias(c) for c in ("mean_paired", "mean_unpaired", "ratio")]))
    audit = N.permutation_audit_packed(packed, 50, "x")
    assert short(N.audited_ratios(audit)) == short(G.label_ratio(long)) and audit.count() == 4
    assert rows(audit.select("unit_id", F.round("null_95", 9))) == rows(N.permutation_threshold_packed(packed, 50, "x").select("unit_id", F.round("null_95", 9)))


def test_layers_without_enough_values_are_left_out_of_the_null(spark, packed):
    counted = N.permutation_audit_packed(packed, 50, "x", min_each=3)
    ok = F.expr("transform(filter(s, x -> x.n_in >= 3 and x.n_out >= 3), x -> x.layer)")
    audit = N.permutation_audit_packed(packed.filter("unit_id < 3"), 50, "x").select("unit_id", F.col("layers").alias("s"))
    cut = packed.join(audit.select("unit_id", ok.alias("ok")), "unit_id").withColumn("layers", F.expr("filter(layers, x -> array_contains(ok, x.layer))"))
    assert cut.filter("size(layers) < 3").count() > 0
    a, b = (rows(x.filter("unit_id < 3").select("unit_id", F.round("null_95", 9))) for x in (counted, N.permutation_threshold_packed(cut, 50, "x")))
    assert a == b


def test_second_null_makes_values_beside_the_row(spark, sf):
    """Draws are not evaluated element by element, ratios need no row for every value, and the units of the second null meet as text."""
    text = entry_point.queries()["n3_second_order_null"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("md5" in line and "lambda" in line for line in text.splitlines()) and "posexplode" not in text
    assert "MapInArrow" in text.split("Join LeftSemi")[0] and "MapInArrow" not in text.split("Join LeftSemi")[1]


def test_pairing_null_equals_a_plain_one(spark):
    """Units of unlike size, one of a single class, distances that are absent; replicate by replicate against loops."""
    rng = np.random.default_rng(5)
    units, plain = [], {}
    numbers = lambda *parts: [int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[a: a + 8], 16) % PRIME for a in (0, 8, 16)]
    for u, n in (("a", 7), ("b", 16), ("c", 1)):
        left = rng.choice(list("ACGU"), n).tolist() if u != "b" else ["G"] * n
        pairs = [(k, 2 * n - 1 - k) for k in range(n)]
        mates = [[b for b in range(n) if (left[b] in "GC") == (left[a] in "GC")] for a in range(n)]
        lay = []
        for _ in range(3):
            sd = [None if rng.random() < 0.2 else float(rng.random()) for _ in range(n)]
            lay.append((sd, [[None if rng.random() < 0.2 else float(rng.random()) for _ in mates[a]] for a in range(n)]))
        units.append((u, left + ["N"] * n, pairs, lay))
        for rep in range(1, 31):
            draw = lambda tag, x: (lambda b: ((b[2] * rep + b[1]) * rep + b[0]) % PRIME)(numbers("s", u, tag, x))
            best = None
            met = []
            for strong in (True, False):
                at = [k for k in range(n) if (left[k] in "GC") == strong]
                met += zip(sorted(at, key=lambda k: draw("L", pairs[k][0])), sorted(at, key=lambda k: draw("R", pairs[k][1])))
            for sd, dd in lay:
                one = [x for x in sd if x is not None]
                two = [x for x in (dd[a][mates[a].index(b)] for a, b in met) if x is not None]
                if one and two:
                    best = max(best or 0.0, np.mean(one) / np.mean(two))
            plain[u, rep] = best
    df = spark.createDataFrame(units, "unit_id string, chars array<string>, canonical array<struct<i: int, j: int>>, lay array<struct<sd: array<double>, dd: array<array<double>>>>")
    got = {(r.unit_id, r.rep): r.null_max for r in N.repaired(df, F.col("lay"), 30, "s").collect()}
    assert got == {k: x if x is None else pytest.approx(x, abs=1e-12) for k, x in plain.items()}
    assert N.repaired(df.filter("unit_id = 'none'"), F.col("lay"), 30, "s").count() == 0


def test_pairing_null_makes_distances_beside_the_row(spark, sf):
    text = entry_point.queries()["n11_pairing_null"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("md5" in line and "lambda" in line for line in text.splitlines())
    assert text.count("split(sequence") == 1  # pairs are found once, and not once more by a filter


def test_swift_rounding_equals_round(spark):
    rng = np.random.default_rng(2)
    x = [*rng.random(500), *(rng.random(500) * 1e6), *(rng.integers(0, 10 ** 6, 300) / 1e4 + 5e-9), *(rng.integers(0, 10 ** 6, 300) / 1e9), 1e300, -1e-12, -0.5, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in enumerate(x)], "k int, x double")
    assert str(rows(swiftly_rounded(df, "x", places=8))) == str(rows(rounded(df, "x", places=8)))
