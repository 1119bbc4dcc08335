"""Deltas read where a statistic needs them, against whole profiles; best layers without a join."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from stemsonde.catalog import views as V
from stemsonde.catalog.scores import canonical_profiles, hairpin_units
from stemsonde.catalog.structure import AT, attached, pairs_of
from stemsonde.operators import scores as N
from stemsonde.operators import vectors as E


def plan(name, spark, sf):
    return entry_point.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", "n9_nearer_larger n7_h3_precision t16_score_by_pair_type n1_partner_specificity".split())
def test_best_layer_needs_no_join_and_no_profile(name, spark, sf):
    text = plan(name, spark, sf)
    assert "Join" not in text and " AS d#" not in text


def test_control_joins_units_before_profiles_are_made(spark, sf):
    text = plan("n6_positive_control", spark, sf)
    assert text.count("Join") == 1 and "Join LeftSemi" not in text
    assert text.index("transform(chars") < text.index("Join")  # above the join


def test_control_joins_text_and_not_frames(spark, sf):
    """Neither side of the join has an array, which a sort would spill."""
    text = plan("n6_positive_control", spark, sf)
    above, below = text.split("Join", 1)
    assert "stem_id" in above and "REPARTITION" not in above
    left = below.split("Aggregate", 1)[0]  # units; pairs of all layers are aggregated on the other side
    assert "Repartition" in left and "stem_id" not in left and "split(" not in left


def test_read_deltas_equal_whole_profiles(spark, sf):
    whole, some = attached(spark, sf).filter("unit_id % 20 = 3"), pairs_of(spark, sf).filter("unit_id % 20 = 3")
    a, b = N.pair_scores(whole), N.pair_scores(some, AT)
    cols = ["unit_id", "layer", "i", "ps", "partner_is_max", "nearer_larger", "deep"]
    assert rows(a.select(*cols)) == rows(b.select(*cols)) and a.count() > 100
    best = N.partner_specificity(a)
    assert rows(N.nearer_larger(N.at_best(a, best))) == rows(N.best_nearer_larger(b))
    assert rows(N.h3_precision(N.at_best(a, best))) == rows(N.best_h3_precision(b))
    assert rows(N.cross_scores(whole).withColumn("layers", F.to_json("layers")).withColumn("stems", F.to_json("stems"))) \
        == rows(N.cross_scores(some, at=AT).withColumn("layers", F.to_json("layers")).withColumn("stems", F.to_json("stems")))
    assert rows(N.decoy_rate(whole, N.ALL_TAGS)) == rows(N.decoy_rate(some, N.ALL_TAGS, AT))


def test_no_delta_outside_a_unit(spark):
    u = spark.createDataFrame([(1, "GGGGAAACCCC", "((((...))))")], "unit_id long, sequence string, structure string")
    at = N.reading(lambda me, c, k: F.lit(1.0))
    got = N.map_pairs(u, 1).select("i", *[at(F.lit(k)).alias(f"x{k + 1}") for k in (-1, 0, 1, 2, 10, 11)]).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(1, None, 1.0, None, 1.0, 1.0, None), (2, None, 1.0, 1.0, None, 1.0, None)]


@pytest.mark.parametrize("name", ["n10_coupling_ratio", "n11_pairing_null"])
def test_frames_are_not_joined(name, spark, sf):
    assert "Join" not in plan(name, spark, sf)


def test_coupling_and_pairing_of_tables_equal_those_of_rows(spark, sf):
    u = V.hairpins(spark, sf).filter("unit_id % 40 = 7")
    whole = canonical_profiles(spark, sf)
    a = N.coupling_ratio(u, whole)
    assert rows(a) == rows(N.coupling_of(N.canonical_pairs(u, 2), AT)) and a.count() > 5
    assert "BroadcastHashJoin" not in a._jdf.queryExecution().executedPlan().toString()
    # the same distance for one and two substitutions: every replicate has ratio 1
    one = whole.groupBy("unit_id", "layer").agg(F.expr("transform(sequence(0, 74), k -> k + 1.0)").alias("d"))
    two = whole.select("unit_id", "layer", "i", F.transform("d", lambda _, k: F.col("i") + 1.0).alias("d"))
    null = N.pairing_null(u, one, two, 5, "x")
    assert null.count() == 5 * u.count() and null.filter("abs(null_max - 1.0) > 1e-12 or null_max is null").count() == 0
    # rows of a table that lacks one left end
    fewer = N.pairing_null(u, one, two.filter("i <> 0"), 5, "x")
    assert fewer.count() == null.count() and fewer.filter("null_max is null or null_max = 1.0").count() < 5 * u.count()


def test_threshold_in_the_row_equals_that_of_the_replicates(spark, sf):
    u = hairpin_units(spark, sf).filter("unit_id % 30 = 4").withColumn("strata", F.col("sym"))
    best = u.select("unit_id", F.lit(1.1).alias("ratio"))
    a = N.null_threshold(N.permutation_null_packed(u, 40, "x"), best)
    b = N.past_threshold(best, N.permutation_threshold_packed(u, 40, "x"))
    assert rows(a.withColumn("null_95", F.round("null_95", 12))) == rows(b.withColumn("null_95", F.round("null_95", 12))) and a.count() > 3


def test_encoder_sees_few_sequences_at_a_time(spark):
    def fn(sequences):
        assert len(sequences) <= E.ENCODED
        return [[np.full((2, 1), float(len(sequences)))] for _ in sequences]

    got = E.encode(spark.range(150).coalesce(1).select("id", F.lit("AC").alias("sequence")), fn, ["id"])
    assert got.count() == 300 and got.agg(F.max(F.get("vec", F.lit(0)))).first()[0] == E.ENCODED


def test_derangements_by_tree_equal_those_by_steps():
    """All ways of the recurrence, laid out once, end where its steps do; every end is a derangement of its own."""
    rng = np.random.default_rng(9)
    for n in range(2, N.TREE + 1):
        draws = rng.integers(0, N.PRIME, (3000, n - 1))
        draws[0], draws[1] = 0, N.PRIME - 1
        got = N._by_tree(n, draws)
        assert np.array_equal(got, N._by_steps(n, draws)) and np.array_equal(got, N.derangements(n, draws))
        assert (got != np.arange(n)).all() and (np.sort(got, axis=1) == np.arange(n)).all()
    ends = N._tree(6)[2]
    whole = {tuple(e) for e in ends.tolist() if min(e) >= 0}
    assert len(whole) == 265


def test_deltas_are_evaluated_outside_lambdas(spark, sf):
    """Only there the draws run in compiled code; frames are cut off, so that only the statistic's own plan is left."""
    some = pairs_of(spark, sf).localCheckpoint()
    for df in (N.pair_scores(some, AT), N.decoy_rate(some, N.ALL_TAGS, AT)):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert any("md5" in line for line in plan) and not any("md5" in line and "lambda" in line for line in plan)


def test_repair_finds_each_share_once(spark, sf):
    text = plan("r2_repair", spark, sf)
    assert text.count("Join") == 3 and text.count("aggregate(") == 2  # brackets of units and of members are matched once
