"""Literal fixtures of the structure layer."""

import os

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from stemsonde.functions.alphabet import CANONICAL, TRANSVERSION
from stemsonde.functions.draws import PRIME
from stemsonde.operators import scores as N
from stemsonde.operators import structure as S
from stemsonde.operators import variants as M

TRNA = ("GCGGAUUUAGCUCAGUUGGGAGAGCGCCAGACUGAAGAUCUGGAGGUCCUGUGUUCGAUCCACAGAAUUCGCACCA",
        "(((((((..((((........)))).(((((.......))))).....(((((.......))))))))))))....")
U2 = ("AUCCUUUGCUUUGGCUUAGAUUCAAAUUGAAAUUUGAUCAAGUGCGUAUAUCCUUAUACUAACAAUAUCGGAGAAAAGCUGAU",
      "((((((((((((..(((((.........)))))..((((.........)))).((((((......)))))).)))))))))))")


def units(spark, *recs):
    return spark.createDataFrame([(n, s, d) for n, s, d in recs], "unit_id string, sequence string, structure string")


def test_pairs_and_canonical(spark):
    u = units(spark, ("a", "AAACCCUUU", "(((...)))"), ("b", "AAGCCAUUU", "(((...)))"))
    assert rows(S.match_brackets(u).filter("unit_id = 'a'"), "i", "j") == [(0, 8), (1, 7), (2, 6)]
    assert rows(S.canonical_pairs(u).filter("unit_id = 'b'"), "i", "j") == [(0, 8), (1, 7)]
    assert rows(S.stems(u).filter("unit_id = 'a'"), "stem_id", "k", "len") == [(0, 0, 3), (0, 1, 3), (0, 2, 3)]


def test_unmatched_brackets(spark):
    u = units(spark, ("x", "A" * 6, "))(().".ljust(6, ".")))
    assert rows(S.match_brackets(u), "i", "j") == [(3, 4)]
    # labels follow symbols, pairs follow the stack, stems need equal counts
    assert rows(S.positions(u).filter("label = 'paired'"), "pos") == [(p,) for p in range(5)]
    assert S.stems(u).count() == 0


def test_validity(spark):
    u = units(spark, ("short", "ACGU", "(())"), ("open", "A" * 30, "(" * 15 + "." * 15),
              ("ok", "AAACCCGGGAAAUUUCCCGGGUUU", "(((......)))............"))
    got = {r["unit_id"]: (r["valid"], r["reason"]) for r in S.validate_unit(u).collect()}
    assert got["short"] == (False, "too short")
    assert got["open"][0] is False and got["open"][1].startswith("unbalanced")
    assert got["ok"] == (True, "ok")


def test_real_units(spark):
    got = {r["unit_id"]: r for r in S.qualify_unit(units(spark, ("trna", *TRNA), ("u2", *U2))).collect()}
    t = got["trna"]
    assert (t["n_pairs"], t["n_canonical"], t["n_stems"], t["n_eligible"], t["n_deep"]) == (21, 20, 5, 10, 2)
    assert (got["u2"]["n_pairs"], got["u2"]["n_canonical"], got["u2"]["n_stems"]) == (26, 0, 0)


def test_length_mismatch_is_skipped(spark):
    r = S.qualify_unit(units(spark, ("m", TRNA[0], TRNA[1][:-3]))).collect()[0]
    assert r["status"] == "skipped" and r["reason"] == "length mismatch (76 vs 73)"


def test_transversion_alphabet():
    assert all(k != v for k, v in TRANSVERSION.items())
    partner = {"A": "U", "U": "A", "C": "G", "G": "C", "T": "A"}
    assert all(v + partner[k] not in CANONICAL for k, v in TRANSVERSION.items())


def test_synthesize_keeps_structure(spark):
    u = units(spark, ("t", *TRNA))
    syn = M.synthesize(u, 4)
    assert syn.count() == 4
    q = S.structure_counts(syn.select(F.col("variant_id").alias("unit_id"), "sequence", "structure"))
    assert all(r["n_canonical"] == r["n_pairs"] == 21 for r in q.collect())


def two_stems(spark):
    """Pairs (k, 60-k) and (100+k, 160-k), k = 0..7, with given partner symbols."""
    n = 161
    seq, st = ["A"] * n, ["."] * n
    mate = {"C": "G", "U": "A"}
    for base, partners in ((0, "CCUCCUCC"), (100, "CUCCCUCC")):
        for k, c in enumerate(partners):
            i, j = base + k, base + 60 - k
            seq[i], seq[j], st[i], st[j] = mate[c], c, "(", ")"
    return units(spark, ("f10", "".join(seq), "".join(st)))


def test_matched_decoys(spark):
    u = two_stems(spark)
    get = lambda scope, which, i: sorted(d for (d,) in rows(N.matched_decoys(u, scope, which).filter(F.col("i") == i), "decoy"))
    assert get("family", "all", 3) == [156, 157, 158]
    assert get("family", "close", 3) == []
    assert get("family", "all", 103) == [56, 57]
    assert get("stem", "all", 2) == [55]
    assert get("family", "all", 2) == [55, 155]
    assert get("family", "close", 2) == [55]


def one_stem(spark, n=12):
    seq, st = ["A"] * 101, ["."] * 101
    for k in range(n):
        seq[k], seq[100 - k], st[k], st[100 - k] = "G", "C", "(", ")"
    return units(spark, ("f11", "".join(seq), "".join(st)))


def test_oracle_known_answer(spark):
    a = N.control_profile(one_stem(spark), "oracle")
    pairs = N.pair_scores(a)
    best = N.partner_specificity(pairs)
    cross = N.cross_scores(a)
    reps = N.derangement_replicates(cross, 200, "s")
    h = N.h3_precision(N.at_best(pairs, best)).collect()[0]
    assert (h["h3_n"], h["h3_hits"], h["h3_fraction"]) == (8, 8, 1.0)
    c = N.chance_per_layer(reps).collect()[0]
    assert (c["deep_hits"], c["deep_n"], c["chance"]) == (0, 1600, 0.0)
    assert "Exchange" not in N.derangement_replicates(cross.checkpoint(), 10, "s")._jdf.queryExecution().executedPlan().toString()


def test_derangements_are_uniform():
    """Every derangement of 5 about equally often, none of anything else; 12 items have no fixed point either."""
    from itertools import permutations
    draws = np.random.default_rng(3).integers(0, PRIME, (44_000, 4))
    got = N.derangements(5, draws)
    want = {p for p in permutations(range(5)) if all(x != k for k, x in enumerate(p))}
    found, n = np.unique(got, axis=0, return_counts=True)
    assert {tuple(p) for p in found.tolist()} == want and len(want) == 44
    assert ((n - 1000) ** 2 / 1000).sum() < 88  # chi square with 43 degrees of freedom
    big = N.derangements(12, np.random.default_rng(4).integers(0, PRIME, (500, 11)))
    assert (np.sort(big, axis=1) == np.arange(12)).all() and (big != np.arange(12)).all()
    assert N.derangements(2, np.zeros((1, 1), np.int64)).tolist() == [[1, 0]]
    assert N.pair_cycle_limits(4) == [0, 0, PRIME, 0, PRIME // 3]


def test_calibration_gate(spark):
    g = N.calibration_gate(two_stems(spark))
    assert g.filter("failed").count() == 0
    assert g.count() == 8


def test_missing_delta_drops_the_pair(spark):
    u = one_stem(spark)
    e = S.eligible_pairs(u).select("unit_id", "i")
    d = e.crossJoin(spark.range(101).select(F.col("id").cast("int").alias("pos"))).filter("i <> pos and not (i = 3 and pos = 97)") \
        .select("unit_id", F.lit(0).alias("layer"), F.col("i").alias("mut_pos"), "pos", (F.col("pos") * 1.0).alias("delta"))
    pairs = N.pair_scores(N.attach(u, N.pack_profiles(d)))
    # i = 3 loses its partner; i = 2 and i = 4 keep theirs, their profiles are whole
    assert pairs.filter("ps is null").select("i").collect()[0]["i"] == 3
    assert N.specificity_by_layer(pairs).collect()[0]["n_pairs"] == 9


def test_slice_structure(spark):
    u = units(spark, ("s", "A" * 9, "((.)).().")).select("unit_id", "structure")
    assert S.slice_structure(u, F.lit(1), F.lit(6)).collect()[0]["sliced"] == "(.)..."
    assert S.slice_structure(u, F.lit(5), F.lit(6)).collect()[0]["sliced"] is None


@pytest.mark.skipif("STEMSONDE_PANEL" not in os.environ, reason="no curated panel given")
def test_panel_counts(spark):
    from stemsonde.sources import panel
    u = panel.read_units(spark, os.environ["STEMSONDE_PANEL"])
    q = S.qualify_unit(u, quarantine=F.col("unit_id").isin("tRNA_Phe_yeast", "tRNA_Ala_human")).filter("status = 'scored'")
    assert (u.count(), q.count(), q.filter("not quarantined").count()) == (47, 38, 36)
    c = u.join(q.filter("not quarantined").select("unit_id"), "unit_id", "left_semi")
    assert [N.decoy_coverage(c, "family", w).filter("analysed").count() for w in ("all", "close")] == [17, 9]
    assert N.cross_scores(N.control_profile(c, "oracle")).filter("size(stems) > 0").count() == 35


def test_spans_with_an_overlap_beside_a_hole_and_short_cover(spark):
    from stemsonde.operators.structure import span_coverage, validate_spans
    spans = spark.createDataFrame([("a", 0, 2), ("a", 0, 1), ("a", 3, 4), ("b", 0, 2), ("b", 2, 2), ("b", 2, 4), ("c", 0, 3)], "u string, start int, end int")
    n = spark.createDataFrame([("a", 4), ("b", 4), ("c", 4), ("d", 4), ("e", 0)], "u string, n int")
    assert {r.u: r.ok for r in span_coverage(spans, n, ["u"]).collect()} == {"a": False, "b": True, "c": False, "d": False, "e": True}
    rows = spark.createDataFrame([("x", 0, "ACG", 0, 3), ("x", 1, "ACG", 3, 6), ("y", 0, "ACG", 0, 3), ("z", 0, "ACG", 1, 4), ("w", 0, "ACG", 0, 3)], "u string, row int, piece string, start int, end int")
    n = spark.createDataFrame([("x", 6), ("y", 9), ("z", 4), ("w", 3)], "u string, n int")
    assert {r.u: r.status for r in validate_spans(rows, ["u"], lengths=n).collect()} == {"x": "ok", "y": "does not cover", "z": "does not cover", "w": "ok"}
