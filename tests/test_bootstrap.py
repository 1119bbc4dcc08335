"""Bootstrap draws as matrices inside tasks, against one digest at a time."""

import hashlib

import numpy as np
import pytest

from stemsonde.functions.digests import md5_words
from stemsonde.operators import resampling as R


@pytest.mark.parametrize("length", [0, 1, 25, 55, 56, 64, 119, 120, 200])
def test_digests(length):
    m = np.random.default_rng(length).integers(0, 256, (7, length), dtype=np.uint8)
    assert ["".join(f"{x:08x}" for x in w) for w in md5_words(m).T] == [hashlib.md5(row.tobytes()).hexdigest() for row in m]


def plain(rows, reps, seed):
    """(group, rep) to mean, by definition."""
    steps, out = R.poisson_steps(), {}
    for g, key, x in rows:
        for rep in range(1, reps + 1):
            blk, slot = divmod(rep - 1, R.PER_DRAW)
            h = hashlib.md5("|".join([seed, *([g] if g is not None else []), str(blk), str(key)]).encode()).hexdigest()
            w = sum(int(h[8 * slot: 8 * slot + 8], 16) >= t for t in steps)
            n, s = out.get((g, rep), (0, 0.0))
            out[g, rep] = (n + w, s + w * x)
    return {k: s / n for k, (n, s) in out.items() if n}


def test_replicates_equal_single_digests(spark):
    rows = [(g, k, float(k % 7) - 2.5) for g, n in (("a", 40), ("b|c", 1), (None, 12), ("é", 3)) for k in range(95, 95 + n)]
    df = spark.createDataFrame(rows, "g string, k long, x double")
    got = R.bootstrap_replicates(df, ["g"], "k", ["x"], 50, "s")
    have = {(r["g"], r["rep"]): r["x"] for r in got.collect()}
    want = plain(rows, 50, "s")
    assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-12 for k in want)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_replicates_of_many_groups_and_of_none(spark):
    rows = [(str(k % 150), k, float(k)) for k in range(450)]
    df = spark.createDataFrame(rows, "g string, k long, x double")
    have = {(r["g"], r["rep"]): r["x"] for r in R.bootstrap_replicates(df.coalesce(1), ["g"], "k", ["x"], 6, "s").collect()}
    want = plain(rows, 6, "s")
    assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-9 for k in want)
    whole = {r["rep"]: r["x"] for r in R.bootstrap_replicates(df, [], "k", ["x"], 6, "s").collect()}
    one = plain([(None, k, x) for _, k, x in rows], 6, "s")
    assert all(abs(whole[rep] - x) < 1e-9 for (_, rep), x in one.items()) and len(whole) == 6
    assert R.bootstrap_replicates(df.filter("k < 0"), ["g"], "k", ["x"], 6, "s").count() == 0
