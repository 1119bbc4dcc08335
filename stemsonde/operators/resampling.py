"""Resampling intervals and rank tests.

Statistics are DataFrame aggregates; only the closed-form p-value of an already
aggregated row is computed in Python.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.digests import md5_words
from ..functions.special import binom_high, binom_low, binom_test, mann_whitney_p, t_test_p, wilcoxon_p
from .aggregates import spearman
from .choice import chosen_sums
from .joins import paired_units
from .ranking import bounded_percentile, cumulative_counts, first_by

__all__ = ["binom_test", "binom_ci", "sign_test", "paired_sign", "wilcoxon", "mann_whitney", "paired_t",
           "bootstrap_ci", "bootstrap_excess", "bootstrap_did", "heldout", "layer_selection",
           "depth_correlation", "multiple_testing", "count_gate", "gate_movement", "bh_adjust"]


# ------------------------------------------------------------------ exact tests

def binom_ci(k: Column, n: Column, level: float = 0.95, two_sided: bool = True) -> Column:
    """Clopper-Pearson interval as struct(low, high); one-sided keeps high at 1."""
    tail = F.lit((1.0 - level) / 2.0 if two_sided else 1.0 - level)
    high = binom_high(k, n, tail) if two_sided else F.lit(1.0)
    return F.struct(binom_low(k, n, tail).alias("low"), high.alias("high"))


def sign_test(df: DataFrame, by: Sequence[str], value: str, centre: float = 0.5) -> DataFrame:
    """Exact one-sided sign test; values at the centre leave the denominator."""
    x = F.col(value)
    g = df.filter(x.isNotNull()).groupBy(*by).agg(
        F.count_if(x > centre).alias("above"), F.count_if(x < centre).alias("below"),
        F.count_if(x == centre).alias("at_half")).withColumn("n_sign", F.col("above") + F.col("below"))
    return g.withColumn("p", binom_test(F.col("above"), F.col("n_sign"), F.lit(0.5)))


def paired_sign(a: DataFrame, b: DataFrame, by: Sequence[str], unit: str, value: str) -> DataFrame:
    """Units where a beats b among the shared ones, with its binomial p."""
    m = paired_units(a, b, [*by, unit], value)
    g = m.groupBy(*by).agg(F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count(F.lit(1)).alias("total"))
    return g.withColumn("p", binom_test(F.col("wins"), F.col("total"), F.lit(0.5)))


# ------------------------------------------------------------------ rank tests

def wilcoxon(df: DataFrame, x: str, by: Sequence[str], alternative: str = "two-sided") -> DataFrame:
    """Signed-rank statistic over non-zero values (average ranks), and its p."""
    nz = df.filter(F.col(x).isNotNull() & (F.col(x) != 0)).withColumns(
        {"__m": F.abs(x), "__up": (F.col(x) > 0).cast("long")})
    mags = nz.groupBy(*by, "__m").agg(F.count(F.lit(1)).alias("n"), F.sum("__up").alias("up"))
    r = cumulative_counts(mags, by, "__m")
    ties = F.col("n") * F.col("n") * F.col("n") - F.col("n")
    g = r.groupBy(*by).agg(F.sum(F.col("up") * F.col("avg_rank")).alias("w_plus"), F.sum("n").alias("n"),
                           F.sum(ties).cast("double").alias("tie_term"))
    zeros = df.groupBy(*by).agg(F.count_if(F.col(x) == 0).alias("n_zero"))
    g = zeros.join(g, list(by), "left") if by else zeros.withColumn("__k", F.lit(0)).join(
        g.withColumn("__k", F.lit(0)), "__k", "left").drop("__k")
    return g.withColumn("p", wilcoxon_p("w_plus", F.col("n").cast("double"), "tie_term",
                                        F.col("n_zero").cast("double"), F.lit(alternative)))


def mann_whitney(df: DataFrame, x: str, first: Column, by: Sequence[str], alternative: str = "two-sided") -> DataFrame:
    """U of the rows where ``first`` holds against the others, rank-biserial effect, p."""
    v = df.filter(F.col(x).isNotNull()).withColumn("__f", first.cast("long"))
    vals = v.groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"), F.sum("__f").alias("n_first"))
    r = cumulative_counts(vals, by, x)
    ties = F.col("n") * F.col("n") * F.col("n") - F.col("n")
    g = r.groupBy(*by).agg(F.sum("n_first").alias("n1"), F.sum(F.col("n") - F.col("n_first")).alias("n2"),
                           F.sum(F.col("n_first") * F.col("avg_rank")).alias("rank_sum"),
                           F.sum(ties).cast("double").alias("tie_term"))
    g = g.withColumn("u", F.col("rank_sum") - F.col("n1") * (F.col("n1") + 1) / 2.0)
    pairs = F.col("n1").cast("double") * F.col("n2")
    return g.withColumns({
        "effect": F.when(pairs > 0, 2.0 * F.col("u") / pairs - 1.0),
        "p": mann_whitney_p("u", F.col("n1").cast("double"), F.col("n2").cast("double"), "tie_term", F.lit(alternative))})


def paired_t(df: DataFrame, a: str, b: str, by: Sequence[str]) -> DataFrame:
    """Paired t statistic and two-sided p."""
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("__d", F.col(a).cast("double") - F.col(b))
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("__d").alias("mean_diff"), F.stddev_samp("__d").alias("sd_diff"))
    t = F.when((F.col("n") >= 2) & (F.col("sd_diff") > 0), F.col("mean_diff") / (F.col("sd_diff") / F.sqrt("n")))
    return g.withColumn("t", t).withColumn("p", t_test_p("t", (F.col("n") - 1).cast("double")))


# ------------------------------------------------------------------ bootstrap

PER_DRAW = 4  # 32-bit draws in one digest


def poisson_steps(bits: int = 32) -> list[int]:
    """Where a draw of so many bits passes from one Poisson(1) count to the next."""
    steps, term, total, k = [], math.exp(-1), math.exp(-1), 0
    while (at := int(total * 2**bits)) < 2**bits - 1 and (not steps or at > steps[-1]):
        steps.append(at)
        k += 1
        term /= k
        total += term
    return steps


def bootstrap_replicates(df: DataFrame, by: Sequence[str], key: str, values: Sequence[str], reps: int, seed: str) -> DataFrame:
    """Replicate means of every value column on the same draws.

    The Poisson bootstrap: in each replicate a unit counts as often as a Poisson(1) draw keyed by replicate and unit
    says, and a mean is sum(w x) / sum(w).  Against n draws with replacement only the total number of draws varies.
    No unit has to meet another one, so draws are made and summed where the rows lie, as matrices of replicates and
    units: reps x groups partial sums a task are all that is exchanged, whatever the number of units, and no row is made
    for a draw.  Values are not null.  A replicate without any unit has no mean and is left out.
    """
    kinds = dict(df.dtypes)
    rows = df.select(*by, F.concat_ws("|", F.lit(seed), *[F.col(b).cast("string") for b in by]).alias("__head"),
                     F.coalesce(F.concat(F.lit("|"), F.col(key).cast("string")), F.lit("")).alias("__tail"),
                     *[F.col(v).cast("double").alias(f"__v{k}") for k, v in enumerate(values)])
    sums = [f"__s{k}" for k in range(len(values))]
    schema = "".join(f"`{b}` {kinds[b]}, " for b in by) + ", ".join(f"{c} array<double>" for c in ("__n", *sums))
    parts = rows.mapInArrow(_replicate_sums(list(by), len(values), reps), schema)
    cells = F.arrays_zip(F.sequence(F.lit(1), F.lit(reps)).alias("rep"), "__n", *sums)
    per = parts.select(*by, F.inline(cells)).groupBy(*by, "rep").agg(F.sum("__n").alias("__n"), *[F.sum(c).alias(c) for c in sums])
    return per.filter("__n > 0").select(*by, "rep", *[(F.col(c) / F.col("__n")).alias(v) for c, v in zip(sums, values)])


DRAWN, GROUPS = 16_384, 64  # digests at a time; groups whose sums a task holds before it hands them on


def _replicate_sums(by: list[str], n_values: int, reps: int):
    steps = np.array(poisson_steps(), np.uint32)
    blocks = (reps - 1) // PER_DRAW + 1

    def weights(head: bytes, tails: np.ndarray, first: int, last: int) -> np.ndarray:
        """Counts of units (columns) in the replicates of blocks first..last - 1, all of as many digits."""
        numbers = [np.frombuffer(head + b"|%d" % b, np.uint8) for b in range(first, last)]
        n, before = len(tails), len(numbers[0])
        text = np.empty((last - first, n, before + tails.shape[1]), np.uint8)
        text[:, :, :before] = np.array(numbers)[:, None, :]
        text[:, :, before:] = tails
        u = md5_words(text.reshape(-1, text.shape[2])).reshape(PER_DRAW, last - first, n)
        w = np.zeros(u.shape, np.uint8)
        for t in steps:
            w += u >= t
        return w.transpose(1, 0, 2).reshape(-1, n).astype(np.float64)

    def add(total: np.ndarray, head: bytes, tails: np.ndarray, x: np.ndarray) -> None:
        at = 0
        while at < blocks:
            end = min(blocks, 10 ** len(str(at)), at + max(1, DRAWN // len(tails)))
            got = weights(head, tails, at, end) @ x
            here = total[at * PER_DRAW: end * PER_DRAW]
            here += got[: len(here)]
            at = end

    def emit(totals, types):
        keys = list(zip(*totals)) if by else []
        sums = [pa.array([t[:, k] for t in totals.values()], pa.list_(pa.float64())) for k in range(n_values + 1)]
        return pa.RecordBatch.from_arrays([*[pa.array(k, t) for k, t in zip(keys, types)], *sums],
                                          names=[*by, "__n", *[f"__s{k}" for k in range(n_values)]])

    def run(batches):
        totals, types = {}, []
        for batch in batches:
            types = [batch.column(b).type for b in by]
            heads, tails = (batch.column(c).to_pylist() for c in ("__head", "__tail"))
            tails = [t.encode() for t in tails]
            x = np.stack([np.ones(batch.num_rows), *[batch.column(f"__v{k}").to_numpy(zero_copy_only=False) for k in range(n_values)]], axis=1)
            groups = {}
            for i, g in enumerate(zip(zip(*[batch.column(b).to_pylist() for b in by]) if by else [()] * len(heads), map(len, tails))):
                groups.setdefault(g, []).append(i)
            for (g, length), at in groups.items():
                if g not in totals:
                    if len(totals) == GROUPS:
                        yield emit(totals, types)
                        totals = {}
                    totals[g] = np.zeros((reps, n_values + 1))
                for some in np.split(np.array(at), range(DRAWN, len(at), DRAWN)):
                    text = np.frombuffer(b"".join([tails[i] for i in some]), np.uint8).reshape(len(some), length)
                    add(totals[g], heads[some[0]].encode(), text, x[some])
        if totals:
            yield emit(totals, types)
    return run


def _interval(replicates: DataFrame, by: Sequence[str], value: Column, level: float) -> DataFrame:
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    return replicates.groupBy(*by).agg(bounded_percentile(value, lo).alias("ci_low"),
                                       bounded_percentile(value, hi).alias("ci_high"))


def bootstrap_ci(df: DataFrame, by: Sequence[str], key: str, value: str, reps: int = 10_000, seed: str = "42",
                 level: float = 0.95) -> DataFrame:
    """Percentile interval of a mean, or of a fraction when the value is 0/1."""
    df = df.filter(F.col(value).isNotNull())
    point = df.groupBy(*by).agg(F.avg(F.col(value).cast("double")).alias("point"), F.count(F.lit(1)).alias("n"))
    r = bootstrap_replicates(df, by, key, [value], reps, seed)
    return point.join(_interval(r, by, F.col(value), level), list(by))


def bootstrap_excess(df: DataFrame, by: Sequence[str], key: str, observed: str, chance: str,
                     reps: int = 10_000, seed: str = "42", level: float = 0.95) -> DataFrame:
    """Unit-clustered interval of mean observed minus mean chance, resampled together."""
    df = df.filter(F.col(observed).isNotNull() & F.col(chance).isNotNull())
    point = df.groupBy(*by).agg((F.avg(observed) - F.avg(chance)).alias("point"), F.count(F.lit(1)).alias("n"))
    r = bootstrap_replicates(df, by, key, [observed, chance], reps, seed)
    return point.join(_interval(r, by, F.col(observed) - F.col(chance), level), list(by)) \
        .withColumn("holds", F.col("ci_low") > 0)


VOID_BELOW = 33  # fixed value


def bootstrap_did(cells: DataFrame, by: Sequence[str], key: str, arms: Sequence[str], tests: dict[str, dict[str, int]],
                  reps: int = 10_000, seed: str = "42", void_below: int = VOID_BELOW,
                  manipulation: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Signed sums of arm excesses over the units common to all arms, one draw for all.

    cells(by…, key, arm, precision, chance); ``tests`` maps a name to arm weights.
    ``manipulation`` lists (lower, higher) arm pairs whose precision must differ
    that way; a group failing it, or with too few units in an arm, is void.
    """
    wide = cells.groupBy(*by, key).pivot("arm", list(arms)).agg(
        F.first("precision").alias("p"), F.first("chance").alias("c"))
    per_arm = wide.groupBy(*by).agg(F.least(*[F.count(f"{a}_p") for a in arms]).alias("fewest"))
    full = wide.filter(_all_present(arms))
    ex = full.select(*by, key, *[(F.col(f"{a}_p") - F.col(f"{a}_c")).alias(f"x_{a}") for a in arms],
                     *[F.col(f"{a}_p").alias(f"p_{a}") for a in arms])
    stat = lambda w: sum((F.lit(float(k)) * F.col(f"x_{a}") for a, k in w.items()), F.lit(0.0))
    scored = ex.select(*by, key, *[stat(w).alias(n) for n, w in tests.items()])
    ok = F.lit(True)
    for low, high in manipulation:
        ok = ok & (F.avg(f"p_{low}") < F.avg(f"p_{high}"))
    head = ex.groupBy(*by).agg(F.count(F.lit(1)).alias("n_common"), ok.alias("manipulated"))
    r = bootstrap_replicates(scored, by, key, list(tests), reps, seed)
    point = scored.groupBy(*by).agg(*[F.avg(n).alias(n) for n in tests])
    long = lambda df, out, keep=(): df.select(*by, *keep, F.inline(F.array(*[
        F.struct(F.lit(n).alias("test"), F.col(n).alias(out)) for n in tests])))
    ci = _interval(long(r, "v", ["rep"]), [*by, "test"], F.col("v"), 0.95)
    out = long(point, "point").join(ci, [*by, "test"])
    both = head.join(per_arm, list(by)) if by else head.withColumn("__k", F.lit(0)).join(
        per_arm.withColumn("__k", F.lit(0)), "__k").drop("__k")
    out = out.join(both, list(by)) if by else out.withColumn("__k", F.lit(0)).join(
        both.withColumn("__k", F.lit(0)), "__k").drop("__k")
    void = (F.col("fewest") < void_below) | ~F.col("manipulated")
    return out.withColumns({"void": void, "holds": ~void & (F.col("ci_low") > 0)}).drop("fewest", "manipulated")


def _all_present(arms: Sequence[str]) -> Column:
    ok = F.lit(True)
    for a in arms:
        ok = ok & F.col(f"{a}_p").isNotNull() & F.col(f"{a}_c").isNotNull()
    return ok


# ------------------------------------------------------------------ layer choice

def heldout(rows: DataFrame, by: Sequence[str], splits: int = 2_000, seed: str = "42", unit: str = "unit_id", block: int | None = None) -> DataFrame:
    """Per split: layer chosen on one half, precision and chance read on the other.

    rows(by…, unit, layer, ps, precision, chance).  The half that chooses is the n // 2
    units with the smallest draws (``choice``), so units are exchanged once and after
    that only sums by split and layer, whatever the number of units.
    """
    by = list(by)
    values = ("ps", "precision", "chance")
    cell = lambda k: F.struct((F.col("layer") * len(values) + k).cast("int").alias("cell"), F.col(values[k]).cast("double").alias("value"))
    packed = rows.groupBy(*by, unit).agg(F.flatten(F.collect_list(F.array(*[cell(k) for k in range(len(values))]))).alias("__v"))
    half = F.floor(F.count(F.lit(1)) / 2)
    sums = chosen_sums(packed, by, F.lit("all"), unit, half, F.lit(False), "__v", splits, seed, block)
    of = lambda k, side: F.max(F.when((F.pmod("cell", F.lit(len(values))) == k) & (F.col(f"n_{side}") > 0), F.col(f"s_{side}") / F.col(f"n_{side}"))).alias(values[k])
    per = sums.groupBy(*by, F.col("rep").alias("split"), F.floor(F.col("cell") / len(values)).cast("int").alias("layer")).agg(of(0, "in"), of(1, "out"), of(2, "out"))
    return first_by(per, [*by, "split"], "ps", ["layer"], ["precision", "chance"])


def heldout_summary(draws: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and 95% interval over the splits."""
    return draws.groupBy(*by).agg(
        F.avg("precision").alias("heldout"), F.avg("chance").alias("chance_heldout"),
        bounded_percentile(F.col("precision"), 0.025).alias("ci_low"),
        bounded_percentile(F.col("precision"), 0.975).alias("ci_high"), F.count(F.lit(1)).alias("n_splits"))


def layer_selection(rows: DataFrame, by: Sequence[str], unit: str = "unit_id") -> DataFrame:
    """Precision and chance with the layer chosen per unit, and with one panel layer."""
    by = list(by)
    own = first_by(rows, [*by, unit], "ps", ["layer"], ["precision", "chance"])
    per_unit = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n_units"), F.avg("precision").alias("per_unit"),
                                    F.avg("chance").alias("chance_per_unit"))
    per = rows.groupBy(*by, "layer").agg(F.avg("ps").alias("ps"), F.avg("precision").alias("precision"), F.avg("chance").alias("chance"))
    panel = first_by(per, by, "ps", ["layer"], ["precision", "chance"]).select(
        *by, F.col("layer").alias("panel_layer"), F.col("precision").alias("panel"), F.col("chance").alias("chance_panel"))
    layers = rows.groupBy(*by).agg(F.countDistinct("layer").alias("n_layers"))
    return per_unit.join(panel, by).join(layers, by)


def selection_problems(rows: DataFrame, stored: DataFrame, by: Sequence[str], unit: str = "unit_id", tol: float = 1e-9) -> DataFrame:
    """Units whose stored precision is not the per-layer value at their best layer."""
    keys = [*by, unit]
    s = stored.select(*keys, "best_layer", F.col("precision").alias("stored"))
    m = s.join(rows.select(*keys, F.col("layer").alias("best_layer"), "precision"), [*keys, "best_layer"], "left")
    return m.filter(F.col("precision").isNull() | (F.abs(F.col("stored") - F.col("precision")) > tol))


def depth_correlation(selection: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of layers against the gain of the per-unit choice, over runs (one row each)."""
    g = selection.withColumn("gain", F.col("per_unit") - F.col("panel")).withColumn("__g", F.lit(0))
    return spearman(g, "n_layers", "gain", [*by, "__g"], bounded=True).drop("__g")


# ------------------------------------------------------------------ multiplicity

def multiple_testing(scores: DataFrame, by: Sequence[str], exceeds: str, alpha: float = 0.05) -> DataFrame:
    """Tests, exceedances, expected false positives, Bonferroni alpha, excess."""
    g = scores.groupBy(*by).agg(F.count(exceeds).alias("n_tested"), F.count_if(exceeds).alias("n_exceeding"))
    return g.withColumns({
        "expected_fp": F.round(F.col("n_tested") * alpha, 2),
        "bonferroni_alpha": F.round(F.when(F.col("n_tested") > 0, alpha / F.col("n_tested")).otherwise(0.0), 4),
        "excess": F.when(F.col("n_tested") > 0, F.col("n_exceeding") - F.col("n_tested") * alpha).otherwise(0.0)})


def count_gate(n: Column, multiplier: int = 4, alpha_percent: int = 5) -> Column:
    """ceil(multiplier * alpha * n), in integers so that no rounding can move it."""
    return F.ceil(n * F.lit(multiplier * alpha_percent) / F.lit(100)).cast("long")


def gate_movement(counts: DataFrame, by: Sequence[str], scenarios: dict[str, Column]) -> DataFrame:
    """The gate and the verdict at every scenario's N: counts(by…, exceed)."""
    rows = F.array(*[F.struct(F.lit(k).alias("scenario"), v.cast("long").alias("n")) for k, v in scenarios.items()])
    s = counts.select(*by, "exceed", F.inline(rows)).withColumn("gate", count_gate(F.col("n")))
    return s.withColumns({"passes": F.col("exceed") >= F.col("gate"), "margin": F.col("exceed") - F.col("gate")})


def bh_adjust(df: DataFrame, p: str, by: Sequence[str], key: str, out: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg: running minimum of p n / rank from the largest p.

    The minimum is a scan over distinct p-values in two passes: of each of the ordered
    buckets of the ranking, then within a bucket from the least of those after it, so one
    large family of tests is not sorted in one task, wherever its p-values crowd.
    """
    by = list(by) or ["__g"]
    src = df if by != ["__g"] else df.withColumn("__g", F.lit(0))
    vals = src.filter(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("n"))
    cum = cumulative_counts(vals, by, p, bucket="__cut")
    # tied p-values share the adjusted value of the last of them
    cut = cum.withColumn("__q", F.col(p) * F.col("total") / (F.col("lo") + F.col("n")))
    per = cut.groupBy(*by, "__cut").agg(F.min("__q").alias("__m"))
    after = W.partitionBy(*by).orderBy("__cut").rowsBetween(1, W.unboundedFollowing)
    per = per.withColumn("__later", F.min("__m").over(after)).drop("__m")
    inside = W.partitionBy(*by, "__cut").orderBy(p).rowsBetween(0, W.unboundedFollowing)
    got = cut.withColumn("__here", F.min("__q").over(inside)).join(per, [*by, "__cut"])
    adj = got.select(*by, p, F.least("__here", F.coalesce("__later", F.col("__here"))).alias(out))
    return src.join(adj, [*by, p]).drop("__g")
