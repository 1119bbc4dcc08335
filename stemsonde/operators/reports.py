"""Panel audits and report tables over stored results.

Tables are relations: text rendering is left to the reader of the table.  Result
rows carry model (the run), unit_id and the columns of the stored results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import brackets as B
from ..functions.binding import let
from ..functions.special import binom_test
from . import aggregates as G
from . import resampling as R
from .joins import paired_units, salted_join
from .ranking import exact_quantiles, first_by
from .structure import annotate, noncanonical_of, spread

UNIT = "unit_id"


def confirmatory(scores: DataFrame) -> DataFrame:
    """Adds ``excluded_because``: null for the confirmatory population."""
    why = (F.when(F.col("quarantined"), "quarantined")
           .when(F.col("status") == "skipped", F.concat(F.lit("skipped: "), F.coalesce("reason", F.lit("no reason recorded"))))
           .when(~F.coalesce("gate_pass", F.lit(False)), "failed the positive control"))
    return scores.withColumn("excluded_because", why)


# ------------------------------------------------------------------ panel audits

# Thresholds of the annotation repair.
DEFECT, CLEAN, MAX_LENGTH_DELTA = 0.25, 0.05, 0.30


def integrity(units: DataFrame, accession: str = "accession", expected: int | None = None) -> DataFrame:
    """findings(finding, subject, detail): duplicates, reused accessions, length
    disagreement, imbalance, non-canonical pairs above a quarter, panel count."""
    text = lambda c: c.cast("string")
    span = F.concat(text(F.col("first_unit")), F.lit(".."), text(F.col("last_unit")))
    dup = G.duplicate_groups(units, F.col("sequence")).select(
        F.lit("duplicate sequence").alias("finding"), span.alias("subject"), text(F.col("copies")).alias("detail"))
    acc = units.filter(F.col(accession).isNotNull()).groupBy(accession).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        F.lit("reused accession").alias("finding"), text(F.col(accession)).alias("subject"), text(F.col("n")).alias("detail"))
    n, m = F.length("sequence"), F.length("structure")
    opens, closes = B.count_of(F.col("structure"), "("), B.count_of(F.col("structure"), ")")
    u = units.select(UNIT, "sequence", "structure")
    length = u.filter(n != m).select(F.lit("length disagreement").alias("finding"), text(F.col(UNIT)).alias("subject"),
                                     F.concat_ws(" vs ", text(n), text(m)).alias("detail"))
    tilt = u.filter((n == m) & (opens != closes)).select(
        F.lit("unbalanced structure").alias("finding"), text(F.col(UNIT)).alias("subject"), F.concat_ws(" vs ", text(opens), text(closes)).alias("detail"))
    whole = annotate(u.filter((n == m) & (opens == closes)), keep_pairs=True)
    share = F.when(F.size("pairs") > 0, 1 - F.size("canonical") / F.size("pairs")).otherwise(0.0)
    odd = whole.select(UNIT, share.alias("s")).filter(F.col("s") > DEFECT).select(
        F.lit("non-canonical pairs").alias("finding"), text(F.col(UNIT)).alias("subject"), text(F.round("s", 4)).alias("detail"))
    out = dup.unionByName(acc).unionByName(length).unionByName(tilt).unionByName(odd)
    if expected is not None:
        count = units.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != expected).select(
            F.lit("panel reconciliation").alias("finding"), F.lit("panel").alias("subject"),
            F.concat_ws(" vs ", text(F.col("n")), F.lit(str(expected))).alias("detail"))
        out = out.unionByName(count)
    return out


def requalify(units: DataFrame) -> DataFrame:
    """Adds canonical and eligible counts and the qualifying flag, null without a sequence."""
    counts = let(B.anatomy(F.col("sequence"), F.col("structure")), lambda a: F.struct(
        F.size(a["canonical"]).alias("n_canonical"), F.size(a["eligible"]).alias("n_eligible")))
    q = units.withColumn("__q", F.when(F.col("sequence").isNotNull() & F.col("structure").isNotNull(), counts))
    n, e = F.col("__q.n_canonical"), F.col("__q.n_eligible")
    return q.select(*units.columns, n.alias("n_canonical"), e.alias("n_eligible"), ((n >= 15) & (e >= 5)).alias("qualifies"))


def repair(units: DataFrame, members: DataFrame, family: str = "family") -> DataFrame:
    """Repair disposition per unit, by the first rule that applies.

    units(unit_id, family, sequence, structure, keeps_subdomain, keeps_organism),
    members(family, member, sequence, structure).  Members are reduced to one per
    (family, sequence) and one clean one per (family, length) before they meet a
    unit, so a large family is never paired with its units member by member.
    """
    share = noncanonical_of(F.col("sequence"), F.col("structure"))["fraction"]
    u = spread(units).withColumn("before", share)
    m = spread(members, "member").withColumn("fraction", share)
    known = members.select(family).distinct().withColumn("has_seed", F.lit(True))
    exact = m.groupBy(family, "sequence").agg(F.min(F.struct("member", "structure")).alias("exact"))
    clean = m.filter(F.col("fraction") <= CLEAN).groupBy(family, F.length("sequence").alias("len")).agg(
        F.min(F.struct("member", "sequence", "structure")).alias("c"))
    # a family's clean ones, one of a length, as one row: units meet them once, and no share is found twice
    packed = clean.groupBy(family).agg(F.collect_list(F.struct("len", "c")).alias("clean"))
    gaps = F.transform("clean", lambda x: F.struct(
        F.abs(x["len"] - F.length("sequence")).alias("gap"), x["c"]["member"].alias("member"), x["c"]["sequence"].alias("sequence"), x["c"]["structure"].alias("structure")))
    d = (u.join(known, family, "left").join(exact, [family, "sequence"], "left").join(packed, family, "left")
         .withColumn("has_clean", F.col("clean").isNotNull()).withColumn("near", F.when(F.col("before") > DEFECT, F.array_min(gaps))))
    delta = F.col("near.gap") / F.length("sequence")
    what = (F.when(F.col("before") <= DEFECT, "NO REPAIR").when(F.col("has_seed").isNull(), "DROP")
            .when(F.col("exact").isNotNull(), "ADOPT STRUCTURE").when(~F.col("has_clean"), "DROP")
            .when(F.col("keeps_subdomain"), "DROP").when(F.col("keeps_organism"), "DEFER")
            .when(delta > MAX_LENGTH_DELTA, "DROP").otherwise("ADOPT MEMBER"))
    d = d.withColumn("disposition", what)
    own, other = F.col("disposition") == "ADOPT STRUCTURE", F.col("disposition") == "ADOPT MEMBER"
    seq = F.when(own, F.col("sequence")).when(other, F.col("near.sequence"))
    st = F.when(own, F.col("exact.structure")).when(other, F.col("near.structure"))
    return requalify(d.select(
        UNIT, "disposition", "before", F.when(own, F.col("exact.member")).when(other, F.col("near.member")).alias("accession"),
        seq.alias("sequence"), st.alias("structure")))


# ------------------------------------------------------------------ report tables

def ratio_table(scores: DataFrame, attention: DataFrame, probe: DataFrame, by: Sequence[str] = ("model",),
                key: str = UNIT, reps: int = 10_000, seed: str = "42") -> DataFrame:
    """Mean ratio, interval, exceed count, mean attention agreement, probe minus one half."""
    base = G.summarise_ratio(scores, by, exceeds="exceeds_primary")
    ci = R.bootstrap_ci(scores, by, key, "ratio", reps, seed).select(*by, "ci_low", "ci_high")
    att = attention.groupBy(*by).agg(F.avg("best_corr").alias("attention"))
    pr = probe.groupBy(*by).agg((F.max("accuracy") - 0.5).alias("probe_gain"))
    return base.join(ci, list(by)).join(att, list(by), "left").join(pr, list(by), "left")


def retention_table(scores: DataFrame, by: Sequence[str], first: str, second: str, key: str = UNIT,
                    reps: int = 10_000, seed: str = "42") -> DataFrame:
    """Units past the first null, how many survive the second, the share and its interval."""
    past = scores.filter(F.coalesce(F.col(first), F.lit(False))).withColumn(
        "__s", F.coalesce(F.col(second), F.lit(False)).cast("int"))
    n = past.groupBy(*by).agg(F.count(F.lit(1)).alias("exceeding"), F.sum("__s").alias("surviving"))
    ci = R.bootstrap_ci(past, by, key, "__s", reps, seed).select(*by, F.col("point").alias("retention"), "ci_low", "ci_high")
    return n.join(ci, list(by))


def control_table(base: DataFrame, control: DataFrame, by: Sequence[str], score: str = "ratio") -> DataFrame:
    """Mean under the substitution and its control, % change, largest change first."""
    a = base.groupBy(*by).agg(F.avg(score).alias("base"))
    c = control.groupBy(*by).agg(F.avg(score).alias("control"))
    out = a.join(c, list(by)).withColumn("change", (F.col("control") - F.col("base")) / F.col("base") * 100.0)
    return out.orderBy(F.desc(F.abs("change")), *by)


# Fixed value: a difference below this is read as architectural.
ARCHITECTURAL_DELTA = 0.05


def trained_vs_control(trained: DataFrame, control: DataFrame, by: Sequence[str], score: str,
                       threshold: float = ARCHITECTURAL_DELTA) -> DataFrame:
    """Mean of per-unit ratios, ratio of means, difference of means and its reading."""
    m = paired_units(trained, control, [*by, UNIT], score)
    live = F.col("b") > 0
    g = m.groupBy(*by).agg(
        F.avg(F.when(live, F.col("a") / F.col("b"))).alias("mean_of_ratios"),
        (F.avg(F.when(live, F.col("a"))) / F.avg(F.when(live, F.col("b")))).alias("ratio_of_means"),
        (F.avg("a") - F.avg("b")).alias("delta"), F.count(F.lit(1)).alias("n"))
    reading = (F.when(F.abs("delta") < threshold, "architectural").when(F.col("delta") > 0, "learned")
               .otherwise("control exceeds trained"))
    return g.withColumn("reading", reading)


def verdicts(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules met and failed: values(key, metric, value) against
    rules(tag, key, metric, test, bound), test one of > >= < <=."""
    v, b = F.col("value"), F.col("bound")
    met = (F.when(F.col("test") == ">", v > b).when(F.col("test") == ">=", v >= b)
           .when(F.col("test") == "<", v < b).when(F.col("test") == "<=", v <= b))
    j = rules.join(values, ["key", "metric"], "left")
    return j.select("tag", "key", "metric", "test", "bound", "value", F.when(F.coalesce(met, F.lit(False)), "PASS").otherwise("FAIL").alias("verdict"))


def claim_failures(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Threshold claims that do not hold."""
    return verdicts(values, rules).filter(F.col("verdict") == "FAIL").drop("verdict")


def ordering_failures(values: DataFrame, orders: DataFrame) -> DataFrame:
    """Ordering claims that do not hold: orders(tag, metric, higher, lower)."""
    hi = values.select("metric", F.col("key").alias("higher"), F.col("value").alias("high_value"))
    lo = values.select("metric", F.col("key").alias("lower"), F.col("value").alias("low_value"))
    j = orders.join(hi, ["metric", "higher"], "left").join(lo, ["metric", "lower"], "left")
    return j.filter(~F.coalesce(F.col("high_value") > F.col("low_value"), F.lit(False)))


def metric_values(summary: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """A summary table as (key, metric, value) rows."""
    return summary.select(F.col(key).alias("key"), F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))


RETAIN_FLOOR = 0.05


def synthetic_table(scores: DataFrame, by: Sequence[str] = ("model",), arm: str = "arm") -> DataFrame:
    """Mean PS and excess precision on natural and synthetic sequences, and the share
    of the natural excess retained where there is any to retain."""
    ok = F.col("chance_fraction").isNotNull()
    g = scores.groupBy(*by).pivot(arm, ["natural", "synthetic"]).agg(
        F.avg("best_ps").alias("ps"), F.count_if(ok).alias("n"),
        (F.avg(F.when(ok, F.col("h3_fraction"))) - F.avg("chance_fraction")).alias("excess"))
    keep = F.when(F.col("natural_excess") >= RETAIN_FLOOR, F.col("synthetic_excess") / F.col("natural_excess"))
    return g.withColumn("retained", keep)


def arm_count_problems(scores: DataFrame, by: Sequence[str] = ("model",), arm: str = "arm") -> DataFrame:
    """Arms whose runs were scored over different numbers of units."""
    n = scores.groupBy(*by, arm).agg(F.count("chance_fraction").alias("n"))
    return n.groupBy(arm).agg(F.countDistinct("n").alias("sizes"), F.min("n").alias("least"), F.max("n").alias("most")).filter("sizes > 1")


def replicate_table(per_origin: DataFrame, excluded: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Replicate summary per run, by mean ratio, with guards: every run has the same
    counts and the same set of exclusions."""
    s = G.replicate_summary(per_origin, by)
    digest = excluded.groupBy(*by).agg(F.count(F.lit(1)).alias("n_excluded"), F.sum(F.xxhash64(UNIT).cast("decimal(38,0)")).alias("__d"))
    s = s.join(digest, list(by), "left").fillna({"n_excluded": 0})
    same = lambda *cols: s.agg(*[F.countDistinct(c).alias(f"k{n}") for n, c in enumerate(cols)]).select(
        F.greatest(*[F.col(f"k{n}") for n in range(len(cols))], F.lit(1)) == 1).scalar()
    none = F.coalesce("__d", F.lit(0).cast("decimal(38,0)"))
    return s.withColumns({"same_counts": same("n_units_scored", "n_total_sequences"), "same_exclusions": same(none)}) \
        .drop("__d").orderBy(F.desc("mean_ratio"), *by)


def graded_table(distances: DataFrame, scores: DataFrame, by: Sequence[str], grade: str, layer: str = "layer") -> DataFrame:
    """Per run: units scored and over null, distance of the largest grade at the last and
    the first layer, and how the first layer tracks the grade."""
    low_high = distances.groupBy(*by).agg(F.min(layer).alias("__lo"), F.max(layer).alias("__hi"), F.max(grade).alias("__top"),
                                          (F.max(layer) + 1).alias("n_layers"))
    d = distances.join(low_high, list(by))
    top = d.filter(F.col(grade) == F.col("__top")).groupBy(*by).agg(
        F.max(F.when(F.col(layer) == F.col("__hi"), F.col("distance"))).alias("top_last"),
        F.max(F.when(F.col(layer) == F.col("__lo"), F.col("distance"))).alias("top_first"))
    rho = G.spearman(d.filter(F.col(layer) == F.col("__lo")), grade, "distance", by, bounded=True).select(*by, F.col("rho").alias("rho_first"))
    s = scores.groupBy(*by).agg(F.avg("ratio").alias("mean_ratio"), F.count("ratio").alias("scored"), F.count_if("exceeds_primary").alias("exceeding"))
    return s.join(low_high.select(*by, "n_layers"), list(by)).join(top, list(by)).join(rho, list(by))


NEAR_ZERO, QUIET = 1e-8, 1e-12


def robustness(scores: DataFrame, layers: DataFrame, by: Sequence[str] = ("model",), near_zero: float = NEAR_ZERO) -> DataFrame:
    """Mean against median, best against last layer, no-op floor, and whether the mean is near zero."""
    last = layers.groupBy(*by, UNIT).agg(F.max_by("ps", "layer").alias("last_ps"))
    s = scores.join(last, [*by, UNIT], "left")
    g = s.groupBy(*by).agg(F.count("best_ps").alias("n"), F.avg("best_ps").alias("mean_ps"), F.avg("last_ps").alias("mean_last"),
                           F.avg("noop").alias("mean_noop"), F.max(F.abs("noop")).alias("max_noop"))
    g = g.join(exact_quantiles(scores, by, "best_ps", {"median_ps": 0.5}), list(by))
    return g.withColumns({"median_change": F.col("median_ps") / F.col("mean_ps") - 1.0, "last_change": F.col("mean_last") / F.col("mean_ps") - 1.0,
                          "near_zero": F.abs("mean_ps") < near_zero, "noop_quiet": F.col("max_noop") < QUIET})


def unit_pivot(scores: DataFrame, models: Sequence[str], score: str = "ratio", exceeds: str = "exceeds_primary") -> DataFrame:
    """One row per unit, score and exceed mark per run."""
    return scores.groupBy(UNIT).pivot("model", list(models)).agg(F.first(score).alias("score"), F.first(exceeds).alias("exceeds"))


def false_positive_audit(scores: DataFrame, stratum: Column, exceeds: str = "exceeds_primary", nominal: float = 0.05) -> DataFrame:
    """Exceedance rate per run, per stratum and pooled, with the exact one-sided p and
    Clopper-Pearson limits."""
    g = scores.withColumn("stratum", stratum).rollup("stratum", "model").agg(
        F.count(F.lit(1)).alias("trials"), F.count_if(exceeds).alias("hits"))
    g = g.withColumns({"rate": F.col("hits") / F.col("trials"), "p": binom_test("hits", "trials", F.lit(nominal))})
    return g.withColumn("ci", R.binom_ci(F.col("hits"), F.col("trials"))).select("stratum", "model", "trials", "hits", "rate", "p", "ci.low", "ci.high")


def repeat_exceeders(scores: DataFrame, exceeds: str = "exceeds_primary", least: int = 2) -> DataFrame:
    """Units exceeding in at least ``least`` runs."""
    return scores.filter(F.col(exceeds)).groupBy(UNIT).agg(F.countDistinct("model").alias("runs")).filter(F.col("runs") >= least)


def selection_bias(scores: DataFrame, layers: DataFrame, by: Sequence[str] = ("model",), alpha: float = 0.05) -> DataFrame:
    """Predicted size 1 - (1 - alpha)^L of a maximum over L layers, against both observed rates."""
    per_unit = layers.groupBy(*by, UNIT).agg(F.count(F.lit(1)).alias("l"))
    n = exact_quantiles(per_unit, by, "l", {"n_layers": 0.5}).withColumn("n_layers", F.floor("n_layers"))
    g = scores.groupBy(*by).agg(F.avg(F.col("exceeds_primary").cast("double")).alias("primary_rate"),
                                F.avg(F.col("exceeds_conservative").cast("double")).alias("conservative_rate"), F.avg("h3_fraction").alias("precision"))
    return g.join(n, list(by)).withColumn("predicted", 1.0 - F.pow(F.lit(1.0 - alpha), F.col("n_layers")))


# Fixed value: spacing of 32-bit floats at 1.
FLOAT32_EPS = 1.1920929e-07


def numeric_floor(scores: DataFrame, by: Sequence[str] = ("model",), null: str = "null_primary", floor: float = 10 * FLOAT32_EPS) -> DataFrame:
    """Decisions whose score and null both lie below the numeric floor."""
    at = F.greatest(F.abs("best_ps"), F.abs(F.coalesce(F.col(null), F.lit(0.0)))) < floor
    return scores.filter(F.col("best_ps").isNotNull()).groupBy(*by).agg(
        F.count_if(~at).alias("resolvable"), F.count_if(at).alias("at_floor"), F.count_if("exceeds_primary").alias("exceeding_total"),
        F.count_if(F.col("exceeds_primary") & at).alias("exceeding_at_floor"))


def resolution_report(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """No-op floor median and maximum, mean chance, observed precision, near-side share."""
    f = scores.withColumn("__f", F.abs("noop"))
    g = f.groupBy(*by).agg(F.max("__f").alias("floor_max"), F.avg("chance_fraction").alias("chance"),
                           F.avg("h3_fraction").alias("observed"), F.avg("nearer").alias("nearer"))
    return g.join(exact_quantiles(f, by, "__f", {"floor_median": 0.5}), list(by))


def registered_vs_corrected(scores: DataFrame, by: Sequence[str] = ("model",), alpha: float = 0.05, reps: int = 10_000, seed: str = "42") -> DataFrame:
    """The pooled test against 1/3 beside the unit-clustered excess over matched chance."""
    s = scores.filter(F.col("chance_fraction").isNotNull())
    g = G.precision_aggregates(s, by).withColumn("registered_p", binom_test("hits", "trials", F.lit(1.0 / 3.0)))
    ex = R.bootstrap_excess(s, by, UNIT, "h3_fraction", "chance_fraction", reps, seed)
    ok = (F.col("mean_precision") > 1.0 / 3.0) & (F.col("registered_p") < alpha)
    return g.join(ex.select(*by, F.col("point").alias("excess"), "ci_low", "ci_high", "holds"), list(by)).withColumns(
        {"registered": F.when(ok, "PASS").otherwise("FAIL"), "corrected": F.when(F.col("holds"), "PASS").otherwise("FAIL")}).drop("holds")


def margin_audit(scores: DataFrame, by: Sequence[str] = ("model",), gate: int = 8) -> DataFrame:
    """Units over the primary null whose gap is within the distance between the two
    nulls, and the worst case should all of them cross."""
    gap = F.col("best_ps") - F.col("null_primary")
    width = F.coalesce(F.abs(F.col("null_conservative") - F.col("null_primary")), F.lit(0.0))
    over = gap > 0
    g = scores.filter(F.col("null_primary").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(over).alias("exceeding"), F.count_if(over & (gap <= width)).alias("at_risk"),
        F.min(F.when(over, gap)).alias("smallest_gap"))
    floor = F.col("exceeding") - F.col("at_risk")
    return g.withColumns({"worst_case": floor, "margin": floor - gate, "verdict": F.when(floor >= gate, "HOLDS").otherwise("AT RISK")})


def vs_complementarity(layers: DataFrame, ceiling: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Precision at the panel layer against the structure-only ceiling, with a sign test."""
    per = layers.groupBy(*by, "layer").agg(F.avg("ps").alias("ps"))
    at = first_by(per, by, "ps", ["layer"]).select(*by, F.col("layer").alias("panel_layer"))
    rows = salted_join(layers, at, list(by), F.col(UNIT)).filter(F.col("layer") == F.col("panel_layer")).join(ceiling, UNIT)
    p, c = F.col("precision"), F.col("ceiling")
    g = rows.groupBy(*by, "panel_layer").agg(
        F.count(F.lit(1)).alias("units"), F.avg(p).alias("mean_precision"), F.avg(c).alias("mean_ceiling"),
        F.count_if(p > c).alias("above"), F.count_if(p < c).alias("below"), F.count_if(p == c).alias("equal"))
    return g.withColumn("p", binom_test(F.col("above"), F.col("above") + F.col("below"), F.lit(0.5)))


# ------------------------------------------------------------------ bookkeeping audits

def completeness(results: DataFrame, units: DataFrame) -> DataFrame:
    """Per run: panel units covered, missing, and result keys that are no panel unit."""
    known = results.select("model", UNIT).distinct().join(units.select(UNIT).distinct().withColumn("__in", F.lit(1)), UNIT, "left")
    g = known.groupBy("model").agg(F.count("__in").alias("covered"), F.count_if(F.col("__in").isNull()).alias("unknown"))
    return g.withColumn("panel", units.agg(F.countDistinct(UNIT)).scalar()).withColumn("missing", F.col("panel") - F.col("covered"))


def missing_cells(results: DataFrame, units: DataFrame, models: DataFrame) -> DataFrame:
    """The missing (run, unit) cells themselves.

    Each unit carries the array of runs it has; the runs it lacks follow without
    building the run x unit grid.
    """
    every = models.agg(F.array_sort(F.collect_set("model"))).scalar()
    have = results.groupBy(UNIT).agg(F.collect_set("model").alias("__have"))
    u = units.select(UNIT).distinct().join(have, UNIT, "left").withColumn("__all", every)
    lack = F.array_except("__all", F.coalesce("__have", F.array().cast("array<string>")))
    return u.select(UNIT, F.explode(lack).alias("model"))


def census(files: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Keys whose files store more than one value: files, distinct values, range."""
    g = files.groupBy(*by).agg(F.count(F.lit(1)).alias("files"), F.countDistinct(value).alias("values"), F.min(value).alias("low"), F.max(value).alias("high"))
    return g.withColumn("disagree", F.col("values") > 1)


def stamp_check(stamps: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Named stamp fields that are not the same across runs: field, distinct values."""
    long = stamps.select("model", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(
        F.col(f).cast("string"), F.lit("(absent)")).alias("value")) for f in fields])))
    g = long.groupBy("field").agg(F.countDistinct("value").alias("distinct_values"), F.count(F.lit(1)).alias("runs"))
    return g.withColumn("consistent", F.col("distinct_values") == 1)


def significant_figures(literal: Column) -> Column:
    """Figures of a printed decimal: all digits of its mantissa from the first that is not zero (0: one)."""
    mantissa = F.regexp_replace(literal, "[eE].*$", "")
    digits = F.regexp_replace(mantissa, "[^0-9]", "")
    return F.greatest(F.length(F.regexp_replace(digits, "^0+", "")), F.lit(1))


def printed_places(literal: Column) -> Column:
    """Decimal places of a literal's last printed figure: those of its mantissa less its exponent."""
    fraction = F.regexp_extract(literal, r"\.([0-9]*)", 1)
    exponent = F.regexp_extract(literal, r"[eE]([+-]?[0-9]+)$", 1)
    return F.length(fraction) - F.coalesce(exponent.try_cast("int"), F.lit(0))


def rounds_to(value: Column, literal: Column) -> Column:
    """Whether a value, rounded to the literal's last printed place, is the literal."""
    unit = F.pow(F.lit(10.0), printed_places(literal))
    return F.rint(value * unit) == F.rint(literal.cast("double") * unit)


def attribute_value(candidates: DataFrame, claims: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Which aggregations print as the reported literal: candidates(…, aggregation, value)."""
    return candidates.join(claims, list(by)).withColumn("matches", rounds_to(F.col("value"), F.col("literal")))


def check_reported(values: DataFrame, claims: DataFrame, by: Sequence[str] = ("key",)) -> DataFrame:
    """Claims whose stored value does not round to them at their own decimals."""
    j = claims.join(values, list(by), "left").withColumn("__p", F.pow(F.lit(10.0), printed_places(F.col("literal"))))
    ok = F.abs(F.round(F.col("value") * F.col("__p"), 0) - F.round(F.col("literal").cast("double") * F.col("__p"), 0)) < 0.5
    return j.withColumn("agrees", F.coalesce(ok, F.lit(False))).drop("__p")


def exclusion_shift(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean with and without the quarantined units and the % shift, in one pass."""
    ok, kept = F.col("status") == "scored", ~F.col("quarantined")
    g = scores.groupBy(*by).agg(
        F.avg(F.when(ok, F.col("best_ps"))).alias("all_units"), F.avg(F.when(ok & kept, F.col("best_ps"))).alias("kept_units"),
        F.count_if(ok).alias("n_all"), F.count_if(ok & kept).alias("n_kept"))
    return g.withColumn("shift", (F.col("kept_units") - F.col("all_units")) / F.col("all_units") * 100.0)


def repair_summary(before: DataFrame, after: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Units scored, mean PS, exceedances and precision before and after a repair."""
    both = before.withColumn("version", F.lit("before")).unionByName(after.withColumn("version", F.lit("after")))
    s = both.filter(~F.col("quarantined") & F.col("best_ps").isNotNull())
    return s.groupBy(*by).pivot("version", ["before", "after"]).agg(
        F.count(F.lit(1)).alias("scored"), F.avg("best_ps").alias("mean_ps"), F.count_if("exceeds_primary").alias("exceeding"),
        F.avg("h3_fraction").alias("precision"))


def artifact_guard(stored: DataFrame, recomputed: DataFrame, by: Sequence[str], tol: float = 1e-6) -> DataFrame:
    """Stored intervals with whether their point estimate matches the recomputed one."""
    j = stored.join(recomputed.select(*by, F.col("point").alias("recomputed")), list(by), "left")
    return j.withColumn("accepted", F.coalesce(F.abs(F.col("point") - F.col("recomputed")) <= tol, F.lit(False)))


def set_consistency(a: DataFrame, b: DataFrame, unit: str = UNIT) -> DataFrame:
    """Names present in only one of two sources."""
    x, y = a.select(unit).distinct(), b.select(unit).distinct()
    return x.join(y, unit, "left_anti").withColumn("only_in", F.lit("first")).unionByName(
        y.join(x, unit, "left_anti").withColumn("only_in", F.lit("second")))


# ------------------------------------------------------------------ span audit

def span_audit(rows: DataFrame, guessed: DataFrame, windows: DataFrame, lengths: DataFrame) -> DataFrame:
    """Misassigned positions and how assumed contact windows overlap the true spans.

    rows(unit_id, row, start, end) true spans; guessed(unit_id, pos, row) assumed row
    of each position; windows(unit_id, row, start, end) assumed spans; lengths(unit_id, n).
    """
    from .structure import position_rows
    true = position_rows(rows, [UNIT]).select(UNIT, "pos", F.col("row").alias("__t"))
    pos = true.join(guessed, [UNIT, "pos"], "left").groupBy(UNIT).agg(
        F.count(F.lit(1)).alias("positions"), F.count_if(~F.col("__t").eqNullSafe(F.col("row"))).alias("misassigned"))
    w = windows.select(UNIT, "row", F.col("start").alias("ws"), F.col("end").alias("we"))
    m = rows.join(w, [UNIT, "row"], "left").join(lengths, UNIT)
    shared = F.greatest(F.lit(0), F.least("end", "we") - F.greatest("start", "ws"))
    over = m.withColumn("s", F.coalesce(shared, F.lit(0))).groupBy(UNIT).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("ws") >= F.col("n")).alias("empty_rows"),
        F.count_if(F.col("s") == 0).alias("disjoint_rows"), F.avg(F.col("s") / (F.col("end") - F.col("start"))).alias("mean_overlap"))
    return pos.join(over, UNIT)


def retokenised(rows: DataFrame, variant_rows: DataFrame) -> DataFrame:
    """Per unit: variants, and how many changed their number of rows."""
    n = rows.groupBy(UNIT).agg(F.count(F.lit(1)).alias("__n"))
    v = variant_rows.groupBy(UNIT, "variant").agg(F.count(F.lit(1)).alias("__m")).join(n, UNIT)
    return v.groupBy(UNIT).agg(F.count(F.lit(1)).alias("trials"), F.count_if(F.col("__m") != F.col("__n")).alias("retokenised"))


def surviving_pairs(pairs: DataFrame, rows: DataFrame, variant_sizes: DataFrame) -> DataFrame:
    """Eligible pairs whose three positions clear the bounds of both row blocks, and the
    largest displacement of the row read from the position it stands for.

    pairs(unit_id, i, j, j_prev, j_next); variant_sizes(unit_id, mut_pos, n_rows).
    """
    n = rows.groupBy(UNIT).agg(F.count(F.lit(1)).alias("__n"))
    p = pairs.join(n, UNIT).join(variant_sizes.withColumnRenamed("mut_pos", "i"), [UNIT, "i"])
    p = p.withColumn("ok", F.greatest("j", "j_prev", "j_next") < F.least("__n", "n_rows"))
    read = p.join(rows.select(UNIT, F.col("row").alias("j"), "start", "end"), [UNIT, "j"], "left")
    off = F.when(F.col("ok"), F.least(F.abs(F.col("j") - F.col("start")), F.abs(F.col("j") - (F.col("end") - 1))))
    return read.groupBy(UNIT).agg(F.count(F.lit(1)).alias("pairs"), F.count_if("ok").alias("surviving"), F.max(off).alias("max_displacement"))
