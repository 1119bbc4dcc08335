"""Aggregations over scores, units, alignment columns and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import brackets as B
from ..functions.alphabet import CANONICAL
from ..functions.binding import inline_rows, let
from ..functions.draws import PRIME, seeds
from ..functions.marks import field_marks
from ..functions.vectors import guarded_ratio
from .joins import salted_join
from .ranking import cumulative_counts, exact_quantiles, first_by

CV_FLOOR = 1e-10


# ------------------------------------------------------------------ ratios

def label_ratio(dist: DataFrame, unit: Sequence[str] = ("unit_id",), layer: str = "layer",
                value: str = "value", label: str = "label", min_each: int = 3) -> DataFrame:
    """Paired over unpaired mean per (unit, layer) with at least ``min_each`` of both."""
    p, u = F.col(label) == "paired", F.col(label) == "unpaired"
    g = dist.filter(F.col(value).isNotNull()).groupBy(*unit, layer).agg(
        F.avg(F.when(p, F.col(value))).alias("mean_paired"), F.avg(F.when(u, F.col(value))).alias("mean_unpaired"),
        F.count_if(p).alias("n_paired"), F.count_if(u).alias("n_unpaired"))
    return (g.filter((F.col("n_paired") >= min_each) & (F.col("n_unpaired") >= min_each))
            .withColumn("ratio", guarded_ratio(F.col("mean_paired"), F.col("mean_unpaired"))))


def best_layer(scores: DataFrame, by: Sequence[str], score: str, layer: str = "layer",
               carry: Sequence[str] = ()) -> DataFrame:
    """Layer of the largest score, the earliest on ties."""
    return first_by(scores, by, score, [layer], carry)


def summarise_ratio(scores: DataFrame, by: Sequence[str], score: str = "ratio",
                    exceeds: str = "exceeds") -> DataFrame:
    """Mean, median, units scored and units over their null."""
    flat = scores.filter(F.col(score).isNotNull()).groupBy(*by).agg(
        F.avg(score).alias("mean_ratio"), F.count(F.lit(1)).alias("n_scored"),
        F.count_if(F.col(exceeds)).alias("n_exceeding"))
    return flat.join(exact_quantiles(scores, by, score, {"median_ratio": 0.5}), list(by))


# ------------------------------------------------------- specificity summaries

def population(scores: DataFrame) -> DataFrame:
    """Adds ``part``: the population each unit's row belongs to.

    skipped, quarantined, failed_gate or active, in that order.
    """
    return scores.withColumn("part", F.when(F.col("status") == "skipped", "skipped")
                             .when(F.col("quarantined"), "quarantined")
                             .when(~F.coalesce("gate_pass", F.lit(False)), "failed_gate").otherwise("active"))


def summarise_ps(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Means over active units, and counts of every part of the population."""
    p = population(scores)
    active = F.col("part") == "active"
    g = p.groupBy(*by).agg(
        F.avg(F.when(active, F.col("best_ps"))).alias("mean_best_ps"),
        F.count_if(active & F.col("exceeds_primary")).alias("n_exceeding_primary"),
        F.count_if(active & F.col("exceeds_conservative")).alias("n_exceeding_conservative"),
        F.count_if(active & ~F.col("null_available")).alias("n_no_null"),
        F.count_if(active).alias("n_active"),
        F.count_if(F.coalesce("quarantined", F.lit(False))).alias("n_quarantined"),
        F.count_if(F.col("part") == "skipped").alias("n_skipped"),
        F.count_if(F.col("part") == "failed_gate").alias("n_failed_gate"))
    med = exact_quantiles(p.filter(active), by, "best_ps", {"median_best_ps": 0.5})
    return g.join(med, list(by), "left")


def population_lists(scores: DataFrame, by: Sequence[str], unit: str = "unit_id") -> DataFrame:
    """The listed units themselves, one row each: quarantined, skipped, failed_gate, no_null."""
    p = population(scores)
    no_null = (F.col("part") == "active") & ~F.col("null_available")
    name = F.when(no_null, "no_null").when(F.col("part") != "active", F.col("part"))
    return p.select(*by, unit, name.alias("listed_as")).filter(F.col("listed_as").isNotNull())


def registered_summary(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean over non-quarantined units; gated mean, gate, exceedances, mean of fractions."""
    ok = (F.col("status") == "scored") & ~F.col("quarantined")
    gate = F.coalesce("gate_pass", F.lit(False))
    s = scores.filter(ok)
    return s.groupBy(*by).agg(
        F.avg("best_ps").alias("mean_ps"), F.avg(F.when(gate, F.col("best_ps"))).alias("mean_ps_gated"),
        F.count(F.lit(1)).alias("eligible"), F.count_if(gate).alias("gate"),
        F.count_if(gate & F.col("exceeds_conservative")).alias("exceed"),
        F.count_if(gate & F.col("exceeds_primary")).alias("exceed_primary"),
        F.avg(F.when(gate, F.col("h3_fraction"))).alias("h3"))


def precision_aggregates(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pooled precision against the mean of per-unit fractions."""
    return scores.groupBy(*by).agg(
        F.sum("h3_hits").alias("hits"), F.sum("h3_n").alias("trials"),
        (F.sum("h3_hits") / F.sum("h3_n")).alias("pooled_precision"),
        F.avg("h3_fraction").alias("mean_precision"))


def replicate_cv(scores: DataFrame, by: Sequence[str], origin: str = "origin", score: str = "ratio",
                 exceeds: str = "exceeds") -> DataFrame:
    """Replicate mean, sd, CV and exceed count per origin unit."""
    g = scores.groupBy(*by, origin).agg(
        F.count(F.lit(1)).alias("n_sequences"), F.count(score).alias("n_scored"), F.avg(score).alias("mean_ratio"),
        F.stddev_samp(score).alias("__sd"), F.count_if(F.col(score).isNotNull() & F.col(exceeds)).alias("n_exceeds"))
    sd = F.when(F.col("n_scored") > 1, F.col("__sd")).when(F.col("n_scored") == 1, 0.0)
    return (g.withColumn("sd_ratio", sd).drop("__sd")
            .withColumn("cv_ratio", F.when(F.col("mean_ratio") > CV_FLOOR, F.col("sd_ratio") / F.col("mean_ratio"))))


def replicate_summary(per_origin: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and median CV over the origins that have one."""
    has = F.col("cv_ratio").isNotNull()
    g = per_origin.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_units"), F.count_if(has).alias("n_units_scored"),
        F.sum("n_scored").alias("n_total_sequences"), F.avg("cv_ratio").alias("mean_cv"),
        F.avg(F.when(has, F.col("mean_ratio"))).alias("mean_ratio"))
    return g.join(exact_quantiles(per_origin, by, "cv_ratio", {"median_cv": 0.5}), list(by), "left")


def multiseq_families(scores: DataFrame, family: Sequence[str], score: str = "ps") -> DataFrame:
    """Mean, median, sd, SE and range of the member scores of each family."""
    g = scores.groupBy(*family).agg(
        F.count(score).alias("n_usable"), F.avg(score).alias("mean_ps"), F.stddev_samp(score).alias("__sd"),
        F.min(score).alias("min_ps"), F.max(score).alias("max_ps"))
    sd = F.when(F.col("n_usable") > 1, F.col("__sd")).otherwise(0.0)
    g = g.withColumn("std_ps", sd).withColumn("se_ps", F.col("std_ps") / F.sqrt("n_usable")).drop("__sd")
    return g.join(exact_quantiles(scores, family, score, {"median_ps": 0.5}), list(family), "left")


def multiseq_summary(scores: DataFrame, per_family: DataFrame, score: str = "ps") -> DataFrame:
    """Global mean, median, sd, SE, and the mean of family means with its SE."""
    g = scores.agg(F.count(score).alias("n_total"), F.avg(score).alias("global_mean"),
                   F.stddev_samp(score).alias("global_std"))
    g = g.withColumn("global_se", F.col("global_std") / F.sqrt("n_total"))
    fam = per_family.filter(F.col("mean_ps").isNotNull()).agg(
        F.count(F.lit(1)).alias("n_families"), F.avg("mean_ps").alias("mean_of_means"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_samp("mean_ps") / F.sqrt(F.count(F.lit(1)))).otherwise(0.0).alias("se_of_means"))
    one = lambda df: df.withColumn("__k", F.lit(0))
    med = exact_quantiles(scores, [], score, {"global_median": 0.5})
    return one(g).join(one(fam), "__k").join(one(med), "__k").drop("__k")


# ------------------------------------------------------------- panel content

def duplicate_groups(units: DataFrame, content: Column, unit: str = "unit_id") -> DataFrame:
    """Content shared by more than one unit: digest, copies, first and last name."""
    return (units.filter(content.isNotNull()).groupBy(F.sha2(content.cast("string"), 256).alias("digest"))
            .agg(F.count(F.lit(1)).alias("copies"), F.min(unit).alias("first_unit"), F.max(unit).alias("last_unit"))
            .filter(F.col("copies") > 1))


def duplicate_members(units: DataFrame, content: Column, unit: str = "unit_id") -> DataFrame:
    """Every unit of every duplicate group; a group of any size stays spread out."""
    rows = units.select(unit, F.sha2(content.cast("string"), 256).alias("digest"))
    groups = duplicate_groups(units, content, unit).select("digest", "copies")
    return salted_join(rows, groups, ["digest"], F.col(unit))


def pair_types(units: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The two symbols of every matched pair."""
    got = inline_rows(units, [*carry, B.symbols(F.col("sequence")).alias("__c")], B.match_pairs(F.col("structure")), "i")
    return got.withColumn("pair_type", F.concat(F.get("__c", F.col("i")), F.get("__c", F.col("j")))).drop("__c")


def top_noncanonical(pairs: DataFrame, by: Sequence[str], k: int = 3) -> DataFrame:
    """Most common non-canonical pair types, by count then name."""
    n = pairs.filter(~F.col("pair_type").isin(*CANONICAL)).groupBy(*by, "pair_type").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "pair_type"))
    return n.withColumn("rank", rank).filter(F.col("rank") <= k)


def tree_digest(df: DataFrame, by: Sequence[str], name: Column) -> DataFrame:
    """Order-free digest of a multiset of names, by one rule at every size.

    The sha256 of a name picks one of 256 leaves and adds two 60-bit numbers to its sums, so a leaf of any size combines
    map-side; the leaves in order are hashed once more.  Other content has another digest but for a chance of about
    2^-120; it is no defence against names made to collide.
    """
    h = F.sha2(name.cast("string"), 256)
    part60 = lambda at: F.conv(F.substring("__h", at, 15), 16, 10).cast("decimal(38,0)")
    leaf = df.select(*by, h.alias("__h")).groupBy(*by, F.substring("__h", 1, 2).alias("__b")).agg(
        F.sum(part60(3)).alias("s"), F.sum(part60(18)).alias("t"), F.count(F.lit(1)).alias("n"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__b", *[F.col(c).cast("string").alias(c) for c in "stn"]))),
                                    lambda e: F.concat_ws(":", e["__b"], e["s"], e["t"], e["n"])), ",")
    return leaf.groupBy(*by).agg(F.sum("n").alias("n_names"), F.sha2(text, 256).alias("digest"))


def set_digest(df: DataFrame, by: Sequence[str], name: Column, length: int = 16) -> DataFrame:
    """First ``length`` hex digits of the tree digest of the names."""
    return tree_digest(df, by, name).withColumn("digest", F.substring("digest", 1, length))


def panel_fingerprint(units: DataFrame, by: Sequence[str], unit: str = "unit_id") -> DataFrame:
    """Tree digest of (name, sequence, structure): any change of content changes it."""
    return tree_digest(units, by, field_marks(F.col(unit), F.col("sequence"), F.col("structure")))


# ------------------------------------------------------------ alignments

GAP_LIMIT, MIN_MEMBERS, MIN_PAIRS = 0.5, 5, 3  # fixed values
STATES = "ACGU"


def gap_fraction(members: DataFrame, family: str = "family", aligned: str = "aligned") -> DataFrame:
    """Gap share of every alignment column, and whether the column is kept."""
    cells = members.select(family, F.posexplode(B.symbols(F.col(aligned))).alias("col", "sym"))
    g = cells.groupBy(family, "col").agg(F.avg(F.when(F.col("sym") == "-", 1.0).otherwise(0.0)).alias("gap_fraction"))
    return g.withColumn("kept", F.col("gap_fraction") <= GAP_LIMIT)


def joint_counts(members: DataFrame, colpairs: DataFrame, family: str = "family", aligned: str = "aligned",
                 member: str = "member") -> DataFrame:
    """Symbol pair counts of chosen column pairs: (family, c1, c2, a, b, n).

    The column pairs of one family are one array, met by every member's own row;
    the counts (25 states at most per pair) combine before the exchange.
    """
    packed = colpairs.groupBy(family).agg(F.collect_set(F.struct("c1", "c2")).alias("__cols"))
    rows = salted_join(members.select(family, member, B.symbols(F.col(aligned)).alias("__s")), packed,
                       [family], F.col(member))
    cell = lambda c: F.when(F.get("__s", F.col(c)).isin(*STATES), F.get("__s", F.col(c))).otherwise("-")
    return (rows.select(family, "__s", F.inline("__cols"))
            .select(family, "c1", "c2", cell("c1").alias("a"), cell("c2").alias("b"))
            .groupBy(family, "c1", "c2", "a", "b").agg(F.count(F.lit(1)).alias("n")))


def mutual_information(counts: DataFrame, family: str = "family") -> DataFrame:
    """MI (log base 4) and MI over the smaller entropy, clipped to 1, per column pair."""
    keys = [family, "c1", "c2"]
    w = lambda *c: W.partitionBy(*keys, *c)
    p = counts.withColumns({"total": F.sum("n").over(w()), "na": F.sum("n").over(w("a")), "nb": F.sum("n").over(w("b"))})
    pab, pa, pb = F.col("n") / F.col("total"), F.col("na") / F.col("total"), F.col("nb") / F.col("total")
    log4 = lambda x: F.log(x) / F.log(F.lit(4.0))
    g = p.groupBy(*keys).agg(
        F.sum(pab * log4(pab / (pa * pb))).alias("mi"),
        # sum over cells of p_ab * -log p_a is the marginal entropy
        F.sum(-pab * log4(pa)).alias("h1"), F.sum(-pab * log4(pb)).alias("h2"), F.max("total").alias("n_members"))
    low = F.least("h1", "h2")
    return g.withColumn("nmi", F.when((F.col("mi") > 0) & (low > 0), F.least(F.col("mi") / low, F.lit(1.0))).otherwise(0.0))


MIX_ROUNDS = 6


def keyed_place(t: Column, a: Column, b: Column, keys: Column) -> Column:
    """Where a keyed permutation of 0..a*b-1 sends t, as struct(l, r) for l * b + r.

    A Feistel network over the two digits of t, a of one and b of the other: each round adds a
    keyed polynomial of one digit to the other, which is undone by taking it away, so no two
    t share a place and none is drawn twice.  keys: three numbers for each round."""
    poly = lambda k, x: ((k[2] * x + k[1]) % PRIME * x + k[0]) % PRIME

    def mix(acc, k):
        left = (acc["l"] + poly(k, acc["r"])) % a
        return let(left, lambda l: F.struct(l.alias("l"), ((acc["r"] + poly(k, l)) % b).alias("r")))

    return F.aggregate(keys, F.struct(F.floor(t / b).alias("l"), (t % b).alias("r")), mix)


def sample_unpaired_pairs(columns: DataFrame, sizes: DataFrame, seed: str = "cols", family: str = "family") -> DataFrame:
    """Random distinct pairs of unpaired columns, as many as there are paired ones (all, if there are fewer).

    columns(family, col) are the kept unpaired columns, sizes(family, n_pairs).  The
    pairs of m columns are numbered 0..m(m-1)/2-1; the first n places of a keyed
    permutation of these numbers are n distinct pairs, without a grid or a second try.
    """
    packed = columns.groupBy(family).agg(F.sort_array(F.collect_list("col")).alias("__c"))
    m = F.size("__c").cast("bigint")
    want = F.least(F.col("n_pairs").cast("bigint"), F.floor(m * (m - 1) / 2))
    rows = packed.join(sizes, family).filter((m >= 2) & (F.col("n_pairs") > 0)).select(
        family, "__c", want.alias("__want"), F.when(m % 2 == 0, F.floor(m / 2)).otherwise(m).alias("__a"),
        F.when(m % 2 == 0, m - 1).otherwise(F.floor((m - 1) / 2)).alias("__b"),
        F.transform(F.sequence(F.lit(0), F.lit(MIX_ROUNDS - 1)), lambda i: seeds(seed, F.col(family), i)).alias("__k"))
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__want") - 1)))
    rows = rows.withColumn("__p", keyed_place(F.col("t"), F.col("__a"), F.col("__b"), F.col("__k")))
    x = rows.withColumn("__x", F.col("__p.l") * F.col("__b") + F.col("__p.r"))
    # the greatest k with k (k - 1) / 2 up to x is the larger column; the root may be off by one
    root = F.floor((1 + F.sqrt(1 + 8 * F.col("__x").cast("double"))) / 2)
    below = lambda k: F.floor(k * (k - 1) / 2)
    exact = let(root, lambda k: F.when(below(k) > F.col("__x"), k - 1).when(below(k + 1) <= F.col("__x"), k + 1).otherwise(k))
    x = x.withColumn("__hi", exact)
    at = lambda ix: F.get("__c", ix.cast("int"))
    return x.select(family, at(F.col("__x") - below(F.col("__hi"))).alias("c1"), at(F.col("__hi")).alias("c2"))


def mi_summary(mi: DataFrame, members: DataFrame, family: str = "family") -> DataFrame:
    """Per family: paired and unpaired MI and NMI means and sds, median, ratio, sizes.

    ``mi`` carries class ('paired'/'unpaired').  Families below the member or
    pair minimum are dropped.
    """
    paired = F.col("class") == "paired"
    pick = lambda cond, c: F.when(cond, F.col(c))
    g = mi.groupBy(family).agg(
        F.count_if(paired).alias("n_paired"), F.count_if(~paired).alias("n_unpaired"),
        F.avg(pick(paired, "mi")).alias("paired_mi_mean"), F.stddev_pop(pick(paired, "mi")).alias("paired_mi_std"),
        F.median(pick(paired, "mi")).alias("paired_mi_median"), F.avg(pick(paired, "nmi")).alias("paired_nmi_mean"),
        F.avg(pick(~paired, "mi")).alias("unpaired_mi_mean"), F.stddev_pop(pick(~paired, "mi")).alias("unpaired_mi_std"),
        F.avg(pick(~paired, "nmi")).alias("unpaired_nmi_mean"), F.max("n_members").alias("n_members"))
    g = g.filter((F.col("n_members") >= MIN_MEMBERS) & (F.col("n_paired") >= MIN_PAIRS))
    return g.withColumn("mi_ratio", F.when(F.col("unpaired_mi_mean") > 0, F.col("paired_mi_mean") / F.col("unpaired_mi_mean")))


# ---------------------------------------------------------- correlations, tails

def spearman(df: DataFrame, x: str, y: str, by: Sequence[str], bounded: bool = False) -> DataFrame:
    """Correlation of average ranks; null where either side does not vary.

    ``bounded`` says that a group's size is bounded by one record (a unit's cells,
    a handful of variants): its ranks are then plain windows over one exchange.
    """
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    if bounded:
        def tied(v):
            w = W.partitionBy(*by)
            return F.rank().over(w.orderBy(v)) + (F.count(F.lit(1)).over(W.partitionBy(*by, v)) - 1) / 2.0
        cells = both.withColumns({f"__r_{x}": tied(x), f"__r_{y}": tied(y), "__w": F.lit(1)})
    else:
        # Equal (x, y) rows share their ranks, so they travel as one weighted row.
        base = both.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("__w"))
        cells = base
        for side in (x, y):
            per_value = base.groupBy(*by, side).agg(F.sum("__w").alias("n"))
            ranks = cumulative_counts(per_value, by, side).select(*by, side, F.col("avg_rank").alias(f"__r_{side}"))
            cells = cells.join(ranks, [*by, side])
    return weighted_corr(cells, by, f"__r_{x}", f"__r_{y}", "__w").withColumnRenamed("corr", "rho")


def weighted_corr(df: DataFrame, by: Sequence[str], x: str, y: str, w: str) -> DataFrame:
    """Pearson correlation of rows with a multiplicity."""
    a, b, n = F.col(x).cast("double"), F.col(y).cast("double"), F.col(w)
    g = df.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(n * a).alias("sx"), F.sum(n * b).alias("sy"),
                            F.sum(n * a * a).alias("sxx"), F.sum(n * b * b).alias("syy"), F.sum(n * a * b).alias("sxy"))
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    return g.select(*by, "n", F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("corr"))


def best_abs_corr(df: DataFrame, by: Sequence[str], component: str, x: str, y: str) -> DataFrame:
    """Pearson r per component, and the component of the largest |r| (the first on ties)."""
    r = df.groupBy(*by, component).agg(F.corr(x, y).alias("r")).withColumn("abs_r", F.abs("r"))
    return first_by(r, by, "abs_r", [component], ["r"])


def tail_profile(pairs: DataFrame, by: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Wins of a over b, mean ratio, skewness and max/median of b, and wins with
    b's top decile left out."""
    q = exact_quantiles(pairs, by, b, {"p90": 0.9, "med": 0.5})
    wins = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) > F.col(b)).alias("wins"),
        F.avg(F.when(F.col(b) > 0, F.col(a) / F.col(b))).alias("mean_ratio"),
        F.count_if(F.col(b) <= 0).alias("zeros"), F.skewness(b).alias("skewness"), F.max(b).alias("__max"))
    light = salted_join(pairs, q, list(by), F.col(a)).filter(F.col(b) < F.col("p90"))
    trim = light.groupBy(*by).agg(F.count(F.lit(1)).alias("n_trimmed"),
                                  F.count_if(F.col(a) > F.col(b)).alias("wins_trimmed"))
    out = wins.join(q, list(by)).join(trim, list(by), "left")
    return out.withColumn("max_over_median", F.when(F.col("med") > 0, F.col("__max") / F.col("med"))).drop("__max")


def modal_layer(scores: DataFrame, by: Sequence[str], layer: str = "best_layer") -> DataFrame:
    """Most frequent best layer (the lowest on ties), its count and the total."""
    n = scores.filter(F.col(layer).isNotNull()).groupBy(*by, layer).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("total"))
    return first_by(n, by, "n", [layer]).join(total, list(by))


