"""Aggregation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import brackets as B
from ..operators import aggregates as G
from ..operators import resampling as R
from ..operators.structure import spread
from . import query
from . import views as V
from .joins import rounded
from .resampling import _boot

U = "unit_id"
WITH_RATIO = f"with {V.ST}, {V.RATIO.format(src='st')}"


@query("a1_label_ratio", f"{WITH_RATIO} select unit_id, layer, round(mean_paired, 9) as mean_paired, round(mean_unpaired, 9) as mean_unpaired, n_paired, n_unpaired, round(ratio, 9) as ratio from ratios")
def a1(spark, sf):
    return rounded(G.label_ratio(V.strata(spark, sf)), "mean_paired", "mean_unpaired", "ratio")


@query("a2_best_layer", f"{WITH_RATIO} select unit_id, layer, round(ratio, 9) as ratio from rbest")
def a2(spark, sf):
    return rounded(G.best_layer(G.label_ratio(V.strata(spark, sf)), [U], "ratio"), "ratio")


@query("a3_summarise_ratio", f"""with {V.PANEL} select model, round(avg(ratio), 8) as mean_ratio, count(*) as n_scored, count(*) filter (where exceeds_primary) as n_exceeding, round(median(ratio), 9) as median_ratio from panel group by model""")
def a3(spark, sf):
    s = G.summarise_ratio(V.panel(spark, sf), ["model"], exceeds="exceeds_primary")
    return rounded(rounded(s, "mean_ratio", places=8), "median_ratio")


_PART = """pt as (select *, case when status = 'skipped' then 'skipped' when quarantined then 'quarantined' when not gate_pass then 'failed_gate' else 'active' end as part from panel)"""


@query("a4_summarise_ps", f"""with {V.PANEL}, {_PART} select model, round(avg(best_ps) filter (where part = 'active'), 8) as mean_best_ps, count(*) filter (where part = 'active' and exceeds_primary) as n_exceeding_primary,
  count(*) filter (where part = 'active' and exceeds_conservative) as n_exceeding_conservative, count(*) filter (where part = 'active' and not null_available) as n_no_null, count(*) filter (where part = 'active') as n_active,
  count(*) filter (where quarantined) as n_quarantined, count(*) filter (where part = 'skipped') as n_skipped, count(*) filter (where part = 'failed_gate') as n_failed_gate,
  round(median(best_ps) filter (where part = 'active'), 9) as median_best_ps from pt group by model""")
def a4(spark, sf):
    s = G.summarise_ps(V.panel(spark, sf), ["model"])
    return rounded(rounded(s, "mean_best_ps", places=8), "median_best_ps")


@query("a4_population_lists", f"""with {V.PANEL}, {_PART} select model, unit_id, case when part = 'active' then 'no_null' else part end as listed_as from pt where part <> 'active' or not null_available""")
def a4l(spark, sf):
    return G.population_lists(V.panel(spark, sf), ["model"])


@query("a5_registered_summary", f"""with {V.PANEL} select model, round(avg(best_ps), 8) as mean_ps, round(avg(best_ps) filter (where gate_pass), 8) as mean_ps_gated, count(*) as eligible, count(*) filter (where gate_pass) as gate,
  count(*) filter (where gate_pass and exceeds_conservative) as exceed, count(*) filter (where gate_pass and exceeds_primary) as exceed_primary, round(avg(h3_fraction) filter (where gate_pass), 8) as h3
  from panel where status = 'scored' and not quarantined group by model""")
def a5(spark, sf):
    return rounded(G.registered_summary(V.panel(spark, sf), ["model"]), "mean_ps", "mean_ps_gated", "h3", places=8)


@query("a6_precision_aggregates", f"""with {V.PANEL} select model, sum(h3_hits) as hits, sum(h3_n) as trials, round(sum(h3_hits) / cast(sum(h3_n) as double), 9) as pooled_precision, round(avg(h3_fraction), 8) as mean_precision from panel group by model""")
def a6(spark, sf):
    return rounded(rounded(G.precision_aggregates(V.panel(spark, sf), ["model"]), "pooled_precision"), "mean_precision", places=8)


_REP = f"""with {V.PANEL}, r as (select model, unit_id // 5 as origin, case when status = 'scored' then ratio end as ratio, exceeds_primary as exceeds from panel),
  g as (select model, origin, count(*) as n_sequences, count(ratio) as n_scored, avg(ratio) as m, case when count(ratio) > 1 then stddev_samp(ratio) when count(ratio) = 1 then 0.0 end as sd,
    count(*) filter (where ratio is not null and exceeds) as n_exceeds from r group by all),
  cv as (select *, case when m > 1e-10 then sd / m end as cv from g)"""


def _replicates(spark, sf):
    p = V.panel(spark, sf)
    r = p.select("model", F.floor(F.col(U) / 5).alias("origin"), F.when(F.col("status") == "scored", F.col("ratio")).alias("ratio"),
                 F.col("exceeds_primary").alias("exceeds"))
    return G.replicate_cv(r, ["model"])


@query("a7_replicate_cv", f"{_REP} select model, origin, n_sequences, n_scored, n_exceeds, round(m, 9) as mean_ratio, round(sd, 8) as sd_ratio, round(cv, 8) as cv_ratio from cv")
def a7(spark, sf):
    return rounded(rounded(_replicates(spark, sf), "mean_ratio"), "sd_ratio", "cv_ratio", places=8)


@query("a7_replicate_summary", f"""{_REP} select model, count(*) as n_units, count(cv) as n_units_scored, sum(n_scored) as n_total_sequences, round(avg(cv), 8) as mean_cv, round(avg(m) filter (where cv is not null), 8) as mean_ratio,
  round(median(cv), 8) as median_cv from cv group by model""")
def a7s(spark, sf):
    return rounded(G.replicate_summary(_replicates(spark, sf), ["model"]), "mean_cv", "mean_ratio", "median_cv", places=8)


_FAMS = f"""with {V.RUNS}, f as (select unit_id, count(score) as n_usable, avg(score) as mean_ps, case when count(score) > 1 then stddev_samp(score) else 0.0 end as std_ps, min(score) as min_ps, max(score) as max_ps, median(score) as median_ps from runs group by unit_id)"""


@query("a8_multiseq_families", f"{_FAMS} select unit_id, n_usable, round(mean_ps, 8) as mean_ps, round(std_ps, 7) as std_ps, round(std_ps / sqrt(n_usable), 7) as se_ps, min_ps, max_ps, round(median_ps, 8) as median_ps from f")
def a8(spark, sf):
    f = G.multiseq_families(V.runs(spark, sf), [U], "score")
    return rounded(rounded(f, "mean_ps", "median_ps", places=8), "std_ps", "se_ps", places=7)


@query("a8_multiseq_summary", f"""{_FAMS}, g as (select count(score) as n_total, avg(score) as m, stddev_samp(score) as sd, median(score) as md from runs), h as (select count(*) as n, avg(mean_ps) as mm, stddev_samp(mean_ps) / sqrt(count(*)) as se from f)
  select n_total, round(m, 8) as global_mean, round(sd, 7) as global_std, round(sd / sqrt(n_total), 8) as global_se, n as n_families, round(mm, 8) as mean_of_means, round(se, 8) as se_of_means, round(md, 8) as global_median from g, h""")
def a8s(spark, sf):
    r = V.runs(spark, sf)
    s = G.multiseq_summary(r, G.multiseq_families(r, [U], "score"), "score")
    return rounded(rounded(s, "global_mean", "global_se", "mean_of_means", "se_of_means", "global_median", places=8), "global_std", places=7)


@query("a9_panel_lengths", """select count(*) as n_units, min(length(text)) as min_len, max(length(text)) as max_len, quantile_cont(length(text), 0.25) as q1, quantile_cont(length(text), 0.5) as median, quantile_cont(length(text), 0.75) as q3 from documents""")
def a9(spark, sf):
    from ..operators.structure import panel_description
    d = V.table(spark, sf, "documents").select(F.col("text").alias("sequence"), "lang")
    return panel_description(d, F.col("lang"))[0]


@query("a9_class_counts", "select concat(lang, '_', source) as kind, count(*) as n from documents group by all")
def a9c(spark, sf):
    from ..operators.structure import panel_description
    d = V.table(spark, sf, "documents").select(F.col("text").alias("sequence"), "lang", "source")
    return panel_description(d, F.concat_ws("_", "lang", "source"))[1]


@query("a10_duplicate_groups", "select sha256(text) as digest, count(*) as copies, min(doc_id) as first_unit, max(doc_id) as last_unit from documents group by all having count(*) > 1")
def a10(spark, sf):
    return G.duplicate_groups(V.table(spark, sf, "documents"), F.col("text"), "doc_id")


@query("a10_duplicate_members", "select doc_id, d as digest, copies from (select doc_id, sha256(text) as d, count(*) over (partition by sha256(text)) as copies from documents) where copies > 1")
def a10m(spark, sf):
    return G.duplicate_members(V.table(spark, sf, "documents"), F.col("text"), "doc_id")


@query("a11_top_noncanonical", f"""{V.WITH_BK}, t as (select p.unit_id % 7 as part, concat(substr(sequence, i + 1, 1), substr(sequence, j + 1, 1)) as pair_type from pairs p join bk using (unit_id)),
  c as (select part, pair_type, count(*) as n from t where pair_type not in ('AU', 'UA', 'CG', 'GC') group by all)
  select * from (select *, row_number() over (partition by part order by n desc, pair_type) as rank from c) where rank <= 3""")
def a11(spark, sf):
    t = G.pair_types(V.brackets(spark, sf).withColumn("part", F.col(U) % 7), ["part"])
    return G.top_noncanonical(t, ["part"])


_CELLS = f"""with recursive {V.MSA}, cell as (select family, member, unnest(range({V.MSA_COLS})) as col, aligned from msa),
  sy as (select family, member, col, substr(aligned, col + 1, 1) as sym from cell)"""


@query("a12_gap_fraction", f"{_CELLS} select family, col, round(avg((sym = '-')::int), 9) as gap_fraction, avg((sym = '-')::int) <= 0.5 as kept from sy group by all")
def a12(spark, sf):
    return rounded(G.gap_fraction(V.msa(spark, sf)), "gap_fraction")


# consensus pairs by the stack walk over each bracket kind
_CPAIRS = f"""cons as (select distinct family, '{V.CONSENSUS}' as structure from msa), kinds as (select * from (values ('<', '>'), ('(', ')'), ('[', ']'), ('{{', '}}')) as v(o, c)),
  walk as (select family, o, c, structure, 0 as k, []::int[] as st, -1 as i, -1 as j from cons, kinds union all
    select family, o, c, structure, k + 1, case when substr(structure, k + 1, 1) = o then list_append(st, k) when substr(structure, k + 1, 1) = c then st[:len(st) - 1] else st end,
      case when substr(structure, k + 1, 1) = c and len(st) > 0 then st[len(st)] else -1 end, k from walk where k < length(structure)),
  pc as (select family, i as c1, j as c2, 'paired' as class from walk where i >= 0)"""
# unpaired sample: the first numbers of a keyed permutation, two digits mixed in turn, read as pairs
_poly = lambda k, x: f"((hk[{3 * k + 3}] * ({x}) + hk[{3 * k + 2}]) % {V.PRIME} * ({x}) + hk[{3 * k + 1}]) % {V.PRIME}"
_mixed = "t0 as (select *, t // b as l, t % b as r from mm)"
for _k in range(G.MIX_ROUNDS):
    _mixed += f", t{_k + 1} as (select * exclude (l, r), l, (r + {_poly(_k, 'l')}) % b as r from (select * exclude (l), (l + {_poly(_k, 'r')}) % a as l from t{_k}))"
_HK = ", ".join(f"cast(concat('0x', substr({V.hexd(chr(39) + 'cols' + chr(39), 'family', chr(39) + str(k) + chr(39))}, {at}, 8)) as bigint) % {V.PRIME}" for k in range(G.MIX_ROUNDS) for at in (1, 9, 17))
_UNP = f"""free as (select f.family, c.col from cons f, (select unnest(range({V.MSA_COLS})) as col) c where not exists (select 1 from pc where pc.family = f.family and c.col in (pc.c1, pc.c2))
    and exists (select 1 from (select family, col from sy group by all having avg((sym = '-')::int) <= 0.5) g where g.family = f.family and g.col = c.col)),
  fx as (select family, list(col order by col) as cols, count(*) as m from free group by family), sz as (select family, count(*) as n_pairs from pc group by family),
  mm as (select *, case when m % 2 = 0 then m // 2 else m end as a, case when m % 2 = 0 then m - 1 else (m - 1) // 2 end as b, [{_HK}] as hk, unnest(range(least(n_pairs, m * (m - 1) // 2))) as t from fx join sz using (family) where m >= 2),
  {_mixed}, ut as (select family, cols, x, k from (select *, l * b + r as x from t{G.MIX_ROUNDS}) z join (select unnest(range(1, {V.MSA_COLS} + 1)) as k) on k * (k - 1) // 2 <= x and x < (k + 1) * k // 2),
  up as (select family, cols[x - k * (k - 1) // 2 + 1] as c1, cols[k + 1] as c2, 'unpaired' as class from ut)"""
_JOINT = """jc as (select p.family, p.c1, p.c2, p.class, a.sym as a, b.sym as b, count(*) as n from {cols} p join sy a on a.family = p.family and a.col = p.c1 join sy b on b.family = p.family and b.col = p.c2 and b.member = a.member group by all)"""
_MI = """pm as (select *, sum(n) over (partition by family, c1, c2) as nn, sum(n) over (partition by family, c1, c2, a) as na, sum(n) over (partition by family, c1, c2, b) as nb from jc),
  mi as (select family, c1, c2, class, sum(n / nn * ln((n / nn) / ((na / nn) * (nb / nn)))) / ln(4) as mi, -sum(n / nn * ln(na / nn)) / ln(4) as h1, -sum(n / nn * ln(nb / nn)) / ln(4) as h2, max(nn) as n_members from pm group by all),
  nm as (select *, case when mi > 0 and least(h1, h2) > 0 then least(mi / least(h1, h2), 1.0) else 0.0 end as nmi from mi)"""


def column_pairs(spark, sf):
    m = V.msa(spark, sf)
    cons = V.consensus_units(spark, sf)
    paired = cons.select("family", F.explode(B.match_all_kinds(F.col("structure"), "")).alias("p")).select(
        "family", F.col("p.i").alias("c1"), F.col("p.j").alias("c2"))
    ends = paired.select("family", F.col("c1").alias("col")).unionByName(paired.select("family", F.col("c2").alias("col")))
    free = G.gap_fraction(m).filter("kept").select("family", "col").join(ends, ["family", "col"], "left_anti")
    sizes = paired.groupBy("family").agg(F.count(F.lit(1)).alias("n_pairs"))
    unpaired = G.sample_unpaired_pairs(free, sizes)
    return paired.withColumn("class", F.lit("paired")), unpaired.withColumn("class", F.lit("unpaired"))


def _mi(spark, sf):
    paired, unpaired = column_pairs(spark, sf)
    cols = paired.unionByName(unpaired)
    return G.mutual_information(G.joint_counts(V.msa(spark, sf), cols)).join(cols, ["family", "c1", "c2"])


@query("a13_mutual_information", f"{_CELLS}, {_CPAIRS}, {_JOINT.format(cols='pc')}, {_MI} select family, c1, c2, round(mi, 8) as mi from nm")
def a13(spark, sf):
    paired, _ = column_pairs(spark, sf)
    mi = G.mutual_information(G.joint_counts(V.msa(spark, sf), paired))
    return rounded(mi.select("family", "c1", "c2", "mi"), "mi", places=8)


@query("a14_normalised_mi", f"{_CELLS}, {_CPAIRS}, {_JOINT.format(cols='pc')}, {_MI} select family, c1, c2, round(nmi, 8) as nmi from nm")
def a14(spark, sf):
    paired, _ = column_pairs(spark, sf)
    mi = G.mutual_information(G.joint_counts(V.msa(spark, sf), paired))
    return rounded(mi.select("family", "c1", "c2", "nmi"), "nmi", places=8)


@query("a15_sample_unpaired_pairs", f"{_CELLS}, {_CPAIRS}, {_UNP} select family, c1, c2 from up")
def a15(spark, sf):
    return column_pairs(spark, sf)[1].drop("class")


@query("a16_mi_summary", f"""{_CELLS}, {_CPAIRS}, {_UNP}, allc as (select * from pc union all select * from up), {_JOINT.format(cols='allc')}, {_MI}
  select family, count(*) filter (where class = 'paired') as n_paired, count(*) filter (where class <> 'paired') as n_unpaired, round(avg(mi) filter (where class = 'paired'), 8) as paired_mi_mean,
  round(stddev_pop(mi) filter (where class = 'paired'), 7) as paired_mi_std, round(median(mi) filter (where class = 'paired'), 8) as paired_mi_median, round(avg(nmi) filter (where class = 'paired'), 8) as paired_nmi_mean,
  round(avg(mi) filter (where class <> 'paired'), 8) as unpaired_mi_mean, round(stddev_pop(mi) filter (where class <> 'paired'), 7) as unpaired_mi_std, round(avg(nmi) filter (where class <> 'paired'), 8) as unpaired_nmi_mean,
  max(n_members) as n_members, round(avg(mi) filter (where class = 'paired') / avg(mi) filter (where class <> 'paired'), 6) as mi_ratio from nm group by family having max(n_members) >= 5""")
def a16(spark, sf):
    s = G.mi_summary(_mi(spark, sf), V.msa(spark, sf))
    s = rounded(s, "paired_mi_mean", "paired_mi_median", "paired_nmi_mean", "unpaired_mi_mean", "unpaired_nmi_mean", places=8)
    return rounded(rounded(s, "paired_mi_std", "unpaired_mi_std", places=7), "mi_ratio", places=6)


@query("a17_spearman", f"""with {V.RUNS}, r as (select model, score, unit_id % 50 as cov from runs), k as (select model, rank() over (partition by model order by score) + (count(*) over (partition by model, score) - 1) / 2.0 as rx,
  rank() over (partition by model order by cov) + (count(*) over (partition by model, cov) - 1) / 2.0 as ry from r) select model, count(*) as n, round(corr(rx, ry), 8) as rho from k group by model""")
def a17(spark, sf):
    return rounded(G.spearman(V.runs(spark, sf).withColumn("cov", F.col(U) % 50), "score", "cov", ["model"]), "rho", places=8)


@query("a18_best_abs_corr", """with d as (select label, unnest(range(64)) as component, embedding, vec_id from embeddings), r as (select label, component, corr(embedding[component + 1]::double, (vec_id % 17)::double) as r from d group by all)
  select label, component, round(r, 8) as r, round(abs(r), 8) as abs_r from (select *, row_number() over (partition by label order by round(abs(r), 12) desc, component) as k from r) where k = 1""")
def a18(spark, sf):
    e = V.table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 17).alias("cov"), F.posexplode(F.col("embedding").cast("array<double>")).alias("component", "x"))
    return rounded(G.best_abs_corr(e, ["label"], "component", "x", "cov"), "r", "abs_r", places=8)


@query("a19_tail_profile", f"""with {V.PANEL}, j as (select a.unit_id % 4 as grp, a.ratio as a, b.ratio as b from panel a join panel b on a.unit_id = b.unit_id and a.model = '1-URGENT' and b.model = '2-HIGH'),
  q as (select grp, quantile_cont(b, 0.9) as p90, quantile_cont(b, 0.5) as med from j group by grp),
  s as (select grp, count(*) as n, avg(b) as m from j group by grp), sk as (select j.grp, avg(power(b - m, 3)) / power(avg(power(b - m, 2)), 1.5) as skewness from j join s using (grp) group by j.grp)
  select j.grp, count(*) as n, count(*) filter (where a > b) as wins, round(avg(a / b) filter (where b > 0), 8) as mean_ratio, count(*) filter (where b <= 0) as zeros, round(any_value(skewness), 7) as skewness,
  round(any_value(p90), 9) as p90, round(any_value(med), 9) as med, count(*) filter (where b < p90) as n_trimmed, count(*) filter (where b < p90 and a > b) as wins_trimmed, round(max(b) / any_value(med), 8) as max_over_median
  from j join q using (grp) join sk using (grp) group by j.grp""")
def a19(spark, sf):
    from ..operators.joins import paired_units
    from .joins import arm
    j = paired_units(arm(spark, sf, "1-URGENT"), arm(spark, sf, "2-HIGH"), [U], "ratio").withColumn("grp", F.col(U) % 4)
    t = G.tail_profile(j, ["grp"])
    return rounded(rounded(rounded(t, "p90", "med"), "mean_ratio", "max_over_median", places=8), "skewness", places=7)


@query("a20_modal_layer", f"""with {V.PANEL}, c as (select model, best_layer, count(*) as n from panel group by all) select model, best_layer, n, total from (select *, sum(n) over (partition by model) as total,
  row_number() over (partition by model order by n desc, best_layer) as r from c) where r = 1""")
def a20(spark, sf):
    return G.modal_layer(V.panel(spark, sf), ["model"])


def _tree(src, group, name):
    """leaf and tree: the digest of the names of each group."""
    num = lambda at: f"sum(cast(concat('0x', substr(h, {at}, 15)) as bigint)::hugeint)"
    return f"""leaf as (select {group}, substr(h, 1, 2) as b, {num(3)} as s, {num(18)} as t, count(*) as n from (select {group}, sha256({name}) as h from {src}) group by all),
  tree as (select {group}, cast(sum(n) as bigint) as n_names, sha256(string_agg(concat_ws(':', b, cast(s as varchar), cast(t as varchar), cast(n as varchar)), ',' order by b)) as digest from leaf group by {group})"""


@query("a21_set_digest", f"""with {V.PANEL}, p as (select unit_id // 100 as grp, concat(unit_id, '_', model) as name from panel), {_tree('p', 'grp', 'name')} select grp, n_names, substr(digest, 1, 16) as digest from tree""")
def a21(spark, sf):
    p = V.panel(spark, sf).withColumn("grp", F.floor(F.col(U) / 100))
    return G.set_digest(p, ["grp"], F.concat_ws("_", F.col(U).cast("string"), "model"))


_MARK = "coalesce(md5(cast({0} as varchar)), 'null')"


@query("a21_panel_fingerprint", f"""with {V.HP}, p as (select lang, concat_ws('|', {', '.join(_MARK.format(c) for c in ('unit_id', "case when unit_id % 9 > 0 then sequence end", 'structure'))}) as name from hp), {_tree('p', 'lang', 'name')} select lang, n_names, digest from tree""")
def a21f(spark, sf):
    # each ninth unit has no sequence
    return G.panel_fingerprint(V.hairpins(spark, sf).withColumn("sequence", F.when(F.col(U) % 9 > 0, F.col("sequence"))), ["lang"])


@query("c7_bootstrap_fraction", f"""with {V.RUNS}, k as (select model, key, (flag = 'F')::int as x from runs), {_boot('k', 'key', ['x'], '7')},
  p as (select model, avg(x) as point, count(*) as n from k group by model) select p.model, round(point, 9) as point, n, round(quantile_cont(br.x, 0.025), 9) as ci_low, round(quantile_cont(br.x, 0.975), 9) as ci_high from p join br using (model) group by all""")
def c7_fraction(spark, sf):
    r = V.runs(spark, sf).select("model", "key", (F.col("flag") == "F").cast("int").alias("x"))
    return rounded(R.bootstrap_ci(spread(r, "key"), ["model"], "key", "x", V.BOOT, "7"), "point", "ci_low", "ci_high")
