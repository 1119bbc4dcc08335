"""Resampling and test queries.  Statistics are compared; p-values too where a
sum of binomial terms gives them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.special import binom_test
from ..operators import aggregates as G
from ..operators import resampling as R
from ..operators.structure import spread
from . import query
from . import views as V
from .joins import arm, rounded

U = "unit_id"

# exact upper tail by log factorials; n stays below the table of a group
_TAIL = """tail as (select {keys}, sum(exp(lgamma({n} + 1.0) - lgamma(x + 1.0) - lgamma({n} - x + 1.0) + x * ln({p}) + ({n} - x) * ln(1.0 - {p}))) as p
  from (select {keys}, {n}, {k}, unnest(range(cast({k} as bigint), cast({n} as bigint) + 1)) as x from {src}) group by {keys})"""


@query("c1_binom_test", f"""with {V.PANEL}, g as (select model, unit_id % 20 as grp, count(*) filter (where exceeds_primary) as k, count(*) as n from panel group by all), {_TAIL.format(keys='model, grp', n='n', k='k', p='0.3', src='g')}
  select model, grp, k, n, round(p, 8) as p from g join tail using (model, grp)""")
def c1(spark, sf):
    g = V.panel(spark, sf).groupBy("model", (F.col(U) % 20).alias("grp")).agg(F.count_if("exceeds_primary").alias("k"), F.count(F.lit(1)).alias("n"))
    return rounded(g.withColumn("p", binom_test("k", "n", F.lit(0.3))), "p", places=8)


@query("c1_binom_interval")
def c1i(spark, sf):
    g = V.panel(spark, sf).groupBy("model").agg(F.count_if("exceeds_primary").alias("k"), F.count(F.lit(1)).alias("n"))
    ci = R.binom_ci(F.col("k"), F.col("n"))
    return rounded(g.withColumn("ci", ci).select("model", "k", "n", "ci.low", "ci.high"), "low", "high", places=8)


@query("c2_sign_test", f"""with {V.PANEL}, g as (select model, count(*) filter (where h3_fraction > 0.5) as above, count(*) filter (where h3_fraction < 0.5) as below, count(*) filter (where h3_fraction = 0.5) as at_half from panel group by model), h as (select *, above + below as n_sign from g),
  {_TAIL.format(keys='model', n='n_sign', k='above', p='0.5', src='h')} select model, above, below, at_half, n_sign, round(p, 6) as p from h join tail using (model)""")
def c2(spark, sf):
    return rounded(R.sign_test(V.panel(spark, sf), ["model"], "h3_fraction"), "p", places=6)


@query("c3_paired_sign", f"""with {V.PANEL}, j as (select a.unit_id % 6 as grp, a.ratio as a, b.ratio as b from panel a join panel b on a.unit_id = b.unit_id and a.model = '1-URGENT' and b.model = '2-HIGH'), g as (select grp, count(*) filter (where a > b) as wins, count(*) as total from j group by grp),
  {_TAIL.format(keys='grp', n='total', k='wins', p='0.5', src='g')} select grp, wins, total, round(p, 7) as p from g join tail using (grp)""")
def c3(spark, sf):
    a, b = (arm(spark, sf, m).withColumn("grp", F.col(U) % 6) for m in ("1-URGENT", "2-HIGH"))
    return rounded(R.paired_sign(a, b, ["grp"], U, "ratio"), "p", places=7)


_WIL = f"""with {V.PANEL}, x as (select model, h3_fraction - chance_fraction as x from panel), nz as (select model, abs(x) as m, x > 0 as up from x where x <> 0),
  r as (select model, up, rank() over (partition by model order by m) + (count(*) over (partition by model, m) - 1) / 2.0 as r from nz)"""


@query("c4_wilcoxon_statistic", f"""{_WIL}, t as (select model, sum(n * n * n - n) as tie_term from (select model, m, count(*) as n from nz group by all) group by model), z as (select model, count(*) filter (where x = 0) as n_zero from x group by model)
  select model, n_zero, sum(r) filter (where up) as w_plus, count(*) as n, cast(any_value(tie_term) as double) as tie_term from r join t using (model) join z using (model) group by all""")
def c4(spark, sf):
    x = V.panel(spark, sf).withColumn("x", F.col("h3_fraction") - F.col("chance_fraction"))
    return R.wilcoxon(x, "x", ["model"]).drop("p")


@query("c4_wilcoxon_p")
def c4p(spark, sf):
    x = V.panel(spark, sf).withColumn("x", F.col("h3_fraction") - F.col("chance_fraction"))
    return R.wilcoxon(x, "x", ["model"], "greater").select("model", F.round("p", 8).alias("p"))


@query("c5_mann_whitney_statistic", f"""with {V.PANEL}, r as (select model, unit_id % 2 = 0 as f, rank() over (partition by model order by h3_fraction) + (count(*) over (partition by model, h3_fraction) - 1) / 2.0 as r from panel),
  g as (select model, count(*) filter (where f) as n1, count(*) filter (where not f) as n2, sum(r) filter (where f) as rs from r group by model) select model, n1, n2, rs - n1 * (n1 + 1) / 2.0 as u, round(2.0 * (rs - n1 * (n1 + 1) / 2.0) / (n1 * n2) - 1.0, 8) as effect from g""")
def c5(spark, sf):
    m = R.mann_whitney(V.panel(spark, sf), "h3_fraction", F.col(U) % 2 == 0, ["model"])
    return rounded(m.select("model", "n1", "n2", "u", "effect"), "effect", places=8)


@query("c5_mann_whitney_p")
def c5p(spark, sf):
    m = R.mann_whitney(V.panel(spark, sf), "h3_fraction", F.col(U) % 2 == 0, ["model"])
    return m.select("model", F.round("p", 8).alias("p"))


@query("c6_paired_t_statistic", f"""with {V.PANEL} select model, count(*) as n, round(avg(ratio - h3_fraction), 8) as mean_diff, round(stddev_samp(ratio - h3_fraction), 7) as sd_diff, round(avg(ratio - h3_fraction) / (stddev_samp(ratio - h3_fraction) / sqrt(count(*))), 5) as t from panel group by model""")
def c6(spark, sf):
    t = R.paired_t(V.panel(spark, sf), "ratio", "h3_fraction", ["model"])
    return rounded(rounded(rounded(t.drop("p"), "mean_diff", places=8), "sd_diff", places=7), "t", places=5)


@query("c6_paired_t_p")
def c6p(spark, sf):
    p = V.panel(spark, sf).withColumn("grp", F.col(U) % 50)
    return R.paired_t(p, "h3_fraction", "chance_fraction", ["grp"]).select("grp", "n", F.round("p", 8).alias("p"))


def _boot(src, key, values, seed):
    """br(model, rep, values): Poisson(1) counts from four 32-bit draws of one digest."""
    u = "cast(concat('0x', substr(h, 1 + 8 * slot, 8)) as bigint)"
    w = "case " + " ".join(f"when u < {t} then {k}" for k, t in enumerate(R.poisson_steps())) + f" else {len(R.poisson_steps())} end"
    v = ", ".join(values)
    return f"""bk as (select model, {v}, {key} as bkey, unnest(range(0, {(V.BOOT - 1) // R.PER_DRAW + 1})) as blk from {src}), bh as (select model, {v}, blk, {V.hexd(f"'{seed}'", 'model', 'blk', 'bkey')} as h, unnest(range(0, {R.PER_DRAW})) as slot from bk),
  bw as (select model, {v}, rep, {w} as w from (select model, {v}, blk * {R.PER_DRAW} + slot + 1 as rep, {u} as u from bh) where rep <= {V.BOOT}),
  br as (select model, rep, {', '.join(f'sum({x} * w) / cast(sum(w) as double) as {x}' for x in values)} from bw group by model, rep having sum(w) > 0)"""


@query("c7_bootstrap_ci", f"""with {V.RUNS}, {_boot('runs', 'key', ['score'], '5')}, p as (select model, avg(score) as point, count(*) as n from runs group by model)
  select model, round(any_value(point), 8) as point, any_value(p.n) as n, round(quantile_cont(score, 0.025), 8) as ci_low, round(quantile_cont(score, 0.975), 8) as ci_high from br join p using (model) group by model""")
def c7(spark, sf):
    return rounded(R.bootstrap_ci(spread(V.runs(spark, sf).select("model", "key", "score"), "key"), ["model"], "key", "score", V.BOOT, "5"), "point", "ci_low", "ci_high", places=8)


@query("c8_bootstrap_excess", f"""with {V.PANEL}, {_boot('panel', 'unit_id', ['h3_fraction', 'chance_fraction'], '6')}, p as (select model, avg(h3_fraction) - avg(chance_fraction) as point, count(*) as n from panel group by model)
  select model, round(any_value(point), 8) as point, any_value(p.n) as n, round(quantile_cont(h3_fraction - chance_fraction, 0.025), 8) as ci_low, round(quantile_cont(h3_fraction - chance_fraction, 0.975), 8) as ci_high, quantile_cont(h3_fraction - chance_fraction, 0.025) > 0 as holds from br join p using (model) group by model""")
def c8(spark, sf):
    return rounded(R.bootstrap_excess(V.panel(spark, sf), ["model"], U, "h3_fraction", "chance_fraction", V.BOOT, "6"), "point", "ci_low", "ci_high", places=8)


_ARMS = {"1-URGENT": "ti", "2-HIGH": "ta", "3-MEDIUM": "ui", "5-LOW": "ua"}
TESTS = {"difference": {"ui": 1, "ua": -1}, "did": {"ui": 1, "ua": -1, "ti": -1, "ta": 1}, "ablated": {"ta": 1}}
_DID = {"difference": "x_ui - x_ua", "did": "x_ui - x_ua - x_ti + x_ta", "ablated": "x_ta"}


def _cells(spark, sf):
    name = F.create_map(*[F.lit(x) for kv in _ARMS.items() for x in kv])
    return V.panel(spark, sf).filter(F.col("model").isin(*_ARMS)).select(
        (F.col(U) % 2).cast("string").alias("model"), U, F.element_at(name, F.col("model")).alias("arm"), F.col("h3_fraction").alias("precision"), F.col("chance_fraction").alias("chance"))


@query("c9_bootstrap_did", f"""with {V.PANEL}, c as (select unit_id, count(*) as n from panel where model in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') group by unit_id having count(*) = 4),
  w as (select cast(unit_id % 2 as varchar) as model, unit_id, {', '.join(f"max(h3_fraction - chance_fraction) filter (where model = '{m}') as x_{a}, max(h3_fraction) filter (where model = '{m}') as p_{a}" for m, a in _ARMS.items())} from panel join c using (unit_id) group by unit_id),
  s as (select model, unit_id, {', '.join(f'{e} as {n}' for n, e in _DID.items())} from w), {_boot('s', 'unit_id', list(TESTS), '9')}, l as (select model, unnest([{', '.join(f"{{'test': '{n}', 'v': {n}}}" for n in TESTS)}]) as e from br),
  ci as (select model, e.test as test, quantile_cont(e.v, 0.025) as lo, quantile_cont(e.v, 0.975) as hi from l group by all), pt as (select model, unnest([{', '.join(f"{{'test': '{n}', 'v': avg({n})}}" for n in TESTS)}]) as e from s group by model),
  fw as (select model, min(n) as fewest from (select cast(unit_id % 2 as varchar) as model, count(*) as n from panel where model in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') group by cast(unit_id % 2 as varchar), panel.model) group by model), mc as (select model, count(*) as n_common, avg(p_ta) < avg(p_ti) and avg(p_ua) < avg(p_ui) as ok from w group by model)
  select ci.model, test, round(e.v, 8) as point, round(lo, 8) as ci_low, round(hi, 8) as ci_high, n_common, fewest < 33 or not ok as void, not (fewest < 33 or not ok) and lo > 0 as holds from ci join pt on pt.model = ci.model and e.test = test join fw on fw.model = ci.model join mc on mc.model = ci.model""")
def c9(spark, sf):
    d = R.bootstrap_did(_cells(spark, sf), ["model"], U, list(_ARMS.values()), TESTS, V.BOOT, "9", manipulation=(("ta", "ti"), ("ua", "ui")))
    return rounded(d, "point", "ci_low", "ci_high", places=8)


_HELD = f"""with {V.PANEL}, {V.PLAY}, u as (select *, {V.seeds("'8'", 'model', 'unit_id')} from (select distinct model, unit_id from play)), sp as (select *, unnest(range(1, {V.REPS + 1})) as split, count(*) over (partition by model) as n from u),
  rk as (select *, row_number() over (partition by model, split order by {V.RDRAW.replace('rep', 'split')}, unit_id) <= n // 2 as chooser from sp),
  pl as (select rk.model, split, layer, avg(ps) filter (where chooser) as ps, avg(precision) filter (where not chooser) as precision, avg(chance) filter (where not chooser) as chance from rk join play using (model, unit_id) group by all),
  hd as (select model, split, layer, ps, precision, chance from (select *, row_number() over (partition by model, split order by round(ps, 12) desc, layer) as r from pl) where r = 1)"""


@query("c10_heldout_splits", f"{_HELD} select model, split, layer, round(ps, 8) as ps, round(precision, 8) as precision, round(chance, 8) as chance from hd")
def c10(spark, sf):
    return rounded(R.heldout(V.panel_layers(spark, sf), ["model"], V.REPS, "8"), "ps", "precision", "chance", places=8)


@query("c10_heldout_summary", f"{_HELD} select model, round(avg(precision), 8) as heldout, round(avg(chance), 8) as chance_heldout, round(quantile_cont(precision, 0.025), 8) as ci_low, round(quantile_cont(precision, 0.975), 8) as ci_high, count(*) as n_splits from hd group by model")
def c10s(spark, sf):
    return rounded(R.heldout_summary(R.heldout(V.panel_layers(spark, sf), ["model"], V.REPS, "8"), ["model"]), "heldout", "chance_heldout", "ci_low", "ci_high", places=8)


@query("c11_layer_selection", f"""with {V.PANEL}, {V.PLAY}, o as (select model, unit_id, precision, chance from (select *, row_number() over (partition by model, unit_id order by ps desc, layer) as r from play) where r = 1), ou as (select model, count(*) as n_units, avg(precision) as pu, avg(chance) as cu from o group by model),
  l as (select model, layer, avg(ps) as ps, avg(precision) as pr, avg(chance) as ch from play group by all), b as (select * from (select *, row_number() over (partition by model order by round(ps, 12) desc, layer) as r from l) where r = 1)
  select model, n_units, round(pu, 8) as per_unit, round(cu, 8) as chance_per_unit, layer as panel_layer, round(pr, 8) as panel, round(ch, 8) as chance_panel, {V.PANEL_LAYERS} as n_layers from ou join b using (model)""")
def c11(spark, sf):
    return rounded(R.layer_selection(V.panel_layers(spark, sf), ["model"]), "per_unit", "chance_per_unit", "panel", "chance_panel", places=8)


@query("c11_selection_problems", f"""with {V.PANEL}, {V.PLAY} select model, unit_id, best_layer from panel where unit_id % 7 = 2""")
def c11p(spark, sf):
    p = V.panel(spark, sf).select("model", U, "best_layer")
    own = p.join(V.panel_layers(spark, sf).withColumnRenamed("layer", "best_layer").select("model", U, "best_layer", "precision"), ["model", U, "best_layer"])
    stored = own.withColumn("precision", F.when(F.col(U) % 7 == 2, F.col("precision") + 0.01).otherwise(F.col("precision")))
    return R.selection_problems(V.panel_layers(spark, sf), stored, ["model"]).select("model", U, "best_layer")


@query("c12_depth_correlation", f"""with {V.PANEL}, {V.PLAY}, q as (select *, cast(model[1:1] as int) as depth from play where layer < 3 or model > '3'), o as (select model, unit_id, precision from (select *, row_number() over (partition by model, unit_id order by ps desc, layer) as r from q) where r = 1),
  l as (select model, layer, avg(ps) as ps, avg(precision) as pr, any_value(nl0) as nl from q join (select model, count(distinct layer) as nl0 from q group by model) using (model) group by model, layer), b as (select * from (select *, row_number() over (partition by model order by round(ps, 12) desc, layer) as r from l) where r = 1),
  g as (select b.model, nl, avg(o.precision) - any_value(pr) as gain from b join o using (model) group by all), k as (select rank() over (order by nl) + (count(*) over (partition by nl) - 1) / 2.0 as rx, rank() over (order by gain) as ry from g) select count(*) as n, round(corr(rx, ry), 8) as rho from k""")
def c12(spark, sf):
    p = V.panel_layers(spark, sf).filter((F.col("layer") < 3) | (F.col("model") > "3"))
    return rounded(R.depth_correlation(R.layer_selection(p, ["model"])), "rho", places=8)


@query("c13_multiple_testing", f"""with {V.PANEL} select model, count(*) as n_tested, count(*) filter (where exceeds_primary) as n_exceeding, round(count(*) * 0.05, 2) as expected_fp, round(0.05 / count(*), 4) as bonferroni_alpha, round(count(*) filter (where exceeds_primary) - count(*) * 0.05, 9) as excess from panel group by model""")
def c13(spark, sf):
    return rounded(R.multiple_testing(V.panel(spark, sf), ["model"], "exceeds_primary"), "excess")


@query("c14_gate_movement", f"""with {V.PANEL}, e as (select model, count(*) filter (where exceeds_conservative) as exceed from panel where status = 'scored' and not quarantined group by model), s as (select * from (values ('registered', 32), ('corrected', 35), ('repaired', 36)) as v(scenario, n))
  select model, exceed, scenario, n, (n * 20 + 99) // 100 as gate, exceed >= (n * 20 + 99) // 100 as passes, exceed - (n * 20 + 99) // 100 as margin from e cross join s""")
def c14(spark, sf):
    e = G.registered_summary(V.panel(spark, sf).withColumn("gate_pass", F.lit(True)), ["model"]).select("model", "exceed")
    return R.gate_movement(e, ["model"], {"registered": F.lit(32), "corrected": F.lit(35), "repaired": F.lit(36)})


@query("c15_bh_adjust", f"""with {V.RUNS}, p as (select key, model, cents / 6.0e7 as p from runs), r as (select *, row_number() over (partition by model order by p, key) as k, count(*) over (partition by model) as n from p),
  a as (select key, model, p, min(p * n / k) over (partition by model order by k rows between current row and unbounded following) as a from r) select key, model, round(min(a) over (partition by model, p), 9) as p_adjusted from a""")
def c15(spark, sf):
    r = V.runs(spark, sf).select("key", "model", (F.col("cents") / F.lit(6.0e7)).alias("p"))
    return rounded(R.bh_adjust(r, "p", ["model"], "key").select("key", "model", "p_adjusted"), "p_adjusted")
