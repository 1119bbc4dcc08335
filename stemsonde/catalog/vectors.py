"""Vector queries over the embedding views."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import brackets as B
from ..functions.draws import draw_unit, seeds
from ..functions.vectors import cosine_distance
from ..operators import structure as S
from ..operators import vectors as E
from ..operators.choice import draw_table
from . import query
from . import views as V
from .joins import COS, EV, rounded

U = "unit_id"
UL = [U, "layer"]


@query("e1_cosine_distance", f"select a.vec_id, {COS.replace('a.vec', 'a.embedding').replace('b.vec', 'b.embedding')} as distance from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def e1(spark, sf):
    e = V.table(spark, sf, "embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rounded(e.join(nxt, "vec_id").select("vec_id", cosine_distance(F.col("embedding"), F.col("other")).alias("distance")), "distance")


_MUT = "case when row % 7 = 0 then row else row - row % 7 end"


@query("e2_delta_profile", f"with {EV} select b.unit_id, b.layer, b.row, b.variant, round({COS}, 9) + 0.0 as delta from v a join v b using (unit_id, layer, row) where a.variant = 'wt' and b.variant <> 'wt' and b.row % 7 <> 0")
def e2(spark, sf):
    d = E.delta_profile(V.emb_variants(spark, sf))
    return d.select(U, "layer", "row", "variant", (F.round("delta", 9) + F.lit(0.0)).alias("delta"))


@query("e3_self_delta", f"with {EV} select b.unit_id, b.layer, b.row, b.variant, round({COS}, 9) + 0.0 as delta from v a join v b using (unit_id, layer, row) where a.variant = 'wt' and b.variant <> 'wt' and b.row % 7 = 0")
def e3(spark, sf):
    d = E.self_delta(V.emb_variants(spark, sf))
    return d.select(U, "layer", "row", "variant", (F.round("delta", 9) + F.lit(0.0)).alias("delta"))


@query("e4_same_span", f"with {V.HP}, p as (select unit_id, unnest(range(length(sequence))) as pos from hp) select unit_id, pos, not (pos // 3 >= 10 and unit_id % 3 = 0) as same_span from p")
def e4(spark, sf):
    from .structure import _spans
    s = _spans(spark, sf)
    rows = S.position_rows(s, [U]).join(s.select(U, "row", "start", "end"), [U, "row"])
    moved = (F.col("row") >= 10) & (F.col(U) % 3 == 0)
    mut = rows.withColumn("end", F.when(moved, F.col("end") + 1).otherwise(F.col("end")))
    return E.same_span(rows, mut)


@query("e5_noop_floor", f"with {EV} select unit_id, 0.0 as noop_floor from v group by unit_id")
def e5(spark, sf):
    # the repeat pass is identical, so the floor is the rounding of 1 - cos
    f = E.noop_floor(V.emb_variants(spark, sf))
    return f.select(U, (F.round("noop_floor", 9) + F.lit(0.0)).alias("noop_floor"))


_POOL = """p as (select layer, label, d as dim, avg(vec[d]::double) as x from (select vec_id % 3 as layer, label, embedding as vec, unnest(range(1, 65)) as d from embeddings) group by all),
  pv as (select layer, label, list(x order by dim) as vec from p group by all), dist as (select b.layer, b.label, 1.0 - list_cosine_similarity(a.vec, b.vec) as distance from pv b join pv a on a.layer = b.layer and a.label = 0)"""


@query("e6_pooled_distance", f"with {_POOL} select cast(layer as int) as layer, label, round(distance, 8) + 0.0 as distance from dist")
def e6(spark, sf):
    e = V.embeddings(spark, sf).withColumnRenamed(U, "label")
    return E.pooled_distance(e, "label").select("layer", "label", (F.round("distance", 8) + F.lit(0.0)).alias("distance"))


@query("e6_graded_best_layer", f"""with {_POOL}, k as (select layer, rank() over (partition by layer order by label) as rx, rank() over (partition by layer order by round(distance, 10) + 0.0) as ry from dist), r as (select layer, corr(rx, ry) as rho from k group by layer)
  select cast(layer as int) as layer, round(rho, 8) as rho, round(abs(rho), 8) as abs_rho from (select *, row_number() over (order by round(abs(rho), 9) desc, layer) as n from r) where n = 1""")
def e6b(spark, sf):
    e = V.embeddings(spark, sf).withColumnRenamed(U, "label")
    d = E.pooled_distance(e, "label").withColumn("distance", F.round("distance", 10) + F.lit(0.0))
    return rounded(E.graded_best_layer(d, "label"), "rho", "abs_rho", places=8)


# variants of a unit: its layers, with the middle as long as the rows allow
FLANK, SLOTS = 4, 5
_AL = f"""with {V.EMB}, w as (select *, count(*) over (partition by unit_id, layer) - {2 * FLANK} as m from emb), b as (select *, row - {FLANK} as mid, m // {SLOTS} as blk from w),
  s as (select unit_id, layer, vec, case when row < {FLANK} then row when mid < m and blk >= 1 and mid < blk * {SLOTS} then {FLANK} + mid // blk when mid < m and blk < 1 then {FLANK} + mid
    when row >= {FLANK} + m then row - m + {SLOTS} end as slot from b),
  d as (select unit_id, layer, slot, unnest(range(1, 65)) as dim, vec from s where slot is not null), a as (select unit_id, layer, slot, dim, avg(vec[dim]::double) as x from d group by all),
  g as (select distinct unit_id, layer, unnest(range({2 * FLANK + SLOTS})) as slot from emb),
  al as (select g.unit_id, g.layer, g.slot, coalesce(v.vec, list_transform(range(64), lambda z: 0.0::double)) as vec from g left join (select unit_id, layer, slot, list(x order by dim) as vec from a group by all) v using (unit_id, layer, slot)),
  di as (select b.unit_id, b.layer, b.slot, 1.0 - list_inner_product(a.vec, b.vec) / ((sqrt(list_inner_product(a.vec, a.vec)) + 1e-10) * (sqrt(list_inner_product(b.vec, b.vec)) + 1e-10)) as di,
    case when b.slot < {FLANK} then 'left' when b.slot < {FLANK + SLOTS} then 'middle' else 'right' end as region from al a join al b using (unit_id, slot) where a.layer = 0 and b.layer <> 0)"""


def _aligned(spark, sf):
    r = V.emb_rows(spark, sf)
    n = r.groupBy(*UL).agg((F.count(F.lit(1)) - 2 * FLANK).alias("middle"))
    return E.align_regions(r.join(n, UL), FLANK, SLOTS, by=UL)


def _di(spark, sf):
    return E.direction_instability(_aligned(spark, sf), "layer", 0, [U])


@query("e7_align_regions", f"{_AL} select unit_id, layer, slot, round(list_sum(vec), 7) as total, round(vec[1], 8) as head from al")
def e7(spark, sf):
    a = _aligned(spark, sf)
    total = F.aggregate("vec", F.lit(0.0), lambda x, y: x + y)
    return a.select(*UL, "slot", F.round(total, 7).alias("total"), F.round(F.get("vec", F.lit(0)), 8).alias("head"))


@query("e8_direction_instability", f"{_AL} select unit_id, layer, slot, region, round(di, 8) as di from di")
def e8(spark, sf):
    return rounded(_di(spark, sf).select(*UL, "slot", "region", "di"), "di", places=8)


@query("e8_instability_summary", f"""{_AL}, p as (select unit_id, slot, region, avg(di) as di from di group by all), gg as (select unit_id, avg(di) filter (where region = 'left') as l, avg(di) filter (where region = 'middle') as m, avg(di) filter (where region = 'right') as r,
  max(di) - min(di) as di_range from p group by all) select unit_id, round(l, 8) as left_di, round(m, 8) as middle_di, round(r, 8) as right_di, round(di_range, 8) as di_range, round(m / l, 6) as elevation from gg""")
def e8s(spark, sf):
    s = E.instability_summary(_di(spark, sf), [U])
    return rounded(rounded(s, "left_di", "middle_di", "right_di", "di_range", places=8), "elevation", places=6)


@query("e8_instability_by_deviation", f"""{_AL}, p as (select unit_id, slot % 6 as variant, slot % 6 as dev, avg(di) as di from di group by all), k as (select unit_id, rank() over (partition by unit_id order by dev) as rx,
  rank() over (partition by unit_id order by round(di, 10)) as ry from p) select unit_id, count(*) as n, round(corr(rx, ry), 8) as rho from k group by unit_id""")
def e8d(spark, sf):
    # slots modulo six stand for six variants of a unit
    d = _di(spark, sf).withColumns({"variant": F.col("slot") % 6, "dev": F.col("slot") % 6})
    return rounded(E.instability_by_deviation(d, "dev", by=[U]), "rho", places=8)


@query("e9_window_norm", f"""with {V.EMB}, n as (select *, sqrt(list_inner_product(vec::double[], vec::double[])) as x, count(*) over (partition by unit_id, layer) as n from emb), w as (select *, unnest([4, 10, 20]) as win from n),
  g as (select unit_id, layer, win, avg(x) as m, count(*) as c from w where row >= greatest(0, n // 2 - win // 2) and row < least(n, n // 2 + win // 2) group by all)
  select unit_id, layer, win as "window", round(m, 8) as mean_norm, c as n, round(m / sqrt(c), 8) as corrected from g""")
def e9(spark, sf):
    return rounded(E.window_norm(V.emb_rows(spark, sf), [4, 10, 20], UL), "mean_norm", "corrected", places=8)


@query("e10_dimension_norm", """with d as (select label as unit_id, unnest(range(64)) as dim, embedding from embeddings), g as (select unit_id, dim, sqrt(sum(power(embedding[dim + 1]::double, 2))) as norm, count(*) as n from d group by all)
  select unit_id, dim, n, round(norm, 7) as norm, round(norm / sqrt(n), 8) as corrected, rank from (select *, row_number() over (partition by unit_id order by norm / sqrt(n) desc, dim) as rank from g) where rank <= 20""")
def e10(spark, sf):
    return rounded(rounded(E.dimension_norm(V.embeddings(spark, sf), [U]), "norm", places=7), "corrected", places=8)


@query("e11_region_norm", """with n as (select label as unit_id, vec_id, sqrt(list_inner_product(embedding::double[], embedding::double[])) as x from embeddings) select unit_id, round(avg(x) filter (where vec_id % 5 < 2), 8) as mean_norm_inside,
  round(avg(x) filter (where vec_id % 5 >= 2), 8) as mean_norm_outside from n group by unit_id""")
def e11(spark, sf):
    r = E.region_norm(V.embeddings(spark, sf), F.col("vec_id") % 5 < 2, [U])
    return rounded(r, "mean_norm_inside", "mean_norm_outside", places=8)


# Eigenvalues are not SQL; their sum is the total variance and is checked as such.
@query("e12_total_variance", f"""with {V.EMB}, d as (select unit_id, layer, unnest(range(1, 65)) as dim, vec from emb), v as (select unit_id, layer, dim, count(*) as n, var_pop(vec[dim]::double) * count(*) as s from d group by all)
  select unit_id, layer, max(n) as n, round(sum(s), 6) as total from v group by all""")
def e12t(spark, sf):
    s = E.spectra(V.embeddings(spark, sf), UL)
    return s.select(*UL, "n", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("e12_effective_dim")
def e12(spark, sf):
    return rounded(E.effective_dim(E.spectra(V.embeddings(spark, sf), UL), UL), "first_share", places=8)


@query("e13_subspace_distance")
def e13(spark, sf):
    s = E.spectra(V.embeddings(spark, sf), UL)
    return rounded(E.subspace_distance(s, ["layer"], U, F.col(U) == 0), "geodesic", "max_angle_deg", places=6)


@query("e14_layer_similarity")
def e14(spark, sf):
    return rounded(E.layer_similarity(E.spectra(V.embeddings(spark, sf), UL), [U]), "mean_cos", places=6)


@query("e15_spectrum")
def e15(spark, sf):
    s = E.spectrum(E.spectra(V.embeddings(spark, sf), [U], centred=False), [U])
    return s.select(U, "effective_rank", F.round("decay", 6).alias("decay"), F.round(F.get("top_values", F.lit(0)), 6).alias("first_value"))


# uncentred: the squared singular values add up to the squared norms of the rows
@query("e15_energy", "select label as unit_id, count(*) as n, round(sum(list_inner_product(embedding::double[], embedding::double[])), 6) as energy from embeddings group by label")
def e15e(spark, sf):
    s = E.spectra(V.embeddings(spark, sf), [U], centred=False)
    return s.select(U, "n", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("energy"))


@query("e16_component_correlation")
def e16(spark, sf):
    e = V.embeddings(spark, sf).withColumn("cov", (F.col("vec_id") % 17).cast("double"))
    return rounded(E.component_correlation(e, "cov", [U]), "share", "abs_r", places=6)


ATT_LAYERS, ATT_HEADS = 2, 3  # the last head is flat
_N = len(V.STRUCTURE)
_CELL = lambda r, c: V.RDRAW.replace("rep", f"({r} * {_N} + {c})")
_ATT = f"""with recursive {V.HP}, {V.PAIRS.format(src='hp')}, hd as (select *, {V.seeds("'att'", 'unit_id', 'layer', 'head')} from hp, (select unnest(range({ATT_LAYERS})) as layer), (select unnest(range({ATT_HEADS - 1})) as head)),
  g as (select unnest(range({_N})) as r), g2 as (select r, unnest(range(r + 1, {_N})) as c from g),
  k as (select hd.unit_id, layer, head, ({_CELL('r', 'c')} + {_CELL('c', 'r')}) / {2.0 * V.PRIME}e0 as w, (p.i is not null)::int as contact from hd cross join g2 left join pairs p on p.unit_id = hd.unit_id and p.i = r and p.j = c),
  rk as (select *, rank() over (partition by unit_id, layer, head order by w) + (count(*) over (partition by unit_id, layer, head, w) - 1) / 2.0 as rx from k),
  rho as (select unit_id, layer, head, count(*) as n, coalesce(corr(rx, contact), 0.0) as rho from rk group by all)"""


@query("e17_attention_contact", f"{_ATT} select unit_id, layer, head, n, case when abs(rho) < 5e-9 then 0.0 else round(rho, 8) end as rho from rho")
def e17(spark, sf):
    rho = F.when(F.abs("rho") < 5e-9, 0.0).otherwise(F.round("rho", 8))  # no negative zero
    return _attention(spark, sf).withColumn("rho", rho)


# the best head starts from 0 at layer 0
@query("e17_best_head", f"""{_ATT}, b as (select *, row_number() over (partition by unit_id order by rho desc, layer, head) as k from rho)
  select unit_id, round(case when rho > 0 then rho else 0.0 end, 8) as best_corr, case when rho > 0 then layer else 0 end as best_layer from b where k = 1""")
def e17b(spark, sf):
    return rounded(E.best_head(_attention(spark, sf)), "best_corr", places=8)


def _attention(spark, sf):
    """Whole matrices of every unit: layers x heads of keyed weights, and a flat head in each layer."""
    u = S.spread(V.hairpins(spark, sf))
    contacts = F.transform(B.match_pairs(F.col("structure")), lambda p: F.struct(p["i"].alias("r"), p["j"].alias("c")))
    heads = u.select(U, contacts.alias("contacts")).select("*", F.explode(F.sequence(F.lit(0), F.lit(ATT_LAYERS - 1))).alias("layer")) \
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(ATT_HEADS - 1))).alias("head"))
    numbers = F.when(F.col("head") < ATT_HEADS - 1, seeds("att", F.col(U), F.col("layer"), F.col("head")))
    return E.head_agreement(heads.withColumn("b", numbers), [U, "layer", "head"], weights=_drawn_heads)


def _drawn_heads(batch):
    """Matrices of the heads' draws, in whole numbers so that sums tie where they are equal; of one value without numbers."""
    b = batch.column("b")
    drawn = np.asarray(b.is_valid())
    out = np.full((len(b), _N * _N), V.PRIME // 2)
    numbers = np.asarray(b.flatten(), np.int64).reshape(-1, 3)
    out[drawn] = draw_table(numbers, 0, _N * _N - 1).T
    return out.reshape(-1, _N, _N)


@query("e18_probe")
def e18(spark, sf):
    e = V.embeddings(spark, sf).withColumnRenamed("vec_id", "row")
    lab = e.select(U, "row", (F.get("vec", F.lit(3)) > 0).cast("int").alias("label"))
    return rounded(E.probe(e, lab), "mean_accuracy", "sd_accuracy", places=6)


def _hash_encoder(sequences):
    """Two layers per sequence: a one-hot row per symbol, and its running mean."""
    out = []
    for s in sequences:
        one = np.array([[float(c == a) for a in "ACGU"] for c in s])
        out.append([one, np.cumsum(one, axis=0) / np.arange(1, len(s) + 1)[:, None]])
    return out


@query("e19_encode", f"""with {V.HP}, p as (select unit_id, sequence, unnest(range(length(sequence))) as row from hp), l as (select *, unnest(range(2)) as layer from p), s as (select *, unnest(range(1, 5)) as d from l),
  x as (select unit_id, layer, row, d, case when layer = 0 then (substr(sequence, row + 1, 1) = substr('ACGU', d, 1))::int else (length(substr(sequence, 1, row + 1)) - length(replace(substr(sequence, 1, row + 1), substr('ACGU', d, 1), ''))) / cast(row + 1 as double) end as v from s)
  select unit_id, layer, row, round(sum(v * d), 8) as code from x group by all""")
def e19(spark, sf):
    e = E.encode(V.hairpins(spark, sf), _hash_encoder, [U])
    code = F.aggregate("vec", F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("k")), lambda a, x: F.struct(
        (a["s"] + x * (a["k"] + 1)).alias("s"), (a["k"] + 1).alias("k")), lambda a: a["s"])
    return e.select(U, "layer", "row", F.round(code, 8).alias("code"))
