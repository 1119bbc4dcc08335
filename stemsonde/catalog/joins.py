"""Join and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import scores as N
from . import query
from . import views as V

U = "unit_id"
COS = "round(1.0 - list_cosine_similarity(a.vec::double[], b.vec::double[]), 9)"
EV = f"""{V.EMB}, v as (select unit_id, layer, vec_id as row, 'wt' as variant, vec from emb union all
  select unit_id, layer, vec_id, 'mut', list_reverse(vec) from emb union all select unit_id, layer, vec_id, 'repeat', vec from emb)"""


def rounded(df, *cols, places=9):
    return df.withColumns({c: F.round(c, places) for c in cols})


def swiftly_rounded(df, *cols, places=9):
    """The same in compiled floating point for tables of many rows; values next to a tie, and very large ones, are left to ``round``."""
    def one(c):
        x = F.col(c) * float(10 ** places)
        near = F.rint(x)
        return F.when((F.abs(x) < float(1 << 40)) & (F.abs(x - near) < 0.499), near / float(10 ** places) + F.lit(0.0)).otherwise(F.round(c, places))
    return df.withColumns({c: one(c) for c in cols})


@query("j1_compare_variants", f"""with {EV} select b.unit_id, b.layer, b.row, b.variant, round({COS}, 9) + 0.0 as delta from v a join v b using (unit_id, layer, row) where a.variant = 'wt' and b.variant <> 'wt'""")
def j1(spark, sf):
    d = J.compare_variants(V.emb_variants(spark, sf))
    return d.select(U, "layer", "row", "variant", (F.round("delta", 9) + F.lit(0.0)).alias("delta"))


@query("j1_compare_positions", f"""with {V.EMB}, p as (select unit_id, layer, row, vec, unnest(range(row * 2, row * 2 + 2)) as pos from emb)
  select a.unit_id, 'mut' as variant, a.layer, a.pos, {COS} as delta from p a join emb b on a.unit_id = b.unit_id and a.layer = b.layer and b.row = (a.pos + 1) // 2""")
def j1p(spark, sf):
    # one row covers positions 2r, 2r+1 in the reference and 2r-1, 2r in the variant
    e = V.emb_rows(spark, sf).select(U, "layer", "row", "vec")
    rows = e.select(U, "row").distinct()
    cover = lambda lo: rows.select(U, "row", F.explode(F.sequence(F.col("row") * 2 + lo, F.col("row") * 2 + lo + 1)).alias("pos"))
    d = J.compare_positions(e, e.withColumn("variant", F.lit("mut")), cover(0), cover(-1).withColumn("variant", F.lit("mut")))
    return rounded(d.select(U, "variant", "layer", "pos", "delta"), "delta")


_ARMS = f"""with {V.PANEL}, a as (select unit_id, ratio from panel where model = '1-URGENT'), b as (select unit_id, ratio from panel where model = '2-HIGH')"""


def arm(spark, sf, model):
    return V.panel(spark, sf).filter(F.col("model") == model)


@query("j2_paired_units", f"{_ARMS} select unit_id, a.ratio as a, b.ratio as b from a join b using (unit_id)")
def j2(spark, sf):
    return J.paired_units(arm(spark, sf, "1-URGENT"), arm(spark, sf, "2-HIGH"), [U], "ratio")


@query("j3_common_units", f"""with {V.PANEL}, c as (select unit_id from panel group by unit_id having count(distinct model) = 5) select model, unit_id, ratio from panel where unit_id in (select unit_id from c)""")
def j3(spark, sf):
    return J.common_units(V.panel(spark, sf).select("model", U, "ratio"), 5, arm="model")


@query("j4_join_common", f"""with {V.PANEL}, j as (select p.unit_id, p.model, ratio, c_acctbal as covariate, c_nationkey as nation from panel p join customer on c_custkey = unit_id),
  k as (select model, nation from j group by all having count(*) >= 5) select j.* from j join k using (model, nation)""")
def j4(spark, sf):
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias(U), F.col("c_acctbal").alias("covariate"), F.col("c_nationkey").alias("nation"))
    return J.join_common(V.panel(spark, sf).select(U, "model", "ratio"), c, ["model", "nation"])


@query("j5_merge_runs", f"""with {V.PANEL}, o as (select unit_id, nullif(h3_n, 3) as h3_n, nullif(best_layer, 1) as best_layer from panel where model = '1-URGENT'), n as (select unit_id, nullif(h3_n, 3) as h3_n, nullif(best_layer, 1) as best_layer from panel where model = '2-HIGH'),
  m as (select coalesce(o.unit_id, n.unit_id) as unit_id, case when n.unit_id is not null then 'new' when coalesce(o.unit_id, n.unit_id) % 10 = 0 then 'conflict' else 'old' end as source,
    o.h3_n as oh, n.h3_n as nh, o.best_layer as ob, n.best_layer as nb from o full join n on o.unit_id = n.unit_id),
  r as (select unit_id, source, case source when 'new' then nh when 'old' then oh end as h3_n, case source when 'new' then nb when 'old' then ob end as best_layer from m)
  select *, case when source <> 'conflict' then sha256(concat_ws('|', coalesce(md5(cast(h3_n as varchar)), 'null'), coalesce(md5(cast(best_layer as varchar)), 'null'))) end as sha256 from r""")
def j5(spark, sf):
    old, new = (arm(spark, sf, m).withColumns({"h3_n": F.nullif("h3_n", F.lit(3)), "best_layer": F.nullif("best_layer", F.lit(1))}) for m in ("1-URGENT", "2-HIGH"))
    return J.merge_runs(old, new, [U], F.col(U) % 10 == 0, ["h3_n", "best_layer"])


@query("j6_patch_run", f"""with {V.PANEL}, b as (select unit_id, h3_n from panel where model = '1-URGENT'), p as (select unit_id, h3_n from panel where model = '2-HIGH' and unit_id % 4 = 0)
  select * from p union all select * from b where unit_id not in (select unit_id from p)""")
def j6(spark, sf):
    b, p = arm(spark, sf, "1-URGENT").select(U, "h3_n"), arm(spark, sf, "2-HIGH").select(U, "h3_n")
    return J.patch_run(b, p, p.filter(F.col(U) % 4 == 0).select(U), [U])


@query("j6_patch_problems", f"""with {V.PANEL}, w as (select c_custkey as unit_id from customer where c_custkey % 4 = 0), p as (select unit_id from panel where model = '2-HIGH')
  select unit_id, 'missing' as problem from w where unit_id not in (select unit_id from p) union all select unit_id, 'unexpected' from p where unit_id % 4 <> 0""")
def j6p(spark, sf):
    allowed = V.table(spark, sf, "customer").filter(F.col("c_custkey") % 4 == 0).select(F.col("c_custkey").alias(U))
    return J.patch_problems(arm(spark, sf, "2-HIGH").select(U), allowed, [U])


@query("j7_diff_runs", f"""with {V.PANEL}, a as (select unit_id, h3_n, best_layer from panel where model = '1-URGENT'), b as (select unit_id, h3_n, best_layer from panel where model = '2-HIGH'),
  m as (select coalesce(a.unit_id, b.unit_id) as unit_id, a.unit_id as ai, b.unit_id as bi, a.h3_n as ah, b.h3_n as bh, a.best_layer as al, b.best_layer as bl from a full join b on a.unit_id = b.unit_id)
  select unit_id, '(row)' as field, case when ai is not null then 'present' end as before, case when bi is not null then 'present' end as after from m where ai is null or bi is null
  union all select unit_id, 'h3_n', cast(ah as varchar), cast(bh as varchar) from m where ai = bi and ah <> bh union all select unit_id, 'best_layer', cast(al as varchar), cast(bl as varchar) from m where ai = bi and al <> bl""")
def j7(spark, sf):
    return J.diff_runs(arm(spark, sf, "1-URGENT"), arm(spark, sf, "2-HIGH"), [U], ["h3_n", "best_layer"])


@query("j8_drift", f"""with {V.PANEL}, {V.PLAY}, b as (select model, unit_id, layer, ps, best_layer from play join panel using (model, unit_id)),
  a2 as (select * from b where model = '1-URGENT'), b2 as (select * from b where model = '2-HIGH'),
  u as (select a2.unit_id, max(abs(a2.ps - b2.ps)) as w, max((a2.best_layer <> b2.best_layer)::int) as mv from a2 join b2 using (unit_id, layer) group by all)
  select 1 as run, round(max(w), 9) as worst, sum(mv) as layer_moves, count(*) as compared from u""")
def j8(spark, sf):
    p = V.panel_layers(spark, sf).join(V.panel(spark, sf).select("model", U, "best_layer"), ["model", U]).withColumn("run", F.lit(1))
    d = J.drift(p.filter(F.col("model") == "1-URGENT"), p.filter(F.col("model") == "2-HIGH"), ["run"])
    return rounded(d, "worst")


@query("j9_leaf_diff", f"""with {V.RUNS}, a as (select key, cents, flag, unit_id from runs),
  l as (select key, 'summary.cents' as path, cast(cents as varchar) as l, cast(case when key % 3 = 0 then cents + 1 else cents end as varchar) as r from a
    union all select key, 'list[0]', flag, case when key % 5 = 0 then 'Z' else flag end from a
    union all select key, 'list[1]', 'x', case when key % 7 <> 0 then 'x' end from a
    union all select key, concat('byname.', flag), cast(unit_id as varchar), cast(unit_id as varchar) from a)
  select key, path, l as "left", r as "right", case when r is null then 'only_left' else 'differs' end as kind from l where l is distinct from r""")
def j9(spark, sf):
    r = V.runs(spark, sf)
    doc = lambda cents, first, items: F.struct(F.struct(cents.alias("cents")).alias("summary"), items.alias("list"),
                                               F.create_map("flag", F.col(U)).alias("byname"), first.alias("stamp"))
    a = r.select("key", doc(F.col("cents"), F.lit("t1"), F.array("flag", F.lit("x"))).alias("doc"))
    head = F.when(F.col("key") % 5 == 0, "Z").otherwise(F.col("flag"))
    b = r.select("key", doc(F.when(F.col("key") % 3 == 0, F.col("cents") + 1).otherwise(F.col("cents")), F.lit("t2"),
                            F.when(F.col("key") % 7 == 0, F.array(head)).otherwise(F.array(head, F.lit("x")))).alias("doc"))
    return J.leaf_diff(a, b, ["key"], "doc", frozenset({"stamp"}))


# queries are slices of the units, targets the units themselves, families of eight
_FAM = f"""with {V.HP}, t as (select unit_id as member, unit_id // 8 as family, sequence from hp),
  q as (select unit_id as query, unit_id // 8 as family, case when unit_id % 5 = 0 then sequence when unit_id % 5 = 1 then reverse(substr(sequence, 10, 30)) else substr(sequence, 11, 40) end as sequence from hp)"""


def _families(spark, sf):
    u = V.hairpins(spark, sf)
    fam = F.floor(F.col(U) / 8).alias("family")
    s = (F.when(F.col(U) % 5 == 0, F.col("sequence")).when(F.col(U) % 5 == 1, F.reverse(F.substring("sequence", 10, 30)))
         .otherwise(F.substring("sequence", 11, 40)))
    return u.select(F.col(U).alias("query"), fam, s.alias("sequence")), u.select(F.col(U).alias("member"), fam, "sequence")


@query("j10_kmer_containment", f"""{_FAM}, qk as (select distinct query, family, substr(sequence, p, 8) as k from (select *, unnest(range(1, length(sequence) - 6)) as p from q)),
  tk as (select distinct member, family, substr(sequence, p, 8) as k from (select *, unnest(range(1, length(sequence) - 6)) as p from t)), n as (select query, count(*) as n from qk group by query),
  s as (select query, family, member, count(*) as shared from qk join tk using (family, k) group by all) select query, family, member, shared, round(shared / cast(n as double), 9) as containment from s join n using (query)""")
def j10(spark, sf):
    return rounded(J.kmer_containment(*_families(spark, sf)), "containment")


@query("j10_best_containment", f"""{_FAM}, qk as (select distinct query, family, substr(sequence, p, 8) as k from (select *, unnest(range(1, length(sequence) - 6)) as p from q)),
  tk as (select distinct member, family, substr(sequence, p, 8) as k from (select *, unnest(range(1, length(sequence) - 6)) as p from t)), n as (select query, count(*) as n from qk group by query),
  s as (select query, family, member, count(*) as shared from qk join tk using (family, k) group by all), b as (select query, family, shared / cast(n as double) as c, member, row_number() over (partition by query, family order by shared desc, member) as r from s join n using (query))
  select query, family, round(c, 9) as containment, member from b where r = 1""")
def j10b(spark, sf):
    q, t = _families(spark, sf)
    return rounded(J.best_target(q, t), "containment")


@query("j11_match_members", f"""{_FAM} select query, family, member, strpos(t.sequence, q.sequence) - 1 as "offset", case when t.sequence = q.sequence then 'exact' else 'substring' end as kind
  from q join t using (family) where contains(t.sequence, q.sequence)""")
def j11(spark, sf):
    return J.match_members(*_families(spark, sf))


@query("j12_hamming_identity", f"""with {V.HP}, p as (select a.unit_id, a.sequence as x, case when a.unit_id % 6 = 0 then substr(b.sequence, 2) else b.sequence end as y from hp a join hp b on b.unit_id = a.unit_id + 1),
  c as (select unit_id, x, y, unnest(range(1, length(x) + 1)) as c from p) select unit_id, round(case when length(x) = length(y) then avg((substr(x, c, 1) = substr(y, c, 1))::int) end, 9) as identity from c group by unit_id, x, y""")
def j12(spark, sf):
    u = V.hairpins(spark, sf)
    b = u.select((F.col(U) - 1).alias(U), F.col("sequence").alias("other"))
    y = F.when(F.col(U) % 6 == 0, F.expr("substr(other, 2)")).otherwise(F.col("other"))
    return rounded(u.join(b, U).select(U, J.hamming_identity(F.col("sequence"), y).alias("identity")), "identity")


@query("j13_same_group_pairs", f"""{V.WITH_ELIG} select a.unit_id, a.i, a.j, b.j as decoy from elig a join elig b on a.unit_id = b.unit_id and a.sj = b.sj
  where a.i <> b.i and abs(a.j - b.j) > 1 and a.i <> b.j""")
def j13(spark, sf):
    return N.complementary_decoys(V.hairpins(spark, sf), "family")
