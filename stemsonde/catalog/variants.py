"""Variant generation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import brackets as B
from ..functions.alphabet import TRANSVERSION, substitution
from ..operators import variants as M
from ..operators.structure import annotate
from ..sources import panel
from . import query
from . import views as V

U = "unit_id"


@query("v1_mutate", f"""with {V.HP}, p as (select *, unnest(range(length(sequence))) as mut_pos from hp)
  select unit_id, mut_pos, substr(sequence, mut_pos + 1, 1) as sym, translate(substr(sequence, mut_pos + 1, 1), 'ACGU', 'UGCA') as new_sym,
    concat(substr(sequence, 1, mut_pos), translate(substr(sequence, mut_pos + 1, 1), 'ACGU', 'UGCA'), substr(sequence, mut_pos + 2)) as variant from p""")
def v1(spark, sf):
    return M.mutate(V.hairpins(spark, sf))


@query("v1_mutate_eligible", f"""{V.WITH_ELIG} select h.unit_id, i as mut_pos, substr(sequence, i + 1, 1) as sym, translate(substr(sequence, i + 1, 1), 'ACGU', 'CAUC') as new_sym,
    concat(substr(sequence, 1, i), translate(substr(sequence, i + 1, 1), 'ACGU', 'CAUC'), substr(sequence, i + 2)) as variant from hp h join elig using (unit_id)""")
def v1e(spark, sf):
    a = annotate(V.hairpins(spark, sf))
    return M.mutate(a, TRANSVERSION, at=F.transform("eligible", lambda e: e["i"]))


@query("v2_mutate_pairs", f"""{V.WITH_ELIG} select h.unit_id, i, j, concat(substr(sequence, 1, i), translate(si, 'ACGU', 'UGCA'), substr(sequence, i + 2, j - i - 1),
    translate(sj, 'ACGU', 'UGCA'), substr(sequence, j + 2)) as variant from hp h join canon using (unit_id)""")
def v2(spark, sf):
    a = annotate(V.hairpins(spark, sf), keep_pairs=True)
    return M.mutate_pairs(a, F.col("canonical"))


@query("v3_alphabet_check", f"""with {V.PANEL}, a as (select distinct model, case when model = '5-LOW' then 'A>U C>C G>G T>A U>A' else 'A>C C>A G>U T>C U>C' end as alphabet_text from panel)
  select alphabet_text, case when alphabet_text like 'A>U%' then 'C,G' else '' end as fixed, count(*) as n_runs, alphabet_text not like 'A>U%' as ok from a group by all""")
def v3(spark, sf):
    odd = {"A": "U", "U": "A", "C": "C", "G": "G", "T": "A"}
    r = V.panel(spark, sf).select("model", F.when(F.col("model") == "5-LOW", substitution(odd)).otherwise(substitution(TRANSVERSION)).alias("alphabet"))
    return M.alphabet_check(r)


_SYN = V.dix("4", "'syn'", "unit_id", "copy", "least(coalesce(mate, pos), pos)")


@query("v4_synthesize", f"""{V.WITH_PAIRS}, c as (select *, unnest(range(5)) as copy from hp), p as (select *, unnest(range(length(structure))) as pos from c),
  m as (select p.*, coalesce(a.j, b.i) as mate from p left join pairs a on a.unit_id = p.unit_id and a.i = pos left join pairs b on b.unit_id = p.unit_id and b.j = pos),
  s as (select unit_id, copy, pos, structure, case when mate is null then substr('AUGC', {_SYN} + 1, 1)
    when mate > pos then substr('AUGC', list_extract([2, 1, 4, 3], {_SYN} + 1), 1) else substr('AUGC', {_SYN} + 1, 1) end as sym from m)
  select concat(unit_id, '_syn', copy) as variant_id, unit_id as origin, copy, string_agg(sym, '' order by pos) as sequence, structure from s group by all""")
def v4(spark, sf):
    return M.synthesize(V.hairpins(spark, sf))


@query("v5_repeat_variants", f"""with {V.HP}, r as (select unit_id, substr(sequence, 1, 10) as l, substr(sequence, 60) as rt, unnest([2, 5, 9]) as n_repeat from hp), i as (select *, unnest(['CAG', 'CAA']) as insert from r)
  select unit_id, insert, n_repeat, concat(l, repeat(insert, n_repeat), rt) as sequence from i""")
def v5(spark, sf):
    f = V.hairpins(spark, sf).select(U, F.substring("sequence", 1, 10).alias("left"), F.expr("substr(sequence, 60)").alias("right"))
    return M.repeat_variants(f, "CAG", [2, 5, 9], "CAA")


@query("v6_find_repeat", f"""with {V.HP}, s as (select unit_id, concat(substr(sequence, 1, 20), repeat('CAG', cast(unit_id % 9 as int)), substr(sequence, 21), repeat('CAG', cast(unit_id % 7 as int))) as s from hp),
  m as (select unit_id, s, unnest(regexp_extract_all(s, '(?:CAG){{5,}}')) as m from s), b as (select unit_id, s, arg_max(m, length(m)) as m from m group by all)
  select unit_id, strpos(s, m) - 1 as start, strpos(s, m) - 1 + length(m) as stop, length(m) // 3 as copies from b""")
def v6(spark, sf):
    s = F.concat(F.substring("sequence", 1, 20), F.repeat(F.lit("CAG"), (F.col(U) % 9).cast("int")), F.expr("substr(sequence, 21)"),
                 F.repeat(F.lit("CAG"), (F.col(U) % 7).cast("int")))
    return M.find_repeat(V.hairpins(spark, sf).withColumn("sequence", s), "CAG")


@query("v7_replicates", f"""with {V.MSA} select concat('set', member // 5, '_seq', member % 5) as unit_id, concat('set', member // 5) as origin, member % 5 as n, aligned as sequence from msa""")
def v7(spark, sf):
    m = V.msa(spark, sf)
    sets = m.groupBy(F.concat(F.lit("set"), F.floor(F.col("member") / 5).cast("string")).alias("name")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("member", "aligned"))), lambda e: F.struct(
            e["member"].cast("string").alias("accession"), e["aligned"].alias("sequence"), F.lit("").alias("dot_bracket"))).alias("sequences"))
    return panel.replicates(sets).select("unit_id", "origin", "n", "sequence")


@query("b_partner_array", f"""{V.WITH_BK}, p as (select *, unnest(range(length(structure))) as pos from bk)
  select p.unit_id, pos, coalesce(a.j, b.i) as mate from p left join pairs a on a.unit_id = p.unit_id and a.i = pos left join pairs b on b.unit_id = p.unit_id and b.j = pos""")
def partner(spark, sf):
    u = V.brackets(spark, sf)
    return u.select(U, F.posexplode(B.partner_array(B.match_pairs(F.col("structure")), F.length("structure"))).alias("pos", "mate"))
