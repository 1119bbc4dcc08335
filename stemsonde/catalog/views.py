"""Domain views over the driver tables, in Spark and as SQL text.

The driver tables hold no sequences, so units, alignments, embeddings and run
results are derived from their keys by expressions both engines evaluate alike.
Every view covers its whole table and grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEX = "0123456789abcdef"
LAYERS = 3
REPS = 1000
BOOT = 1000

ARM_SYMBOLS = "ACGUACGUACGUACGU"
BRACKETS = "((((((....))))))"
STRUCTURE = "((((((((((.....))))))))))" * 3


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ------------------------------------------------------------------ units

def _hairpin(n: int) -> tuple[str, str]:
    arm = f"translate(substr(md5(concat('h{n}|', cast(doc_id as STR))), 1, 10), '{HEX}', '{ARM_SYMBOLS}')"
    at = f"ascii(substr(md5(concat('p{n}|', cast(doc_id as STR))), 1, 1)) % 10"
    return arm, at


def _hairpin_sql(dialect: str) -> str:
    arms = [_hairpin(n) for n in (1, 2, 3)]
    inner = ", ".join(f"{a} as a{n}, {p} as p{n}" for n, (a, p) in enumerate(arms, 1))
    rc = [f"reverse(translate(a{n}, 'ACGU', 'UGCA'))" for n in (1, 2, 3)]
    hp = [f"concat(a{n}, 'AACAA', substr({rc[n - 1]}, 1, cast(p{n} as int)), 'A', substr({rc[n - 1]}, cast(p{n} as int) + 2, 10))"
          for n in (1, 2, 3)]
    return (f"select doc_id as unit_id, lang, concat({', '.join(hp)}) as sequence, '{STRUCTURE}' as structure "
            f"from (select doc_id, lang, {inner} from documents)").replace("STR", dialect)


def hairpins(spark: SparkSession, sf: str) -> DataFrame:
    """units(unit_id, lang, sequence, structure): three hairpins per document."""
    return spark.sql(_hairpin_sql("string").replace("from documents", "from {docs}"), docs=table(spark, sf, "documents"))


def brackets(spark: SparkSession, sf: str) -> DataFrame:
    """units(unit_id, sequence, structure) with 64 unbalanced bracket symbols."""
    return spark.sql(_brackets_sql("string").replace("from documents", "from {docs}"), docs=table(spark, sf, "documents"))


def _brackets_sql(dialect: str) -> str:
    h = lambda tag: f"md5(concat('{tag}|', cast(doc_id as STR)))"
    return (f"select doc_id as unit_id, "
            f"translate(concat({h('u')}, {h('v')}), '{HEX}', '{ARM_SYMBOLS}') as sequence, "
            f"translate(concat({h('s')}, {h('t')}), '{HEX}', '{BRACKETS}') as structure "
            f"from documents").replace("STR", dialect)


HP = f"hp as ({_hairpin_sql('varchar')})"
BK = f"bk as ({_brackets_sql('varchar')})"

# Bracket matching by a recursive walk with a list as the stack.
PAIRS = """walk as (
  select unit_id, structure, 0 as k, []::int[] as st, -1 as i, -1 as j from {src}
  union all
  select unit_id, structure, k + 1,
    case substr(structure, k + 1, 1) when '(' then list_append(st, k) when ')' then st[:len(st) - 1] else st end,
    case when substr(structure, k + 1, 1) = ')' and len(st) > 0 then st[len(st)] else -1 end, k
  from walk where k < length(structure)),
pairs as (select unit_id, i, j from walk where i >= 0)"""

# Canonical pairs, stems by gaps and islands along i + j, eligible pairs.
STEMS = """canon as (
  select p.unit_id, p.i, p.j, substr(s.sequence, p.i + 1, 1) as si, substr(s.sequence, p.j + 1, 1) as sj
  from pairs p join {src} s using (unit_id)
  where concat(substr(s.sequence, p.i + 1, 1), substr(s.sequence, p.j + 1, 1)) in ('AU', 'UA', 'CG', 'GC')
    and length(replace(s.structure, '(', '')) = length(replace(s.structure, ')', ''))),
island as (select *, i - row_number() over (partition by unit_id, i + j order by i) as g from canon),
stem0 as (select *, min(i) over (partition by unit_id, i + j, g) as s0, count(*) over (partition by unit_id, i + j, g) as len
  from island),
stems as (select unit_id, dense_rank() over (partition by unit_id order by s0) - 1 as stem_id, i - s0 as k, len, i, j, si, sj
  from stem0),
elig as (select unit_id, stem_id, k, len, i, j, j + 1 as j_prev, j - 1 as j_next, concat(si, '-', sj) as pair_type, sj,
    k >= 2 and k <= len - 3 as deep
  from stems where len >= 3 and k >= 1 and k <= len - 2)"""

WITH_PAIRS = f"with recursive {HP}, {PAIRS.format(src='hp')}"
WITH_ELIG = f"{WITH_PAIRS}, {STEMS.format(src='hp')}"
WITH_BK = f"with recursive {BK}, {PAIRS.format(src='bk')}"
WITH_BK_ELIG = f"{WITH_BK}, {STEMS.format(src='bk')}"


def u01(*parts: str) -> str:
    """SQL of the uniform draw in [0, 1)."""
    key = ", ".join(f"cast({p} as varchar)" for p in parts)
    return f"cast(concat('0x', substr(md5(concat_ws('|', {key})), 1, 8)) as bigint) / 4294967296::double"


def dix(n: str, *parts: str) -> str:
    """SQL of the index draw in [0, n)."""
    key = ", ".join(f"cast({p} as varchar)" for p in parts)
    return f"cast(concat('0x', substr(md5(concat_ws('|', {key})), 1, 8)) as bigint) % ({n})"


def hexd(*parts: str) -> str:
    key = ", ".join(f"cast({p} as varchar)" for p in parts)
    return f"md5(concat_ws('|', {key}))"


PRIME = 2147483647


def seeds(*parts: str) -> str:
    """SQL of the three numbers of an item, as columns b0, b1, b2."""
    return ", ".join(f"cast(concat('0x', substr({hexd(*parts)}, {at}, 8)) as bigint) % {PRIME} as b{k}" for k, at in enumerate((1, 9, 17)))


#: draw of an item (b0, b1, b2) in replicate ``rep``
RDRAW = f"(((b2 * rep + b1) % {PRIME}) * rep + b0) % {PRIME}"


# delta(unit, layer, i, k) of the hairpin units
DELTA = u01("unit_id", "layer", "i", "k")

# Deltas at the positions specificity reads, per eligible pair and layer.
PS = f"""lay as (select unnest(range({LAYERS})) as layer),
need as (select e.*, l.layer from elig e, lay l),
pr as (select *, {u01('unit_id', 'layer', 'i', 'j')} as dp, {u01('unit_id', 'layer', 'i', 'j_prev')} as d1,
    {u01('unit_id', 'layer', 'i', 'j_next')} as d2 from need),
ps as (select *, dp - greatest(d1, d2) as ps, dp > greatest(d1, d2) as pmax, d1 > d2 as nl from pr),
psl as (select unit_id, layer, avg(ps) as ps, avg(case when deep then pmax::int end) as precision,
    count(*) as n_pairs, count(*) filter (where deep) as n_deep from ps group by all),
best as (select unit_id, layer as best_layer, ps as best_ps from (
    select *, row_number() over (partition by unit_id order by round(ps, 12) desc, layer) as r from psl) where r = 1)"""
WITH_PS = f"{WITH_ELIG}, {PS}"


# ------------------------------------------------------------------ strata

def strata(spark: SparkSession, sf: str) -> DataFrame:
    """dist(unit_id, pos, stratum, label, layer, value) from events, one layer per event."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("unit_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("stratum"),
        F.when(F.col("event_id") % 3 == 0, "paired").otherwise("unpaired").alias("label"),
        (F.get_json_object("props", "$.k").cast("int") % 4).alias("layer"), "value")


ST = """st as (select user_id as unit_id, event_id as pos, event_type as stratum,
  case when event_id % 3 = 0 then 'paired' else 'unpaired' end as label,
  cast(json_extract_string(props, '$.k') as int) % 4 as layer, value from events)"""

RATIO = """rt as (select unit_id, layer, avg(value) filter (where label = 'paired') as mp, avg(value) filter (where label = 'unpaired') as mu,
    count(*) filter (where label = 'paired') as np, count(*) filter (where label = 'unpaired') as nu from {src} where value is not null group by all),
ratios as (select unit_id, layer, mp as mean_paired, mu as mean_unpaired, np as n_paired, nu as n_unpaired,
    case when mu > 1e-10 then mp / mu else 0.0 end as ratio from rt where np >= 3 and nu >= 3),
rbest as (select unit_id, layer, ratio from (select *, row_number() over (partition by unit_id order by round(ratio, 12) desc, layer) as r
    from ratios) where r = 1)"""


# ------------------------------------------------------------------ alignments

MSA_COLS = 64


def _msa_sql(dialect: str) -> str:
    # columns 0..31 random, 32..51 the complement of 31..12 so some paired columns covary
    left = f"translate(md5(concat('m|', cast(doc_id as STR))), '{HEX}', 'ACGUACGUACGUAC--')"
    swap = f"md5(concat('x|', cast(doc_id as STR)))"
    return (f"select lang as family, doc_id as member, concat(lft, substr(reverse(translate(lft, 'ACGU', 'UGCA')), 1, 20), "
            f"substr(translate(sw, '{HEX}', '{ARM_SYMBOLS}'), 1, 12)) as aligned from (select lang, doc_id, {left} as lft, {swap} as sw from documents)").replace("STR", dialect)


def msa(spark: SparkSession, sf: str) -> DataFrame:
    """members(family, member, aligned): one 64-column row per document, family = lang."""
    return spark.sql(_msa_sql("string").replace("from documents", "from {docs}"), docs=table(spark, sf, "documents"))


MSA = f"msa as ({_msa_sql('varchar')})"
# consensus of every family: columns 0..15 pair with 63..48, and <> with {} further in
CONSENSUS = "<<<<<<((((((" + "...." + "{{[[" + "." * 24 + "]]}}" + "...." + "))))))>>>>>>"
assert len(CONSENSUS) == MSA_COLS


def consensus_units(spark: SparkSession, sf: str) -> DataFrame:
    """The families and their consensus, as units."""
    return msa(spark, sf).select("family").distinct().withColumn("structure", F.lit(CONSENSUS))


# ------------------------------------------------------------------ embeddings

def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """emb(unit_id, layer, vec_id, vec): unit = label, layer = vec_id % 3."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("label").alias("unit_id"), (F.col("vec_id") % 3).cast("int").alias("layer"),
                    "vec_id", F.col("embedding").alias("vec"))


def emb_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a dense 0-based row number per (unit, layer)."""
    from ..operators.ranking import dense_index
    return dense_index(embeddings(spark, sf), ["unit_id", "layer"], "vec_id", "row")


EMB = """emb as (select label as unit_id, cast(vec_id % 3 as int) as layer, vec_id, embedding as vec,
  row_number() over (partition by label, vec_id % 3 order by vec_id) - 1 as row from embeddings)"""


def emb_variants(spark: SparkSession, sf: str) -> DataFrame:
    """wt rows, a reversed copy as variant 'mut' and the row itself again as 'repeat'.

    The mutated position of a unit's variant is the row's own id modulo 7 = 0.
    """
    e = embeddings(spark, sf).withColumnRenamed("vec_id", "row")
    kinds = F.array(*[F.lit(k) for k in ("wt", "mut", "repeat")])
    v = e.withColumn("variant", F.explode(kinds))
    vec = F.when(F.col("variant") == "mut", F.reverse("vec")).otherwise(F.col("vec"))
    mut = F.when(F.col("row") % 7 == 0, F.col("row")).otherwise(F.col("row") - F.col("row") % 7)
    return v.withColumns({"vec": vec, "mut_pos": mut})


# ------------------------------------------------------------------ runs

def _runs_sql(dialect: str) -> str:
    return """select o_orderkey as key, o_orderpriority as model, o_custkey as unit_id,
      cast(round(o_totalprice * 100) as bigint) as cents, o_totalprice / 1.00003e5 as score,
      o_orderstatus as flag from orders"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """runs(key, model, unit_id, cents, score, flag) from orders; key is unique."""
    return spark.sql(_runs_sql("string").replace("from orders", "from {o}"), o=table(spark, sf, "orders"))


RUNS = f"runs as ({_runs_sql('varchar')})"


def _panel_sql(src: str) -> str:
    return f"""select model, unit_id, best_ps, h3_n, h3_hits, h3_hits / cast(h3_n as double) as h3_fraction,
      chance_fraction, null_primary, null_conservative, gate_pass, quarantined,
      case when skip then 'skipped' else 'scored' end as status,
      case when skip then 'too few pairs' end as reason,
      best_layer, ratio, noop, nearer, best_ps > null_primary as exceeds_primary,
      best_ps > null_conservative as exceeds_conservative, not no_null as null_available
    from (select model, unit_id,
      sum(cents) / cast(count(*) as double) / 2.0000003e7 - 1.0e0 as best_ps,
      count(*) as h3_n, sum(case when flag = 'F' then 1 else 0 end) as h3_hits,
      sum(case when flag = 'P' then 1 else 0 end) / cast(count(*) as double) as chance_fraction,
      min(cents) / 2.5000013e7 - 5.0e-1 as null_primary, max(cents) / 2.5000013e7 - 9.0e-1 as null_conservative,
      max(case when flag <> 'P' then 1 else 0 end) = 1 as gate_pass,
      unit_id % 17 = 0 as quarantined, unit_id % 13 = 5 as skip, unit_id % 11 = 3 as no_null,
      cast(min(key) % 4 as int) as best_layer, max(cents) / 2.0000003e7 as ratio,
      min(cents) / 1.000000007e9 as noop, sum(case when flag = 'O' then 1 else 0 end) / cast(count(*) as double) as nearer
      from {src} group by model, unit_id) as raw"""


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Stored specificity results, one row per (model, unit), from orders."""
    return spark.sql(_panel_sql("{r}"), r=runs(spark, sf))


PANEL = f"{RUNS}, panel as ({_panel_sql('runs')})"
PANEL_LAYERS = 4


def panel_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Per-layer values (model, unit, layer, ps, precision, chance) of the panel's units."""
    from ..functions.draws import draw_unit
    p = panel(spark, sf).select("model", "unit_id").withColumn(
        "layer", F.explode(F.sequence(F.lit(0), F.lit(PANEL_LAYERS - 1))))
    u = lambda tag: draw_unit(tag, F.col("model"), F.col("unit_id"), F.col("layer"))
    return p.withColumns({"ps": u("ps") - 0.5 + F.col("layer") * 0.001, "precision": u("pr"), "chance": u("ch") / 2.0})


PLAY = f"""play as (select model, unit_id, layer, {u01("'ps'", 'model', 'unit_id', 'layer')} - 0.5 + layer * 0.001 as ps,
  {u01("'pr'", 'model', 'unit_id', 'layer')} as precision, {u01("'ch'", 'model', 'unit_id', 'layer')} / 2.0 as chance
  from panel, (select unnest(range({PANEL_LAYERS})) as layer))"""


