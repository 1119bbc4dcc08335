"""Variant generation: one row per variant, built from the unit's own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import brackets as B
from ..functions.alphabet import CANONICAL, COMPLEMENT, mapped_symbol
from ..functions.binding import inline_rows
from ..functions.draws import draw_index
from .structure import spread


def mutate(units: DataFrame, alphabet: dict[str, str] = COMPLEMENT, at: Column | None = None,
           unit: str = "unit_id") -> DataFrame:
    """variants(unit, mut_pos, sym, new_sym, variant): one substitution each.

    ``at`` is an array of positions, every position when not given.  Unmapped and
    unchanged symbols give no variant.
    """
    where = at if at is not None else F.sequence(F.lit(0), F.length("sequence") - 1)
    rows = units.filter(F.length("sequence") > 0).select(
        unit, "sequence", F.explode(F.array_distinct(where)).alias("mut_pos"))
    sym = F.substring(F.col("sequence"), F.col("mut_pos") + 1, F.lit(1))
    rows = rows.withColumn("sym", sym).withColumn("new_sym", mapped_symbol(F.col("sym"), alphabet))
    return (rows.filter(F.col("new_sym").isNotNull() & (F.col("new_sym") != F.col("sym")))
            .withColumn("variant", F.overlay("sequence", "new_sym", F.col("mut_pos") + 1, F.lit(1)))
            .drop("sequence"))


def mutate_pairs(units: DataFrame, pairs: Column, alphabet: dict[str, str] = COMPLEMENT,
                 unit: str = "unit_id") -> DataFrame:
    """variants(unit, i, j, variant): both ends of every pair substituted."""
    rows = inline_rows(units, [unit, "sequence"], pairs, "i")
    at = lambda p: F.substring(F.col("sequence"), F.col(p) + 1, F.lit(1))
    new_i, new_j = mapped_symbol(at("i"), alphabet), mapped_symbol(at("j"), alphabet)
    once = F.overlay("sequence", new_i, F.col("i") + 1, F.lit(1))
    both = F.overlay(once, new_j, F.col("j") + 1, F.lit(1))
    return rows.filter(new_i.isNotNull() & new_j.isNotNull()).select(unit, "i", "j", both.alias("variant"))


def alphabet_check(runs: DataFrame, alphabet: str = "alphabet", run: str = "model") -> DataFrame:
    """One row per distinct alphabet: its unchanged symbols and how many runs used it.

    More than one row means the runs mix substitutions.
    """
    entries = F.array_sort(F.map_entries(alphabet))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(">"), e["value"])), " ")
    fixed = F.array_join(F.transform(F.filter(entries, lambda e: e["key"] == e["value"]),
                                     lambda e: e["key"]), ",")
    return (runs.withColumns({"alphabet_text": text, "fixed": fixed})
            .groupBy("alphabet_text", "fixed").agg(F.countDistinct(run).alias("n_runs"))
            .withColumn("ok", F.col("fixed") == ""))


def partners_same(runs: DataFrame, alphabet: str = "alphabet") -> Column:
    """Whether any substitute still pairs with its source's partner."""
    return F.exists(F.map_entries(alphabet), lambda e: F.concat(
        e["value"], F.translate(e["key"], "ACGUT", "UGCAA")).isin(*CANONICAL))


# Order in which the draws index pairs and symbols.
PAIR_ORDER = ("AU", "UA", "GC", "CG")
SYMBOL_ORDER = "AUGC"


def synthesize(units: DataFrame, n: int = 5, seed: str = "syn", unit: str = "unit_id") -> DataFrame:
    """``n`` sequences per unit on its structure: a uniform canonical pair at every
    pair, a uniform symbol elsewhere.

    The second letter of the drawn pair goes to the opening position, the first
    to the closing one.
    """
    partner = B.partner_array(B.match_pairs(F.col("structure")), F.length("structure"))
    rows = (spread(units.filter(F.length("structure") > 0), unit).withColumn("__mate", partner)
            .select(unit, "structure", "__mate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("copy")))
    pairs = F.array(*[F.lit(p) for p in PAIR_ORDER])

    def at(mate, pos):
        pick = draw_index(4, seed, F.col(unit), F.col("copy"), F.coalesce(F.least(mate, pos), pos))
        pair = F.get(pairs, pick.cast("int"))
        return (F.when(mate.isNull(), F.substring(F.lit(SYMBOL_ORDER), (pick + 1).cast("int"), F.lit(1)))
                .when(mate > pos, F.substring(pair, 2, 1)).otherwise(F.substring(pair, 1, 1)))

    return rows.select(F.concat(F.col(unit).cast("string"), F.lit("_syn"), F.col("copy").cast("string")).alias("variant_id"),
                       F.col(unit).alias("origin"), "copy",
                       F.array_join(F.transform("__mate", at), "").alias("sequence"), "structure")


def repeat_variants(flanks: DataFrame, repeat_unit: str, counts: list[int], control: str | None = None,
                    unit: str = "unit_id") -> DataFrame:
    """left + unit*r + right for every r, and the same with a control insert.

    ``flanks`` carries left and right.
    """
    inserts = [repeat_unit] + ([control] if control else [])
    if control and len(control) != len(repeat_unit):
        raise ValueError("the control insert must have the length of the repeat unit")
    r = F.explode(F.array(*[F.lit(int(c)) for c in counts])).alias("n_repeat")
    rows = flanks.select(unit, "left", "right", r)
    rows = rows.withColumn("insert", F.explode(F.array(*[F.lit(x) for x in inserts])))
    return rows.select(unit, "insert", "n_repeat", F.concat(
        "left", F.repeat("insert", F.col("n_repeat")), "right").alias("sequence"))


def find_repeat(units: DataFrame, repeat_unit: str, minimum: int = 5, unit: str = "unit_id") -> DataFrame:
    """First longest run of ``repeat_unit`` of at least ``minimum`` copies: start, end, copies."""
    runs = F.regexp_extract_all("sequence", F.lit(f"((?:{repeat_unit}){{{minimum},}})"), 1)
    longest = F.repeat(F.lit(repeat_unit),
                       (F.array_max(F.transform(runs, lambda m: F.length(m))) / len(repeat_unit)).cast("int"))
    got = units.withColumn("__m", longest)
    start = F.expr("locate(__m, sequence)") - 1
    return got.filter(F.col("__m").isNotNull()).select(
        unit, start.alias("start"), (start + F.length("__m")).alias("stop"),
        (F.length("__m") / len(repeat_unit)).cast("int").alias("copies"))
