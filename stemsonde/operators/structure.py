"""Structure of annotated units: labels, pairs, stems, eligibility.

``annotate`` derives everything a unit's own text determines inside its row;
the relational forms explode those arrays and add no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import brackets as B
from ..functions.alphabet import CANONICAL, WOBBLE
from ..functions.binding import inline_rows, let
from .ranking import exact_quantiles

MIN_CANONICAL = 15
MIN_ELIGIBLE = 5


def spread(units: DataFrame, unit: str | Column = "unit_id") -> DataFrame:
    """Units hashed by name before a stage that makes thousands of cells per unit.

    The rows that move are thin, and every later per-unit aggregate finds its
    input already placed.
    """
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(n, unit)


def annotate(units: DataFrame, keep_pairs: bool = False) -> DataFrame:
    """Adds ``pairs``, ``canonical``, ``stems`` and ``eligible`` arrays to each unit.

    Stems are formed only where opens and closes agree in number; symbols are
    compared as stored.
    """
    a = units.withColumn("__a", B.anatomy(F.col("sequence"), F.col("structure")))
    parts = ["pairs", "canonical", "stems", "eligible"] if keep_pairs else ["stems", "eligible"]
    return a.select(*units.columns, *[F.col(f"__a.{p}").alias(p) for p in parts])


def match_brackets(units: DataFrame, unit: str = "unit_id", all_kinds: bool = False) -> DataFrame:
    """pairs(unit, i, j); with ``all_kinds`` every bracket kind and letter level."""
    expr = B.match_all_kinds if all_kinds else B.match_pairs
    return inline_rows(units, [unit], expr(F.col("structure")), "i")


def positions(units: DataFrame, unit: str = "unit_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """positions(unit, pos, sym, bracket, label), up to the shorter of the two strings.

    A label follows the bracket symbol, so an unmatched bracket is still paired.
    """
    n = F.least(F.length("sequence"), F.length("structure"))
    chars = B.symbols(F.expr("substring(sequence, 1, least(length(sequence), length(structure)))"))
    marks = B.symbols(F.col("structure"))
    rows = units.filter(n > 0).select(
        unit, *carry, marks.alias("__m"), F.posexplode(chars).alias("pos", "sym"))
    mark = F.get(F.col("__m"), F.col("pos"))
    return rows.select(unit, *carry, "pos", "sym", mark.alias("bracket"),
                       label_of(mark).alias("label"))


def label_of(bracket: Column) -> Column:
    return F.when(bracket.isin("(", ")"), "paired").otherwise("unpaired")


def canonical_pairs(units: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Canonical pairs with their type."""
    pairs = B.match_pairs(F.col("structure"))
    chars = B.symbols(F.col("sequence"))
    return (inline_rows(units, [unit, chars.alias("__c")], pairs, "i")
            .withColumn("pair_type", F.concat(F.get("__c", F.col("i")), F.get("__c", F.col("j"))))
            .filter(F.col("pair_type").isin(*CANONICAL)).drop("__c"))


def stems(units: DataFrame, unit: str = "unit_id") -> DataFrame:
    """stems(unit, stem_id, k, len, i, j), one row per pair."""
    return inline_rows(annotate(units), [unit], "stems", "i")


def eligible_pairs(units: DataFrame, unit: str = "unit_id") -> DataFrame:
    """eligible(unit, stem_id, k, len, i, j, j_prev, j_next, pair_type, deep)."""
    return inline_rows(annotate(units), [unit], "eligible", "i") \
        .withColumn("deep", B.is_deep(F.col("k"), F.col("len")))


def contacts(pairs: DataFrame) -> DataFrame:
    """Symmetric edges of a pair table."""
    swapped = pairs.withColumns({"i": F.col("j"), "j": F.col("i")})
    return pairs.unionByName(swapped)


def structure_counts(units: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Per unit: n_pairs, n_canonical, n_stems (of three or more), n_eligible, n_deep."""
    a = annotate(units, keep_pairs=True)
    starts = F.filter("stems", lambda s: (s["k"] == 0) & (s["len"] >= 3))
    deep = F.filter("eligible", lambda e: B.is_deep(e["k"], e["len"]))
    return a.select(
        unit, *[c for c in ("sequence", "structure") if c in units.columns],
        F.size("pairs").alias("n_pairs"), F.size("canonical").alias("n_canonical"),
        F.size(starts).alias("n_stems"), F.size("eligible").alias("n_eligible"),
        F.size(deep).alias("n_deep"), F.col("eligible"))


def qualify_unit(units: DataFrame, unit: str = "unit_id", quarantine: Column | None = None,
                 min_canonical: int = MIN_CANONICAL, min_eligible: int = MIN_ELIGIBLE) -> DataFrame:
    """Partner-specificity eligibility: status and the first failing reason."""
    c = structure_counts(units, unit)
    n, m = F.length("sequence"), F.length("structure")
    reason = (F.when(n != m, F.format_string("length mismatch (%d vs %d)", n, m))
              .when(F.col("n_canonical") < min_canonical,
                    F.format_string(f"< {min_canonical} canonical pairs (%d found)", F.col("n_canonical")))
              .when(F.col("n_eligible") < min_eligible,
                    F.format_string(f"< {min_eligible} eligible pairs (%d found)", F.col("n_eligible"))))
    return c.select(
        unit, "n_pairs", "n_canonical", "n_stems", "n_eligible", "n_deep",
        F.when(reason.isNull(), "scored").otherwise("skipped").alias("status"),
        reason.alias("reason"),
        (quarantine if quarantine is not None else F.lit(False)).alias("quarantined"))


def validate_unit(units: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Ratio-scoring validity with the first failing reason, from the two strings alone."""
    n = F.least(F.length("sequence"), F.length("structure"))
    opens, closes = B.count_of(F.col("structure"), "("), B.count_of(F.col("structure"), ")")
    head = F.expr("substring(structure, 1, least(length(sequence), length(structure)))")
    paired = B.count_of(head, "(") + B.count_of(head, ")")
    unpaired = n - paired
    reason = (F.when(n < 20, F.lit("too short"))
              .when(opens != closes, F.format_string("unbalanced (%d vs %d)", opens, closes))
              .when((paired < 5) | (unpaired < 5),
                    F.format_string("insufficient positions (paired=%d, unpaired=%d)", paired, unpaired)))
    return units.select(unit, n.alias("n"), paired.alias("n_paired"), unpaired.alias("n_unpaired"),
                        reason.isNull().alias("valid"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def strict_balance(units: DataFrame, unit: str = "unit_id", min_pairs: int = 3,
                   min_len: int = 20, max_len: int = 512) -> DataFrame:
    """Strict balance within a length range."""
    n = F.length("structure")
    return units.select(unit, B.is_balanced(F.col("structure"), min_pairs).alias("balanced"),
                        n.between(min_len, max_len).alias("length_ok"))


def context2(pos: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Adds ``ctx2``: previous symbol and symbol, ``N`` before the first."""
    prev = F.lag("sym", 1, "N").over(W.partitionBy(unit).orderBy("pos"))
    return pos.withColumn("ctx2", F.concat(prev, F.col("sym")))


def context2_of(sequence: Column) -> Column:
    """The same context as an array inside the row."""
    return let(B.symbols(sequence), lambda chars: F.transform(
        chars, lambda c, t: F.concat(F.coalesce(F.get(chars, t - 1), F.lit("N")), c)))


def noncanonical_of(sequence: Column, structure: Column) -> Column:
    """struct(n_usable, n_bad, fraction) over the pairs inside the sequence."""
    n = F.length(sequence)
    usable = F.filter(B.match_pairs(structure), lambda p: (p["i"] < n) & (p["j"] < n))
    bad = lambda chars, pairs: F.filter(pairs, lambda p: ~F.concat(
        F.get(chars, p["i"]), F.get(chars, p["j"])).isin(*CANONICAL, *WOBBLE))
    share = lambda total, odd: F.struct(total.alias("n_usable"), odd.alias("n_bad"),
                                        F.when(total > 0, odd / total).otherwise(0.0).alias("fraction"))
    return let(B.symbols(F.translate(F.upper(sequence), "T", "U")), lambda chars: let(
        usable, lambda u: let(F.size(bad(chars, u)), lambda odd: share(F.size(u), odd))))


def noncanonical_fraction(units: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Share of usable pairs that are neither canonical nor wobble; 0 without pairs."""
    return units.select(unit, noncanonical_of(F.col("sequence"), F.col("structure")).alias("__s")).select(unit, "__s.*")


def gc_by_label(units: DataFrame, unit: str = "unit_id") -> DataFrame:
    """GC% at paired and unpaired positions; both null where either side is empty."""
    sym, mark = B.symbols(F.upper("sequence")), B.symbols(F.col("structure"))
    cells = F.arrays_zip(sym.alias("s"), mark.alias("m"))
    stem = F.filter(cells, lambda c: c["m"].isin("(", ")"))
    loop = F.filter(cells, lambda c: c["m"] == ".")
    share = lambda a: F.size(F.filter(a, lambda c: c["s"].isin("G", "C"))) / F.size(a) * 100.0
    both = (F.size("stem") > 0) & (F.size("loop") > 0)
    return (units.select(unit, stem.alias("stem"), loop.alias("loop"))
            .select(unit, F.when(both, share(F.col("stem"))).alias("gc_paired"),
                    F.when(both, share(F.col("loop"))).alias("gc_unpaired")))


def gc_summary(per_unit: DataFrame) -> DataFrame:
    """Panel means, enrichment, and how many units are richer in the paired part."""
    p, u = F.col("gc_paired"), F.col("gc_unpaired")
    return per_unit.filter(p.isNotNull()).agg(
        F.avg(p).alias("mean_paired"), F.avg(u).alias("mean_unpaired"),
        (F.avg(p) - F.avg(u)).alias("enrichment"),
        F.count_if(p > u).alias("n_above"), F.count(F.lit(1)).alias("n_units"))


def slice_structure(units: DataFrame, start: Column, length: Column, unit: str = "unit_id") -> DataFrame:
    """The structure over a window; brackets whose partner lies outside become dots.

    Null where the window runs past the end.
    """
    cut = F.col("structure").substr(start + 1, length)
    keep = lambda mates: F.transform(B.symbols(cut), lambda c, t: F.when(
        F.get(mates, start + t).between(start, start + length - 1), c)
        .when(c.isin("(", ")"), ".").otherwise(c))
    inside = let(B.partner_array(B.match_pairs(F.col("structure")), F.length("structure")), keep)
    return units.select(unit, F.when(F.length(cut) == length, F.array_join(inside, "")).alias("sliced"))


# ------------------------------------------------------------------ token spans

def position_rows(spans: DataFrame, by: list[str]) -> DataFrame:
    """position -> row of half-open spans."""
    return (spans.filter(F.col("end") > F.col("start"))
            .select(*by, "row", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos")))


def _tiles(spans: Column) -> Column:
    """Whether spans sorted by their start follow one another without a hole or an overlap."""
    return F.forall(F.sequence(F.lit(1), F.size(spans)), lambda k: (k >= F.size(spans)) | (F.get(spans, k)["start"] == F.get(spans, k - 1)["end"]))


def span_coverage(spans: DataFrame, lengths: DataFrame, by: list[str]) -> DataFrame:
    """Units whose spans do not cover every position once: covered, expected, ok.  Empty spans do not count."""
    own = F.sort_array(F.collect_list(F.struct("start", "end")))
    width = spans.filter(F.col("end") > F.col("start")).groupBy(*by).agg(
        F.sum(F.col("end") - F.col("start")).alias("covered"), F.min("start").alias("first"), F.max("end").alias("last"), _tiles(own).alias("once"))
    return (lengths.join(width, by, "left")
            .withColumn("ok", F.coalesce(F.col("once") & (F.col("covered") == F.col("n")) & (F.col("first") == 0)
                                         & (F.col("last") == F.col("n")), F.col("n") == 0)).drop("once"))


def validate_spans(rows: DataFrame, by: list[str], alphabet: str = "[ACGTUN]+",
                   unknown: str | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """Content rows of each tokenised unit: one contiguous block that tiles the text.

    ``lengths`` gives n, the symbols of each unit, which the block has to cover from 0 to n; without it the text is
    taken to end with the block.

    ``rows`` carries row, piece, start, end.  A row is content when its piece is
    spelled in the alphabet or is the unknown marker; specials are the rest.
    """
    content = F.col("piece").rlike(f"^{alphabet}$")
    if unknown is not None:
        content = content | (F.col("piece") == unknown)
    w = W.partitionBy(*by).orderBy("row")
    inner = rows.filter(content)
    steps = (inner.withColumn("gap", F.col("row") - F.lag("row").over(w))
             .withColumn("joint", F.col("start") == F.lag("end").over(w)))
    got = steps.groupBy(*by).agg(
        F.min("row").alias("first_row"), (F.max("row") + 1).alias("stop_row"),
        F.coalesce(F.max("gap") == 1, F.lit(True)).alias("contiguous"),
        F.coalesce(F.bool_and("joint"), F.lit(True)).alias("tiles"), F.min("start").alias("__first"), F.max("end").alias("__last"),
        F.sum(F.col("end") - F.col("start")).alias("covered"))
    missing = rows.select(*by).distinct().join(got, by, "left")
    if lengths is not None:
        missing = missing.join(lengths.select(*by, F.col("n").alias("__n")), by, "left")
    whole = (F.col("__first") == 0) & (F.lit(True) if lengths is None else (F.col("__last") == F.col("__n")) & (F.col("covered") == F.col("__n")))
    return missing.withColumn("status", F.when(F.col("first_row").isNull(), "no content")
                              .when(~F.col("contiguous"), "specials inside content")
                              .when(~F.col("tiles"), "spans do not tile")
                              .when(~F.coalesce(whole, F.lit(False)), "does not cover").otherwise("ok")).drop("__first", "__last", "__n")


def token_contacts(edges: DataFrame, pos_row: DataFrame, by: list[str]) -> DataFrame:
    """Rows in contact: some pair of positions they cover is an edge.

    Position-to-row lookup turns the two range joins into equi joins.
    """
    left = pos_row.select(*by, F.col("pos").alias("i"), F.col("row").alias("r"))
    right = pos_row.select(*by, F.col("pos").alias("j"), F.col("row").alias("c"))
    return edges.join(left, [*by, "i"]).join(right, [*by, "j"]).select(*by, "r", "c").distinct()


def score_by_pair_type(pairs: DataFrame, by: list[str], score: str = "ps") -> DataFrame:
    """Mean score of the G-C and of the A-U pairs."""
    return pairs.groupBy(*by).agg(*pair_type_means(score))


def pair_type_means(score: str = "ps") -> list[Column]:
    gc = F.col("pair_type").isin("G-C", "C-G")
    au = F.col("pair_type").isin("A-U", "U-A")
    return [F.avg(F.when(gc, F.col(score))).alias("ps_gc"), F.avg(F.when(au, F.col(score))).alias("ps_au")]


def panel_description(units: DataFrame, kind: Column) -> tuple[DataFrame, DataFrame]:
    """Length quartiles and range, and class counts by size then name."""
    n = units.withColumn("__len", F.length("sequence"))
    q = exact_quantiles(n, [], "__len", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    span = n.agg(F.count(F.lit(1)).alias("n_units"), F.min("__len").alias("min_len"),
                 F.max("__len").alias("max_len"))
    counts = units.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("n"), "kind")
    one = lambda df: df.withColumn("__one", F.lit(1))
    return one(span).join(one(q), "__one").drop("__one"), counts
