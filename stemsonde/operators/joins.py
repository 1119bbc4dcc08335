"""Joins and set comparisons between runs, variants and sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import brackets as B
from ..functions.binding import explode_rows
from ..functions.marks import field_marks
from ..functions.vectors import cosine_distance

SALTS = 32


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Column,
                salts: int = SALTS, how: str = "inner") -> DataFrame:
    """Join of a side with hot keys to one with few rows per key.

    The hot side is spread over ``salts`` sub-keys by a hash of ``spread``; the
    other side, one bounded row per key, is repeated once per salt.  Partitioning
    on (key, salt) also keeps a later aggregate from reusing the skewed layout.
    """
    left = big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def compare_variants(emb: DataFrame, reference: str = "wt",
                     keys: Sequence[str] = ("unit_id", "layer", "row")) -> DataFrame:
    """Distance of every variant row from the reference row at the same place.

    A place missing on either side gives no row.
    """
    ref = emb.filter(F.col("variant") == reference).select(*keys, F.col("vec").alias("__ref"))
    return (emb.filter(F.col("variant") != reference).join(ref, list(keys))
            .withColumn("delta", cosine_distance(F.col("__ref"), F.col("vec"))).drop("__ref", "vec"))


def compare_positions(ref: DataFrame, mut: DataFrame, ref_rows: DataFrame, mut_rows: DataFrame) -> DataFrame:
    """The same by position where one row can hold several positions.

    ``*_rows`` map (unit_id[, variant], pos) to row.
    """
    a = ref_rows.join(ref.withColumnRenamed("vec", "__ref"), ["unit_id", "row"]).drop("row")
    b = mut_rows.join(mut, ["unit_id", "variant", "row"]).drop("row")
    return (b.join(a.select("unit_id", "layer", "pos", "__ref"), ["unit_id", "layer", "pos"])
            .withColumn("delta", cosine_distance(F.col("__ref"), F.col("vec"))).drop("__ref", "vec"))


def paired_units(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str,
                 names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Values of two arms on the units both have."""
    return a.select(*keys, F.col(value).alias(names[0])).join(
        b.select(*keys, F.col(value).alias(names[1])), list(keys))


def common_units(arms: DataFrame, n_arms: int, unit: str = "unit_id", arm: str = "arm") -> DataFrame:
    """Rows of the units present in every arm."""
    full = arms.groupBy(unit).agg(F.countDistinct(arm).alias("__n")).filter(F.col("__n") == n_arms).select(unit)
    return arms.join(full, unit, "left_semi")


def join_common(scores: DataFrame, covariate: DataFrame, by: Sequence[str], unit: str = "unit_id",
                min_n: int = 5) -> DataFrame:
    """Score and covariate on common units, groups below ``min_n`` dropped."""
    both = scores.join(covariate, unit)
    enough = both.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_n).select(*by)
    return both.join(enough, list(by), "left_semi")


def merge_runs(old: DataFrame, new: DataFrame, keys: Sequence[str], forced: Column, value: Sequence[str]) -> DataFrame:
    """Precedence merge: the new run where present, else the old one.

    ``forced`` marks keys that may only come from the new run; a forced key
    without a new row is a conflict and carries no value.  ``source`` and the
    row digest make the manifest.
    """
    o = old.select(*keys, F.struct(*value).alias("__o"))
    n = new.select(*keys, F.struct(*value).alias("__n"))
    m = o.join(n, list(keys), "full_outer")
    source = (F.when(F.col("__n").isNotNull(), "new")
              .when(forced, "conflict").otherwise("old"))
    m = m.withColumn("source", source)
    got = F.when(F.col("source") == "new", F.col("__n")).when(F.col("source") == "old", F.col("__o"))
    m = m.withColumn("__v", got)
    digest = F.sha2(field_marks(*[F.col(f"__v.{v}") for v in value]), 256)
    return m.select(*keys, "source", *[F.col(f"__v.{v}").alias(v) for v in value],
                    F.when(F.col("__v").isNotNull(), digest).alias("sha256"))


def patch_run(base: DataFrame, patch: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base rows with the allowed keys replaced by the patch."""
    keys = list(keys)
    take = patch.join(allowed, keys, "left_semi")
    return base.join(take.select(*keys).distinct(), keys, "left_anti").unionByName(take)


def patch_problems(patch: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that bar a patch: allowed but missing from it, or in it but not allowed."""
    keys = list(keys)
    missing = allowed.join(patch, keys, "left_anti").select(*keys, F.lit("missing").alias("problem"))
    extra = patch.join(allowed, keys, "left_anti").select(*keys, F.lit("unexpected").alias("problem"))
    return missing.unionByName(extra)


def diff_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Fields that differ between two runs, and rows only one of them has.

    Rows are joined once and compared field by field inside the row.
    """
    keys = list(keys)
    x = a.select(*keys, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("__a"))
    y = b.select(*keys, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("__b"))
    both = x.join(y, keys, "full_outer").filter(~F.col("__a").eqNullSafe(F.col("__b")))
    one_sided = F.array(F.struct(F.lit("(row)").alias("field"),
                                 F.when(F.col("__a").isNotNull(), "present").alias("before"),
                                 F.when(F.col("__b").isNotNull(), "present").alias("after")))
    changes = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__a.{f}").alias("before"),
                                          F.col(f"__b.{f}").alias("after")) for f in fields]),
                       lambda c: ~c["before"].eqNullSafe(c["after"]))
    either = F.col("__a").isNull() | F.col("__b").isNull()
    return both.select(*keys, F.inline(F.when(either, one_sided).otherwise(changes)))


def drift(a: DataFrame, b: DataFrame, by: Sequence[str], unit: str = "unit_id", score: str = "ps",
          best: str = "best_layer") -> DataFrame:
    """Largest per-layer move, best-layer moves and units compared, per run.

    Both sides are long (…, unit, layer, score, best_layer).
    """
    keys = [*by, unit, "layer"]
    m = a.select(*keys, F.col(score).alias("__x"), F.col(best).alias("__bx")).join(
        b.select(*keys, F.col(score).alias("__y"), F.col(best).alias("__by")), keys)
    per_unit = m.groupBy(*by, unit).agg(
        F.max(F.abs(F.col("__x") - F.col("__y"))).alias("w"),
        F.max((~F.col("__bx").eqNullSafe(F.col("__by"))).cast("int")).alias("moved"))
    return per_unit.groupBy(*by).agg(F.max("w").alias("worst"), F.sum("moved").alias("layer_moves"),
                                     F.count(F.lit(1)).alias("compared"))


def leaves(col: Column, kind: T.DataType, path: Column | str = "", ignored: frozenset[str] = frozenset()) -> Column:
    """array<struct<path, value>> of every leaf of a nested column, by its schema."""
    path = F.lit(path) if isinstance(path, str) else path
    dotted = lambda name: F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))
    if isinstance(kind, T.StructType):
        parts = [leaves(col[f.name], f.dataType, dotted(F.lit(f.name)), ignored)
                 for f in kind.fields if f.name not in ignored]
        return F.concat(*parts)
    if isinstance(kind, T.ArrayType):
        inner = F.transform(col, lambda x, n: leaves(
            x, kind.elementType, F.concat(path, F.lit("["), n.cast("string"), F.lit("]")), ignored))
        return F.coalesce(F.flatten(inner), F.array().cast(LEAVES))
    if isinstance(kind, T.MapType):
        inner = F.transform(F.map_entries(col), lambda e: leaves(
            e["value"], kind.valueType, dotted(e["key"]), ignored))
        return F.coalesce(F.flatten(inner), F.array().cast(LEAVES))
    return F.array(F.struct(path.alias("path"), col.cast("string").alias("value")))


LEAVES = "array<struct<path:string,value:string>>"


def leaf_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], doc: str, ignored: frozenset[str] = frozenset()) -> DataFrame:
    """Leaves of two nested documents that differ or exist on one side: path, left, right, kind."""
    def flat(df, out):
        found = leaves(F.col(doc), df.schema[doc].dataType, "", ignored)
        return df.select(*keys, F.inline(found)).withColumnRenamed("value", out).withColumn(f"has_{out}", F.lit(True))

    m = flat(a, "left").join(flat(b, "right"), [*keys, "path"], "full_outer")
    kind = (F.when(F.col("has_right").isNull(), "only_left").when(F.col("has_left").isNull(), "only_right")
            .when(~F.col("left").eqNullSafe(F.col("right")), "differs"))
    return m.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(*keys, "path", "left", "right", "kind")


# ---------------------------------------------------------------- sequences

def kmers(text: Column, k: int) -> Column:
    """Distinct k-mers of a string; empty when it is shorter than k."""
    last = F.length(text) - k
    return F.when(last >= 0, F.array_distinct(F.transform(
        F.sequence(F.lit(0), last), lambda p: F.substring(text, p + 1, F.lit(k))))) \
        .otherwise(F.array().cast("array<string>"))


def shared_kmers(queries: DataFrame, targets: DataFrame, family: str = "family", k: int = 8) -> DataFrame:
    """query, family, __rep, shared, n_query: distinct k-mers that a query shares with each
    distinct target text of its family; __rep is the first member with that text."""
    q = queries.select("query", family, kmers(F.col("sequence"), k).alias("__k"))
    sizes = queries.select("query", family, F.size(kmers(F.col("sequence"), k)).alias("n_query"))
    qk = explode_rows(q, "__k", "kmer").select("query", family, "kmer")
    texts = targets.groupBy(family, "sequence").agg(F.min("member").alias("__rep"))
    tk = explode_rows(texts.select(family, "__rep", kmers(F.col("sequence"), k).alias("__k")), "__k", "kmer").select(family, "__rep", "kmer")
    shared = qk.join(tk, [family, "kmer"]).groupBy("query", family, "__rep").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(sizes, ["query", family])


def kmer_containment(queries: DataFrame, targets: DataFrame, family: str = "family", k: int = 8) -> DataFrame:
    """Share of a query's distinct k-mers found in each target of its family.

    queries(query, family, sequence), targets(member, family, sequence).  Equal
    target texts are indexed once and fanned out again afterwards.
    """
    texts = targets.groupBy(family, "sequence").agg(F.min("member").alias("__rep"))
    copies = targets.join(texts, [family, "sequence"]).select(family, "member", "__rep")
    return (shared_kmers(queries, targets, family, k).join(copies, [family, "__rep"])
            .select("query", family, "member", "shared", (F.col("shared") / F.col("n_query")).alias("containment")))


def best_target(queries: DataFrame, targets: DataFrame, family: str = "family", k: int = 8) -> DataFrame:
    """The target with the largest containment per query, first member name on ties.

    Taken among distinct texts, before equal targets fan out: one row per query leaves
    the aggregate, never a row for each pair of query and member.
    """
    best = shared_kmers(queries, targets, family, k).groupBy("query", family).agg(
        F.max("n_query").alias("n"), F.max("shared").alias("shared"), F.min_by("__rep", F.struct(-F.col("shared"), "__rep")).alias("member"))
    return best.select("query", family, (F.col("shared") / F.col("n")).alias("containment"), "member")


def match_members(queries: DataFrame, targets: DataFrame, family: str = "family", k: int = 8) -> DataFrame:
    """Members equal to or containing each query: member, offset, kind.

    A member containing the query holds the query's first k-mer, so candidates
    come from an equi join on (family, k-mer).  Queries shorter than k are
    matched on every substring of their own length.
    """
    size = F.least(F.length("sequence"), F.lit(k))
    q = queries.filter(F.length("sequence") > 0).select(
        "query", family, F.col("sequence").alias("__q"), size.alias("__len"),
        F.expr(f"left(sequence, least(length(sequence), {k}))").alias("kmer"))
    # one value: the query lengths in use, at most k of them
    lengths = q.agg(F.collect_set("__len")).scalar()
    sized = targets.withColumn("__lens", lengths).select(
        "member", family, "sequence", F.explode(F.filter("__lens", lambda n: n <= F.length("sequence"))).alias("__len"))
    t = sized.select(
        "member", family, F.col("sequence").alias("__t"), "__len",
        F.explode(F.array_distinct(F.expr(
            "transform(sequence(1, length(sequence) - __len + 1), p -> substring(sequence, p, __len))"))).alias("kmer"))
    hit = q.join(t, [family, "kmer", "__len"]).filter(F.expr("contains(__t, __q)"))
    return hit.select("query", family, "member", (F.expr("locate(__q, __t)") - 1).alias("offset"),
                      F.when(F.col("__q") == F.col("__t"), "exact").otherwise("substring").alias("kind"))


def hamming_identity(a: Column, b: Column) -> Column:
    """Share of equal symbols; null for unequal or zero lengths."""
    same = F.size(F.filter(F.arrays_zip(B.symbols(a).alias("x"), B.symbols(b).alias("y")),
                           lambda c: c["x"] == c["y"]))
    return F.when((F.length(a) == F.length(b)) & (F.length(a) > 0), same / F.length(a))
