"""Multiple alignments: ingestion, projection of the consensus, member accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import brackets as B
from ..functions.alphabet import fold_brackets

# Gap characters of the three uses.
GAPS_PROJECT, GAPS_COLUMNS, GAPS_STRICT = ".-", ".-~", ".-_"


def read_alignments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(members, consensus) of Stockholm text files; blocks concatenate by name.

    Files are read line by line, in splits; a line's place is its split and its order within it.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), place.alias("line"), F.col("value").alias("t"))
    return alignment_tables(lines)


def parse_alignments(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members(file, family, member, aligned) and consensus(file, family, family_name, consensus)."""
    lines = text.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "t"))
    return alignment_tables(lines)


def alignment_tables(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from lines(file, line, t), for files read line by line."""
    t = F.rtrim(F.col("t"))
    word = F.split(F.trim("t"), r"\s+")
    is_row = (~t.startswith("#")) & (~t.startswith("//")) & (F.trim("t") != "") & (F.size(word) == 2)
    joined = lambda value: F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("line", value.alias("s")))), lambda e: e["s"]), "")
    head = lines.filter(t.startswith("#")).groupBy("file").agg(
        F.max(F.when(t.startswith("#=GF AC "), F.get(word, F.lit(2)))).alias("family"),
        F.max(F.when(t.startswith("#=GF ID "), F.trim(F.regexp_extract(t, r"^#=GF ID\s+(.*)$", 1))))
        .alias("family_name"),
        joined(F.when(t.startswith("#=GC SS_cons"), F.regexp_extract(t, r"^#=GC SS_cons\s+(.*)$", 1)))
        .alias("consensus"))
    rows = lines.filter(is_row).select("file", "line", F.get(word, F.lit(0)).alias("member"),
                                       F.get(word, F.lit(1)).alias("s"))
    members = rows.groupBy("file", "member").agg(
        F.min("line").alias("ord"), joined(F.col("s")).alias("aligned"))
    return members.join(head.select("file", "family"), "file"), head


def gap_pattern(gaps: str) -> str:
    return "[" + "".join("\\" + c for c in gaps) + "]"


def projected(aligned: Column, consensus: Column, gaps: str = GAPS_PROJECT,
              drop_ambiguous: bool = False) -> Column:
    """array of (sym, mark): the member's own columns with the folded consensus."""
    zipped = F.zip_with(B.symbols(aligned), B.symbols(fold_brackets(consensus)),
                        lambda s, m: F.struct(F.translate(F.upper(s), "T", "U").alias("sym"),
                                              m.alias("mark"), s.alias("raw")))
    kept = F.filter(zipped, lambda c: ~c["raw"].rlike(gap_pattern(gaps)))
    if drop_ambiguous:
        kept = F.filter(kept, lambda c: c["sym"].isin("A", "C", "G", "U"))
    return kept


def project_structure(members: DataFrame, gaps: str = GAPS_PROJECT, drop_ambiguous: bool = False,
                      min_len: int = 0) -> DataFrame:
    """Adds sequence and structure of every member of (aligned, consensus) rows.

    Plain projection: structure is null unless lengths agree, opens equal closes
    and the symbols are A, C, G, U.  With ``drop_ambiguous`` ambiguous symbols go
    with their brackets, the balance is the strict one, and short members are null.
    """
    same = F.length("aligned") == F.length("consensus")
    m = members.withColumn("__p", F.when(same, projected(
        F.col("aligned"), F.col("consensus"), gaps, drop_ambiguous)))
    m = m.withColumns({"sequence": F.array_join(F.transform("__p", lambda c: c["sym"]), ""),
                       "__ss": F.array_join(F.transform("__p", lambda c: c["mark"]), "")}).drop("__p")
    if drop_ambiguous:
        ok = B.is_balanced(F.col("__ss"), 0) & (F.length("sequence") >= min_len)
    else:
        ok = B.equal_counts(F.col("__ss")) & F.col("sequence").rlike("^[ACGU]*$") \
            & (F.length("sequence") >= min_len)
    return m.withColumn("structure", F.when(ok, F.col("__ss"))).drop("__ss")


def extract_members(members: DataFrame, min_length: int = 30) -> DataFrame:
    """Projected members with a status: valid, unbalanced, non_rna, too_short."""
    p = project_structure(members)
    status = (F.when(F.col("sequence").isNull(), "non_rna")
              .when(F.col("structure").isNull() & ~F.col("sequence").rlike("^[ACGU]*$"), "non_rna")
              .when(F.col("structure").isNull(), "unbalanced")
              .when(F.length("sequence") < min_length, "too_short").otherwise("valid"))
    return p.withColumn("status", status)


# The statuses a member can have.
STATUSES = ("valid", "unbalanced", "non_rna", "too_short")


def member_accounting(extracted: DataFrame, family: str = "family") -> DataFrame:
    """Members per status and in total, one row per family."""
    return extracted.groupBy(family).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def cells(members: DataFrame, family: str, member: str, gaps: str = GAPS_COLUMNS) -> DataFrame:
    """cells(family, member, col, sym): one row per alignment cell, gaps as ``-``."""
    clean = F.regexp_replace(F.translate(F.upper("aligned"), "T", "U"), gap_pattern(gaps), "-")
    return members.select(family, member, F.posexplode(B.symbols(clean)).alias("col", "sym"))


def best_member(members: DataFrame, family: str = "family") -> DataFrame:
    """Most canonical pairs, then longest, then first in the file."""
    n = members.withColumn("n_canonical", F.size(B.canonical(
        B.match_pairs(F.col("structure")), B.symbols(F.col("sequence")))))
    order = F.struct(F.col("n_canonical"), F.length("sequence").alias("len"), (-F.col("ord")).alias("o"))
    return n.groupBy(family).agg(F.max_by(
        F.struct("member", "sequence", "structure", "n_canonical"), order).alias("b")).select(family, "b.*")


def mismatch_share(a: Column, b: Column) -> Column:
    """Share of differing symbols over the common prefix length; 0 when it is empty."""
    n = F.least(F.length(a), F.length(b))
    cells_ = F.arrays_zip(B.symbols(F.left(a, n)).alias("x"), B.symbols(F.left(b, n)).alias("y"))
    diff = F.size(F.filter(cells_, lambda c: c["x"] != c["y"]))
    return F.when(n > 0, diff / n).otherwise(0.0)


def diverse_members(members: DataFrame, family: str = "family", n: int = 5,
                    reference: str = "reference", split: int = 32) -> DataFrame:
    """The ``n`` members most unlike the family's reference sequence, file order on ties."""
    scored = members.withColumn("distance", mismatch_share(F.col("sequence"), F.col(reference)))
    order = [F.desc("distance"), F.col("ord")]
    local = scored.withColumn("__s", F.pmod(F.col("ord"), F.lit(split))).withColumn(
        "__r", F.row_number().over(W.partitionBy(family, "__s").orderBy(*order))).filter(F.col("__r") <= n)
    return (local.withColumn("rank", F.row_number().over(W.partitionBy(family).orderBy(*order)))
            .filter(F.col("rank") <= n).drop("__s", "__r"))
