"""Unit panels, replicate sets, FASTA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT_SCHEMA = """name STRING, sequence STRING, dot_bracket STRING, source STRING, rfam_id STRING,
 length INT, seed_member STRING, seed_members_available INT,
 excluded STRUCT<reason: STRING, rule: STRING, logged: STRING>"""

REPLICATE_SCHEMA = """name STRING, rfam_id STRING, original_sequence STRING,
 original_dot_bracket STRING, n_available INT, n_selected INT,
 sequences ARRAY<STRUCT<accession: STRING, sequence: STRING, dot_bracket: STRING, length: INT>>"""


def read_units(spark: SparkSession, path: str, include_withdrawn: bool = False,
               names: list[str] | None = None, multiline: bool = True) -> DataFrame:
    """units(unit_id, sequence, structure, ...), one JSON record per unit."""
    raw = spark.read.schema(UNIT_SCHEMA).json(path, multiLine=multiline)
    return as_units(raw, include_withdrawn, names)


def as_units(raw: DataFrame, include_withdrawn: bool = False,
             names: list[str] | None = None) -> DataFrame:
    """The unit vocabulary over raw records, withdrawn ones dropped unless asked for."""
    if not include_withdrawn:
        raw = raw.filter(F.col("excluded").isNull())
    if names is not None:
        raw = raw.filter(F.col("name").isin(names))
    return raw.withColumnsRenamed({"name": "unit_id", "dot_bracket": "structure"})


def withdrawn(units: DataFrame) -> DataFrame:
    """Withdrawn units with their exclusion record."""
    return units.filter(F.col("excluded").isNotNull()).select("unit_id", "excluded.*")


def read_replicate_sets(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Replicate sets as stored: one row per unit with its array of members."""
    return spark.read.schema(REPLICATE_SCHEMA).json(path, multiLine=multiline)


def replicates(sets: DataFrame, unit: str = "name", members: str = "sequences") -> DataFrame:
    """One row per member, named ``<unit>_seq<n>``, keeping the origin as a column."""
    rows = sets.select(F.col(unit).alias("origin"), F.posexplode(members).alias("n", "m"))
    return rows.select(F.concat("origin", F.lit("_seq"), F.col("n").cast("string")).alias("unit_id"),
                       "origin", "n", F.col("m.accession").alias("accession"),
                       F.col("m.sequence").alias("sequence"), F.col("m.dot_bracket").alias("structure"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """fasta(file, header, sequence): upper case, T to U, wrapped lines joined.

    A record is one row from the start, so a file of any size is read in splits. Files begin with a record.
    """
    rec = spark.read.text(path, lineSep="\n>").select(F.input_file_name().alias("file"), F.regexp_replace("value", r"^\s*>", "").alias("r"))
    return _fasta_records(rec.filter(F.trim(F.regexp_replace("r", r"\s", "")) != ""), "file")


def parse_fasta(text: DataFrame, file: str = "file", value: str = "value") -> DataFrame:
    """Records of whole FASTA texts."""
    return _fasta_records(text.select(file, F.explode(F.slice(F.split(value, r"(?:^|\n)>"), 2, 1 << 30)).alias("r")), file)


def _fasta_records(rec: DataFrame, file: str) -> DataFrame:
    body = F.regexp_replace(F.col("r"), r"^[^\n]*\n?", "")
    return rec.select(file, F.rtrim(F.regexp_replace(F.substring_index("r", "\n", 1), "\r$", "")).alias("header"),
                      F.translate(F.upper(F.regexp_replace(body, r"\s", "")), "T", "U").alias("sequence"))


def accession(source: Column) -> Column:
    """Member named in a source string's ``seed alignment member (...)``, else null."""
    found = F.regexp_extract(source, r"seed alignment member \((.*).$", 1)
    return F.when(source.contains("seed alignment member ("), found)


# Units read as cis-regulatory elements by name.
CIS_REGULATORY = (
    "Corona_5UTR", "Corona_s2m", "CrPV_IRES", "Hepatitis_C_IRES_III", "IRE_stem_loop",
    "IRES_HCV_domainII", "SECIS_element", "T_box_leader", "Histone_3prime")

# Class labels of the other name patterns, first match wins.
CLASS_PATTERNS = (
    ("startswith", "tRNA_", "tRNAs"), ("contains", "rRNA", "rRNAs"),
    ("endswith", "_ribozyme", "ribozymes"), ("endswith", "_riboswitch", "riboswitches"),
    ("contains", "snRNA", "snRNAs"), ("startswith", "mir_", "miRNA precursors"),
    ("startswith", "CRISPR", "CRISPR repeats"))


def classify(name: Column, patterns=CLASS_PATTERNS, listed=CIS_REGULATORY,
             listed_label: str = "cis-regulatory elements", other: str = "other ncRNAs") -> Column:
    """Class of a unit by the first name pattern that matches."""
    out = None
    for test, text, label in patterns:
        hit = getattr(name, test)(text)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.when(name.isin(*listed), listed_label).otherwise(other)


def split_ambiguous(members: DataFrame, safe: str = "ACGTUN", sequence: str = "sequence") -> tuple[DataFrame, DataFrame]:
    """(kept, excluded): members spelled in safe symbols, and the rest with their odd characters."""
    odd = F.array_sort(F.array_distinct(F.filter(
        F.split(F.upper(sequence), ""), lambda c: ~c.rlike(f"^[{safe}]$"))))
    tagged = members.withColumn("characters", odd)
    return (tagged.filter(F.size("characters") == 0).drop("characters"),
            tagged.filter(F.size("characters") > 0))
