"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps; they are written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents:

1. language: texts whose language is rejected go (no letter, or below the calibrated level). The model is trained on the
   labelled rows of the stage's own input.
2. near_duplicates: of each group of near-duplicates one row with the smallest doc_id stays; if several rows of the group
   have it, the first in order of the other columns. Texts of one doc_id that are nobody's copies all stay, as do rows
   with a null doc_id and texts without words.
3. decontamination: texts that hold a verified test item of ``benchmark`` go.
4. secrets: every span found is masked in text, and n_chars is the new length; all rows stay.
5. packing: one row for each piece of a document, with its bin.

Null or empty texts go in stage 1. Columns beyond those of documents are not carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemsonde.llm import decontam, langid, minhash, packing, secrets
from stemsonde.llm.common import WORD, read_table, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _documents(docs)
    return langid.predicted(docs, langid.train(docs), COLUMNS).where("not rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _documents(docs)
    kept = minhash.near_duplicates(docs).where("kept and cluster is not null").select("doc_id", "text_hash", "cluster").distinct()
    rows = docs.withColumn("text_hash", F.xxhash64("text"))
    alone = rows.where(F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    named = rows.join(kept, ["doc_id", "text_hash"])
    order = [F.col(c).asc_nulls_first() for c in COLUMNS[1:]]
    first = named.withColumn("_place", F.row_number().over(Window.partitionBy("doc_id", "cluster").orderBy(*order))).where("_place = 1")
    return first.select(*COLUMNS).unionByName(alone.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(_documents(docs), read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _documents(docs)
    return secrets.masked(docs).withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(_documents(docs))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secret_scan), ("packing", pack)]

#: Trained models and best-fit packing have no SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents table, each result written and read again."""
    docs, top = read_table(spark, sf_dir, "documents"), shared_dir(spark)
    for name, stage in STAGES:
        path = f"{top}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
