"""Resumable scoring keyed by unit and run stamp.

Finished units are a table partitioned by stamp hash.  Work left to do is an
anti join against the partition of the current stamp, so a changed stamp hides
every earlier result without deleting it first, and an executor lost half way
through costs only its own units.  The same step runs as a micro-batch when
units arrive as a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage


def stamp_hash(stamp: Column) -> Column:
    """Digest of a MAP<STRING,STRING> stamp, independent of key order; a null field is not an absent one."""
    entries = F.array_sort(F.transform(F.map_entries(stamp), lambda e: F.coalesce(F.concat(e["key"], F.lit("="), e["value"]), e["key"])))
    return F.sha2(F.concat_ws("\n", entries), 256)


def literal_stamp(stamp: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(str(x)) for kv in sorted(stamp.items()) for x in kv])


def pending(units: DataFrame, done: DataFrame, stamp: Column, unit: str = "unit_id") -> DataFrame:
    """Units without a finished row under this stamp."""
    here = units.withColumn("stamp_hash", stamp_hash(stamp))
    return here.join(done.select(unit, "stamp_hash").distinct(), [unit, "stamp_hash"], "left_anti")


def differing_fields(stored: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """Stamp fields that differ or exist on one side only, sorted into one string per key."""
    long = lambda df, out: df.select(*by, F.explode("stamp").alias("field", out))
    both = long(stored, "a").join(long(current, "b"), [*by, "field"], "full_outer") \
        .filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.groupBy(*by).agg(F.concat_ws(", ", F.array_sort(F.collect_list("field"))).alias("differs_in"))


def append_done(scored: DataFrame, path: str, stamp: Column) -> None:
    """Append finished units under their stamp."""
    (scored.withColumn("stamp_hash", stamp_hash(stamp)).write.mode("append")
     .partitionBy("stamp_hash").parquet(path))


def read_done(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Finished units of any stamp; empty when nothing was written yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], f"{schema}, stamp_hash STRING")
    return spark.read.schema(f"{schema}, stamp_hash STRING").parquet(path)


def resume(units: DataFrame, score: Callable[[DataFrame], DataFrame], path: str,
           stamp: dict[str, str], schema: str, unit: str = "unit_id") -> DataFrame:
    """Score what is left, then return every finished unit of this stamp."""
    spark, column = units.sparkSession, literal_stamp(stamp)
    left = pending(units, read_done(spark, path, schema), column, unit).drop("stamp_hash")
    append_done(score(left), path, column)
    return read_done(spark, path, schema).filter(F.col("stamp_hash") == stamp_hash(column)).drop("stamp_hash")


def resume_stream(units: DataFrame, score: Callable[[DataFrame], DataFrame], path: str,
                  stamp: dict[str, str], schema: str, checkpoint: str, unit: str = "unit_id"):
    """The same step over a streaming source of units, one micro-batch at a time.

    A batch replayed after a failure finds its units finished and appends nothing.
    """
    def step(batch: DataFrame, _epoch: int) -> None:
        column = literal_stamp(stamp)
        left = pending(batch, read_done(batch.sparkSession, path, schema), column, unit).drop("stamp_hash")
        append_done(score(left), path, column)

    return (units.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def overwrite_if_stale(fresh: DataFrame, path: str, stamp: Column, by: tuple[str, ...] = ("model", "arm"), unit: str = "unit_id") -> None:
    """Replace the run directories present in ``fresh`` whose stored stamp is another one.

    A run stored under the same stamp keeps its rows and gets the units that it lacks (whole rows are compared where
    there is no unit column).  Runs that ``fresh`` does not name are not touched.
    """
    keys, fresh = list(by), fresh.withColumn("stamp_hash", stamp_hash(stamp))
    schema = fresh.schema
    stored = read_done(fresh.sparkSession, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != "stamp_hash"))
    # written down first: the folder cannot be read while it is replaced
    runs = cut_lineage(stored.select(*keys, "stamp_hash").distinct())
    own = [unit] if unit in fresh.columns else [c for c in fresh.columns if c not in (*keys, "stamp_hash")]
    current = fresh.join(runs, [*keys, "stamp_hash"], "left_semi")
    more = cut_lineage(current.join(stored, [current[c].eqNullSafe(stored[c]) for c in (*keys, *own)], "left_anti").select(*fresh.columns))
    stale = fresh.join(runs, [*keys, "stamp_hash"], "left_anti").select(*fresh.columns)
    stale.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    more.write.mode("append").partitionBy(*by).parquet(path)


def stale_runs(stored: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """Stored runs whose stamp is not the current one."""
    old = stored.select(*by, stamp_hash(F.col("stamp")).alias("old_hash"))
    new = current.select(*by, stamp_hash(F.col("stamp")).alias("new_hash"))
    return old.join(new, by).filter(F.col("old_hash") != F.col("new_hash"))
