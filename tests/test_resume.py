"""Resume by unit, stamp guard, sinks, streaming."""

from conftest import rows
from pyspark.sql import functions as F

from stemsonde.sources.shared import shared_path
from stemsonde.streaming import resume as R

SCHEMA = "unit_id STRING, score DOUBLE"


def units(spark, names="abc"):
    return spark.createDataFrame([(n,) for n in names], "unit_id string")


def score(df):
    return df.select("unit_id", (F.ascii("unit_id") * 1.0).alias("score"))


def test_resume_equals_one_pass(spark):
    path, stamp = shared_path(spark, "done"), {"commit": "1", "library": "2.0"}
    seen = []

    def counted(df):
        seen.append(df.count())
        return score(df)

    R.resume(units(spark, "a"), counted, path, stamp, SCHEMA)
    got = R.resume(units(spark), counted, path, stamp, SCHEMA)
    assert seen == [1, 2]
    assert rows(got) == rows(score(units(spark)))


def test_changed_stamp_discards(spark):
    path, old, new = shared_path(spark, "done"), {"commit": "1", "library": "2.0"}, {"commit": "1", "library": "2.1"}
    R.resume(units(spark), score, path, old, SCHEMA)
    assert R.pending(units(spark), R.read_done(spark, path, SCHEMA), R.literal_stamp(new)).count() == 3
    stamps = lambda s: spark.range(1).select(F.lit("m").alias("model"), R.literal_stamp(s).alias("stamp"))
    assert rows(R.differing_fields(stamps(old), stamps(new), ["model"])) == [("m", "library")]
    assert R.stale_runs(stamps(old), stamps(new), ["model"]).count() == 1


def test_stream_equals_batch(spark):
    src, path, stamp = shared_path(spark, "src"), shared_path(spark, "done"), {"commit": "1"}
    units(spark, "ab").write.parquet(src)
    for extra in (None, "bcd"):
        if extra:
            units(spark, extra).write.mode("append").parquet(src)
        stream = spark.readStream.schema("unit_id string").parquet(src)
        q = R.resume_stream(stream, score, path, stamp, SCHEMA, path + "-ckpt")
        q.awaitTermination(120)
    got = R.read_done(spark, path, SCHEMA).select("unit_id", "score")
    # b arrives twice and is scored once
    assert rows(got) == rows(score(units(spark, "abcd")))


def test_overwrite_only_stale_directories(spark):
    path = shared_path(spark, "runs")
    df = spark.createDataFrame([("m", "x", 1), ("m", "y", 2)], "model string, arm string, v int")
    R.overwrite_if_stale(df, path, R.literal_stamp({"c": "1"}))
    R.overwrite_if_stale(df.filter("arm = 'x'").withColumn("v", F.lit(9)), path, R.literal_stamp({"c": "2"}))
    assert rows(spark.read.parquet(path), "arm", "v") == [("x", 9), ("y", 2)]


def test_same_stamp_keeps_finished_units(spark):
    path = shared_path(spark, "runs")
    df = spark.createDataFrame([("m", "x", "a", 1), ("m", "x", "b", 2), ("m", "y", "a", 3)], "model string, arm string, unit_id string, v int")
    stamp = R.literal_stamp({"c": "1"})
    R.overwrite_if_stale(df, path, stamp)
    R.overwrite_if_stale(df.filter("arm = 'x' and unit_id = 'b'").withColumn("v", F.lit(9)), path, stamp)
    assert rows(spark.read.parquet(path), "arm", "unit_id", "v") == [("x", "a", 1), ("x", "b", 2), ("y", "a", 3)]
    R.overwrite_if_stale(spark.createDataFrame([("m", "x", "c", 4)], df.schema), path, stamp)
    assert rows(spark.read.parquet(path), "arm", "unit_id", "v") == [("x", "a", 1), ("x", "b", 2), ("x", "c", 4), ("y", "a", 3)]


def test_a_null_field_is_not_an_absent_one(spark):
    marks = spark.sql("select map('a', '1', 'b', null) as x, map('a', '1') as y").select(R.stamp_hash(F.col("x")).alias("x"), R.stamp_hash(F.col("y")).alias("y")).first()
    assert marks.x != marks.y
