"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "stemsonde", master: str | None = None,
                  shuffle_partitions: int | None = None, shared: str | None = None) -> SparkSession:
    """A session with adaptive execution on; cluster settings are left to the cluster.

    ``shared`` sets ``spark.checkpoint.dir``, the folder that driver and executors share.
    """
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               .config("spark.ui.enabled", "false"))
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", os.environ.get("STEMSONDE_DRIVER_MEM", "12g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder named by ``spark.checkpoint.dir``.

    Only a local session with the setting unset gets a temporary folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            shared = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(shared)
    return df.checkpoint()
