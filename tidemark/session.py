"""Session settings every job relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings the jobs assume; static settings stay the cluster's.

    All clocks are UTC.  Adaptive execution sizes shuffle partitions, splits
    skewed join partitions and turns small measured join sides into broadcasts,
    so no job carries a broadcast hint on a side whose size it cannot prove.
    """
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    and Spark runs in local mode (tests, laptops) is a scratch folder created.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(frame: DataFrame) -> DataFrame:
    """Write a table that several branches of a job read, and read it back.

    It lands in the shared folder, so losing an executor costs nothing already
    computed, and as Parquet it keeps column pruning and statistics for every
    later reader.
    """
    spark = frame.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    frame.write.mode("errorifexists").parquet(path)
    table = spark.read.schema(frame.schema).parquet(path)
    table.cut_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table of ``cut`` that no later step of the job reads any more."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.cut_path)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
