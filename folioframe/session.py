"""Session construction and the few settings the operators rely on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Needed for right results: UTC dates, last value wins when maps are merged.
SEMANTIC_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# Plan quality only; a cluster's own values win when already set.
PLAN_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the semantic settings to a session somebody else created."""
    for key, value in SEMANTIC_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str | int = "*", app: str = "folioframe", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.local.dir", os.environ.get("SPARK_LOCAL_DIRS") or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    )
    for key, value in {**SEMANTIC_SETTINGS, **PLAN_SETTINGS}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for streaming state and cut lineages: `spark.checkpoint.dir`.

    Only a local session (tests) may leave it unset and gets a folder of its own;
    on a cluster executors and driver must name one that all of them see.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write a result to the shared folder and go on from the written table.

    Used where several branches need one expensive input: each branch then reads
    the columns it wants instead of computing the whole lineage again, and a lost
    executor costs a re-read only. The table is removed when the application ends,
    or earlier by `discard`.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder, files = hadoop_folder(spark, path)
    files.deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the table behind a frame that `cut` returned, once nothing reads it any more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        folder, files = hadoop_folder(df.sparkSession, file)
        files.delete(folder, True)


def hadoop_folder(spark: SparkSession, path: str):
    """A folder and its file system, whatever store it is in."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())
