"""A session for local runs; on a cluster, use the cluster's own."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local(cpus: str | int = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("nomina")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def scratch(spark: SparkSession) -> str:
    """A new path for files that driver and executors both see, below
    ``spark.checkpoint.dir``; deleted as the driver ends. A local master may go
    without that setting; elsewhere it is an error to leave it out."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.gettempdir()
    path = f"{shared}/nomina-{uuid.uuid4().hex}"
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = made.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(made)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with files below ``spark.checkpoint.dir``; a local master may
    go without that setting."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or scratch(spark))
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """``checkpoint``, of a size that the planner doesn't know. Its guesses multiply
    from join to join, and in a loop their digits fill the driver."""
    spark, written = df.sparkSession, checkpoint(df)._jdf
    return type(df)(spark._jsparkSession.createDataFrame(written.toJavaRDD(), written.schema()), spark)
