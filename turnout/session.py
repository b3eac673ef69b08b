"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # streaming state beside the heap: contacts are many
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings the operators rely on (UTC clock, AQE, Arrow)."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a private one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="turnout-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so physical row order and ids survive lost executors."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path objects, for stores that only Spark reaches."""
    jvm = spark._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers n of the folders ``path/prefix=n`` that were written to the end."""
    fs, there = file_system(spark, f"{path}/{prefix}=*/_SUCCESS")
    found = fs.globStatus(there) or []
    return sorted(int(status.getPath().getParent().getName().split("=")[1]) for status in found)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder (streaming sinks, their checkpoints)."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
