"""Tables written between steps, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; a cluster is refused, as its
    executors could not read each other's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='paperloom-')}")
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def scratch_folder(spark: SparkSession, kind: str) -> str:
    """The path of a new folder, which is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def written(df: DataFrame) -> DataFrame:
    """The same rows, written and read again: iterations stay short in lineage and survive lost executors. The table is
    deleted when the driver's JVM ends."""
    spark = df.sparkSession
    path = scratch_folder(spark, "paperloom-steps")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
