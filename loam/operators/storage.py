"""Where jobs put tables for themselves: the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

OWN_FOLDER = "/tmp/checkpoints/loam"


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir, or below our own where that is unset and all runs on this machine (tests). It goes when the application ends."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{given or OWN_FOLDER}/{tag}-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
