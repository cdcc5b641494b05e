"""Places that driver and executors share, for files that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset and all runs on this machine, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = "file://" + tempfile.mkdtemp(prefix="sightline-")
    spark.conf.set("spark.checkpoint.dir", found)
    delete_at_exit(spark, found)
    return found


def delete_at_exit(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    return path


def written(rows: DataFrame, name: str, *keys: str) -> str:
    """The folder of text files of `rows` (one string column beside the keys), one folder below it for each key's value; lines in the order that rows have."""
    path = new_folder(rows.sparkSession, name)
    (rows.write.partitionBy(*keys) if keys else rows.write).text(path)
    return path
