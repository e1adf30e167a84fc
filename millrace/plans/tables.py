"""Intermediate tables that end a plan's lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in local mode, where none is set."""
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"{key} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="millrace-shared-")
        spark.conf.set(key, found)
    return found.rstrip("/")


def write_table(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
