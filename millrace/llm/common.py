"""Shared helpers: durable intermediate tables and bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that one Arrow batch may hold, so that long texts never pile up in a worker.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    It is set here, to a temporary folder, only in local mode and only where the session names none.
    """
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"{key} must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="millrace-shared-")
    spark.conf.set(key, folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, what: str = "table") -> tuple[DataFrame, str]:
    """Write a DataFrame to the shared folder and read it back: its lineage ends there,
    and a lost executor costs no more than rereading files."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches are limited by bytes as well as rows, unless the session asks for less."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    except Exception as e:  # a Spark without this setting keeps the bound on rows
        if "maxBytesPerBatch" not in str(e):
            raise


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def refuse_names(rows: DataFrame, *names: str) -> None:
    """No result may have two columns of one name: a table that brings one of the new names is refused."""
    clash = {n.lower() for n in names} & {c.lower() for c in rows.columns}
    if clash:
        raise ValueError(f"the table has a column of a new column's name: {sorted(clash)}")


def free_name(rows: DataFrame, name: str) -> str:
    """The name, or, if the table has such a column, the name with underscores added."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name
