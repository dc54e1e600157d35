"""Materialising a result that several later steps read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_removed_at_exit: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as `spark.checkpoint.dir` names it.

    Without that setting a local session uses a folder of its own; a cluster has to name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def application_folder(spark: SparkSession) -> str:
    """Where this application keeps its tables; the folder goes when the application ends."""
    folder = f"{shared_folder(spark)}/stayline/{spark.sparkContext.applicationId}"
    if folder not in _removed_at_exit:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _removed_at_exit.add(folder)
    return folder


def store(df: DataFrame, name: str) -> DataFrame:
    """Write once as Parquet to the shared folder and read back: lost executors cost no recomputation,
    and later steps read only the columns they need and know the size."""
    spark = df.sparkSession
    path = f"{application_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    return store(df, "kept")
