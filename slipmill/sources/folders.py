"""Folders that driver and executors share, and tables that are kept there while a job goes on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the place that driver and executors share; only a local session may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="slipmill-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df, computed once and kept as Parquet in a folder of its own: what reads it prunes columns, and its lineage ends there.

    It goes when the driver ends, and survives lost executors until then.
    """
    spark = df.sparkSession
    folder = work_folder(spark, name)
    df.write.parquet(folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(folder)


#: Rows up to which a table out of the data is broadcast, once it has been counted.
BROADCAST_ROWS = 50_000


def by_size(df: DataFrame) -> DataFrame:
    """df, written, to be broadcast if it has BROADCAST_ROWS rows at most; joins shuffle it otherwise."""
    kept = written(df, "counted")
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept
