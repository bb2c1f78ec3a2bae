"""Cutting lineage in a way that survives lost executors.

Both helpers use the folder the session names in ``spark.checkpoint.dir``, which on a cluster is
shared. Only a local session without that setting (a test) gets a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def durable_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint: for small intermediate results of iterative jobs."""
    durable_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def durable_table(df: DataFrame, name: str) -> DataFrame:
    """Write as a columnar table and read it back: later reads prune columns and push filters."""
    spark = df.sparkSession
    path = f"{durable_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
