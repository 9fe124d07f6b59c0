"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in tests, a new temporary folder."""
    name = "spark.checkpoint.dir"
    folder = spark.conf.get(name, None) or spark.sparkContext.getConf().get(name)
    if not folder:
        folder = tempfile.mkdtemp(prefix="rolescope-llm-")
        spark.conf.set(name, folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table once and reads it back: lineage ends here, and no executor's loss undoes it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
