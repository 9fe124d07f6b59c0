"""Parquet and catalog tables, and intermediate tables of a session."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _write_counted(df: DataFrame, save) -> int:
    seen = Observation("written")
    save(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


def write_parquet(df: DataFrame, path: str) -> int:
    """Replaces the directory and returns the rows written, counted while writing."""
    return _write_counted(df, lambda d: d.write.mode("overwrite").parquet(path))


def write_table(df: DataFrame, name: str, buckets: int | None = None, key: str = "job_link") -> int:
    """Replaces a catalog table and returns the rows written.

    Tables bucketed alike by the join key are later joined on it without a shuffle.
    """

    def save(d: DataFrame) -> None:
        writer = d.write.mode("overwrite").format("parquet")
        if buckets:
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(name)

    return _write_counted(df, save)


def export_columns(spark: SparkSession, name: str, cols: Sequence[str]) -> DataFrame:
    return spark.table(name).select(*cols)


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate results that outlive an executor.

    Taken from ``spark.checkpoint.dir``. Only a local master may do without the setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="rolescope-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder once and read back: of known size, and safe from a lost executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def session_table(df: DataFrame, name: str) -> DataFrame:
    """Writes an intermediate result once, registers it as a view and reads it back.

    The rows survive the loss of an executor, and their size is known to the joins that follow.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    stored = spark.read.parquet(path)
    stored.createOrReplaceTempView(name)
    return stored
