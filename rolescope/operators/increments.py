"""Audits of a growing table from the counts of its batches; old batches are not read again.

The state of a batch is, for each audited column, its values and how many rows have each. It
is what the audits need and it can be added up: rows, gaps, distinct values, distributions and
dates come out as from the whole table. A batch that is entered again replaces its own state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import profile as P
from .dictionary import ROWS
from .totals import with_share


def add_batch(rows: DataFrame, columns: Sequence[str], folder: str, batch: int) -> None:
    """Stores the state of one batch, from one pass over it; text columns, or such as text tells apart."""
    entries = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    counts = rows.select(F.inline(entries)).groupBy("field", "value").agg(F.count(F.lit(1)).alias(ROWS))
    counts.write.mode("overwrite").partitionBy("field").parquet(f"{folder}/batch={int(batch)}")


def values(spark: SparkSession, folder: str, column: str) -> DataFrame:
    """column, _rows over all batches; NULL is a value. Only that column's state is read."""
    state = spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    own = state.where(F.col("field") == column)
    return own.groupBy(F.col("value").alias(column)).agg(F.sum(ROWS).alias(ROWS))


def table_profile(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """Rows and distinct keys."""
    keys = values(spark, folder, key)
    return keys.agg(
        F.lit(name).alias("table_name"), P.every(ROWS).alias("total_rows"), F.count(key).alias(f"distinct_{key}s")
    )


def distribution(spark: SparkSession, folder: str, column: str, n: str = "job_count", share: str = "percentage") -> DataFrame:
    counts = values(spark, folder, column).withColumnRenamed(ROWS, n)
    return with_share(counts, n, share)


def missing_audit(spark: SparkSession, folder: str, column: str, **options) -> DataFrame:
    return P.missing_audit(values(spark, folder, column), column, weight=ROWS, **options)


def temporal_coverage(spark: SparkSession, folder: str, column: str, **options) -> DataFrame:
    return P.temporal_coverage(values(spark, folder, column), column, weight=ROWS, **options)
