"""Repeatable samples: the draw is an order by a seeded hash of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored


def draw_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def sample_rows(df: DataFrame, n: int, key: str = "job_link", seed: int = 42) -> DataFrame:
    """A simple random sample of n rows."""
    return df.orderBy(draw_order(key, seed), key).limit(n)


def sample_per_group(
    df: DataFrame, by: str, k: int, key: str = "job_link", seed: int = 42, rank: str = "sample_number"
) -> DataFrame:
    """A random sample of k rows of each group, numbered in draw order.

    Spark keeps k rows per group and map task before the shuffle (WindowGroupLimit) up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``, 1000 by default; for more rows there is
    ``large_sample_per_group``.
    """
    window = Window.partitionBy(by).orderBy(draw_order(key, seed), key)
    return df.withColumn(rank, F.row_number().over(window).cast("bigint")).filter(F.col(rank) <= k)


def large_sample_per_group(
    df: DataFrame, by: str, k: int, key: str = "job_link", seed: int = 42, rank: str = "sample_number"
) -> DataFrame:
    """The same sample for any k: no task sees more of a group than one slice of its draw order.

    The first four digits of the draw order cut every group into 65,536 slices. Their sizes say
    how many rows lie before a slice and which slices reach the k-th row; a row's number is that
    and its place in its slice. Slices beyond are dropped before the shuffle where the table of
    sizes is small enough to be sent to the rows.
    """
    drawn = df.withColumn("_draw", draw_order(key, seed)).withColumn("_slice", F.left("_draw", F.lit(4)))
    # a row with a NULL key has no place in the order but the first
    drawn = drawn.withColumn("_slice", F.coalesce("_slice", F.lit("")))
    sizes = drawn.groupBy(F.col(by).alias("_by"), F.col("_slice").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_by").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).filter(F.col("_before") < k)
    sizes = stored(sizes.select("_by", "_s", "_before"), "sample_slices")
    kept = drawn.join(sizes, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_slice") == F.col("_s")))
    place = F.row_number().over(Window.partitionBy(by, "_slice").orderBy("_draw", key)) + F.col("_before")
    return kept.withColumn(rank, place.cast("bigint")).filter(F.col(rank) <= k).select(*df.columns, rank)
