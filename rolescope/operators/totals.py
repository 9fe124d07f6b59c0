"""Totals beside rows, and ranked heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import pct


def total_of(counts: DataFrame, n: str = "job_count") -> Column:
    """Sum of a count column as a scalar subquery.

    The rows stay where they are, unlike under an unpartitioned window, which moves them
    all into one task. The subquery reuses the shuffle that produced the counts.
    """
    return counts.agg(F.sum(n)).scalar()


def rows_of(df: DataFrame) -> Column:
    """Number of rows as a scalar subquery."""
    return df.agg(F.count(F.lit(1))).scalar()


def with_share(counts: DataFrame, n: str = "job_count", share: str = "percentage", base=None) -> DataFrame:
    """Adds the share of each count in ``base`` (a number or Column; default: the sum of the counts)."""
    whole = total_of(counts, n) if base is None else as_base(base)
    return counts.withColumn(share, pct(F.col(n), whole))


def as_base(base) -> Column:
    """A denominator given as a number, a one-value Column, or a DataFrame whose rows count."""
    if isinstance(base, DataFrame):
        return rows_of(base)
    return base if isinstance(base, Column) else F.lit(base).cast("bigint")


def top(df: DataFrame, k: int, n: str, *ties: str) -> DataFrame:
    """The k rows with the largest count; ``ties`` make the choice definite."""
    return df.orderBy(F.desc(n), *[F.asc(c) for c in ties]).limit(k)
