"""Distinct counts from stored sketches, merged by any grouping, with a stated error."""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a sketch are 2 ** LG_K; it takes a few KB whatever it has counted.
LG_K = 12


def error_bound(lg_k: int = LG_K, deviations: float = 3.0) -> float:
    """Relative error of a merged sketch that ``deviations`` standard deviations allow (3: 1 in 370 beyond)."""
    return deviations * 1.04 / sqrt(2**lg_k)


def distinct_sketches(df: DataFrame, by: Sequence[str], col: str, lg_k: int = LG_K) -> DataFrame:
    """``by`` columns and ``sketch``: what to store per batch or group; NULL is not counted.

    A group without a value other than NULL has an empty sketch.
    """
    return df.groupBy(*by).agg(F.hll_sketch_agg(F.col(col), F.lit(lg_k)).alias("sketch"))


def merged_counts(sketches: DataFrame, by: Sequence[str] = (), n: str = "distinct_values") -> DataFrame:
    """The estimate per coarser group, or over all; only the sketches are read, not what they counted.

    An estimate is rounded to a whole number; without any sketch the count over all is 0.
    """
    merged = sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("_merged"))
    estimate = F.coalesce(F.hll_sketch_estimate("_merged"), F.lit(0).cast("long"))
    return merged.select(*by, estimate.alias(n))
