"""Where the adverts are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookups import NON_US
from ..functions.text import last_segment
from ..operators.profile import (
    count_where, distinct_counts, every, group_totals, rounded_distribution, value_counts,
)
from ..operators.totals import top, total_of


def location_formats(combined: DataFrame, k: int = 20) -> DataFrame:
    """Most frequent texts after the last comma."""
    parts = combined.select(last_segment("job_location").alias("location_last_part"))
    known = parts.filter(F.col("location_last_part").isNotNull())
    return top(value_counts(known, "location_last_part"), k, "job_count", "location_last_part")


def location_variety(combined: DataFrame) -> DataFrame:
    parts = combined.withColumn("location_last_part", last_segment("job_location"))
    return distinct_counts(
        parts, {"distinct_locations": "job_location", "distinct_last_parts": "location_last_part"}
    )


def resolved(state: str = "state") -> Column:
    return F.col(state).isNotNull() & (F.col(state) != NON_US)


def state_resolution(located: DataFrame, weight: str | None = None) -> DataFrame:
    return located.agg(
        count_where(resolved(), weight).alias("resolved_us"),
        count_where(F.col("state") == NON_US, weight).alias("non_us"),
        count_where(F.col("state").isNull(), weight).alias("unresolved"),
        every(weight).alias("total"),
    )


def unresolved_locations(located: DataFrame, k: int | None = None, weight: str | None = None) -> DataFrame:
    """Locations without a state and their adverts: all of them, or the k most frequent."""
    gaps = located.filter(F.col("state").isNull() & F.col("job_location").isNotNull())
    counts = value_counts(gaps, "job_location", weight=weight)
    return top(counts, k, "job_count", "job_location") if k else counts


def state_top(located: DataFrame, k: int = 15, weight: str | None = None) -> DataFrame:
    """States with the most adverts, as a share of all adverts."""
    states, whole = located.filter(resolved()), located if weight is None else total_of(located, weight)
    shares = rounded_distribution(states, "state", "job_count", base=whole, weight=weight)
    return top(shares, k, "job_count", "state")


def state_totals(located: DataFrame, weight: str | None = None) -> DataFrame:
    counts = value_counts(located.filter(resolved()), "state", weight=weight)
    return group_totals(counts, "job_count", "resolved_postings", "distinct_states")
